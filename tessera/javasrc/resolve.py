"""Names to declared types, as joins: the first of same file, same package, explicit import, wildcard import and fallback that knows the name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.storage import stored

from . import stage

JAVA_LANG = (
    "String Object Integer Long Double Float Boolean Byte Short Character CharSequence StringBuilder StringBuffer Thread Runnable System Math Exception RuntimeException Throwable "
    "Error IllegalArgumentException IllegalStateException NullPointerException IndexOutOfBoundsException UnsupportedOperationException"
).split()
CLIMB = 20


def _last(name):
    return F.element_at(F.split(name, r"[.$]"), -1)


def chain(names: DataFrame, declared: DataFrame, imported: DataFrame) -> DataFrame:
    """``names(path, package, target)`` to ``(path, target, resolved, local, handler)``, one row for each path and target.

    Every handler is an equi-join (suffixes join on the last segment, or within the file); the
    first that matches wins, of several matches the least name or the first import.
    """
    asked = stored(names.select("path", "package", "target").distinct().withColumn("_last", _last(F.col("target"))), "asked")
    known = declared.select(F.col("fqcn"), F.col("path").alias("_path"), "nesting")
    symbols = known.select("fqcn").distinct()
    exact = asked.join(symbols, F.col("target") == F.col("fqcn")).select("path", "target", F.col("fqcn").alias("found"), F.lit(True).alias("local"), F.lit(0).alias("nth"), F.lit(0).alias("rank"))
    own = known.where("nesting <= 1").withColumn("_end", _last(F.col("fqcn")))
    same_file = asked.join(own, (F.col("path") == F.col("_path")) & (F.col("_last") == F.col("_end")))
    same_file = same_file.where((F.col("fqcn") == F.col("target")) | F.col("fqcn").endswith(F.concat(F.lit("."), "target")) | F.col("fqcn").endswith(F.concat(F.lit("$"), "target")))
    same_file = same_file.groupBy("path", "target").agg(F.min("fqcn").alias("found")).select("path", "target", "found", F.lit(True), F.lit(0), F.lit(1))
    packed = asked.withColumn("_name", F.when(F.col("package") == "", F.col("target")).otherwise(F.concat_ws(".", "package", "target")))
    same_package = packed.join(symbols, F.col("_name") == F.col("fqcn")).select("path", "target", "fqcn", F.lit(True), F.lit(0), F.lit(2))
    explicit = imported.where("not wildcard").select(F.col("path").alias("_p"), "name", "ord").withColumn("_end", F.element_at(F.split("name", r"\."), -1))
    explicit = asked.withColumn("_tail", F.element_at(F.split("target", r"\."), -1)).join(explicit, (F.col("path") == F.col("_p")) & (F.col("_tail") == F.col("_end")) & F.col("name").endswith(F.concat(F.lit("."), "target")))
    explicit = explicit.join(symbols, F.col("name") == F.col("fqcn"), "left").select("path", "target", "name", F.col("fqcn").isNotNull(), "ord", F.lit(3))
    stars = imported.where("wildcard").select(F.col("path").alias("_p"), "name", "ord")
    wildcard = asked.join(stars, F.col("path") == F.col("_p")).withColumn("_name", F.concat_ws(".", "name", "target"))
    wildcard = wildcard.join(symbols, F.col("_name") == F.col("fqcn")).select("path", "target", "fqcn", F.lit(True), "ord", F.lit(4))
    outside = F.when(F.col("target").isin(*JAVA_LANG), F.concat(F.lit("java.lang."), "target")).otherwise(F.col("target"))
    external = asked.select("path", "target", outside, F.lit(False), F.lit(0), F.lit(5))
    every = exact.union(same_file).union(same_package).union(explicit).union(wildcard).union(external)
    best = F.min(F.struct("rank", "nth", "found", "local"))
    names_of = F.array(*map(F.lit, ("exact", "same-file", "same-package", "explicit-import", "wildcard-import", "external")))
    return every.groupBy("path", "target").agg(best.alias("b")).select("path", "target", F.col("b.found").alias("resolved"), F.col("b.local").alias("local"), F.get(names_of, F.col("b.rank")).alias("handler"))


def invocations(units: DataFrame, declared: DataFrame) -> DataFrame:
    """Resolved calls: ``(path, caller, caller_method, target, method, signature, kind, line, col, resolved_locally, unresolved)``.

    The method is looked up in the resolved type and, while the type is of the calling file, in its
    superclasses (at most 20); it is accepted only where it is the one of its name and the number
    of arguments fits. All calls climb together, one join a level.
    """
    imported = stage.imports(units)
    calls = stage.calls(units)
    parents = declared.select("fqcn", "path", "package", F.col("superclass").alias("parent")).where("parent is not null")
    direct = parents.select(F.col("fqcn").alias("_caller"), F.col("parent").alias("_super"))
    calls = calls.join(direct, (F.col("caller") == F.col("_caller")) & (F.col("how") == "super"), "left")
    calls = stored(calls.withColumn("target", F.when(F.col("how") == "super", F.coalesce("_super", "caller")).otherwise(F.col("target"))).drop("_caller", "_super"), "calls")
    wanted = calls.select("path", "package", "target").union(parents.select("path", "package", F.col("parent").alias("target")))
    names = stored(chain(wanted, declared, imported), "names")
    found = calls.join(names, ["path", "target"])
    found = stored(found.withColumn("ok", F.col("local") & (F.col("how") != "unsupported") & (F.col("kind") != "CONSTRUCTOR_CALL")), "resolved")

    by_name = stage.methods(declared).groupBy(F.col("fqcn").alias("_type"), F.col("name").alias("_name")).agg(F.count("*").alias("n"), F.min(F.size("param_types")).alias("arity"), F.min("signature").alias("signature"))
    climb = parents.join(names.select(F.col("path").alias("_p"), F.col("target").alias("_t"), F.col("resolved").alias("_r")), (F.col("path") == F.col("_p")) & (F.col("parent") == F.col("_t")))
    above = stored(climb.select(F.col("fqcn").alias("_from"), F.col("path").alias("_file"), F.when(F.col("parent").contains("."), F.col("parent")).otherwise(F.col("_r")).alias("_to")), "above")
    looking = found.where("ok").select("path", "ord", "method", "arguments", F.col("resolved").alias("at"))
    hits = None
    for _ in range(CLIMB):
        step = stored(looking.join(by_name, (F.col("at") == F.col("_type")) & (F.col("method") == F.col("_name")), "left"), "climb")
        hit = step.where((F.col("n") == 1) & (F.col("arity") == F.col("arguments"))).select("path", "ord", F.col("at").alias("declarer"), F.col("signature").alias("found_signature"))
        hits = hit if hits is None else hits.union(hit)
        looking = step.where("n is null").join(above, (F.col("at") == F.col("_from")) & (F.col("path") == F.col("_file"))).where("_to <> at").select("path", "ord", "method", "arguments", F.col("_to").alias("at"))
        looking = stored(looking, "climbing")
        if looking.isEmpty():
            break
    out = found.join(hits, ["path", "ord"], "left")
    target = F.when(F.col("how") == "unsupported", F.concat(F.lit("<unresolved>:"), "target")).otherwise(F.coalesce("declarer", "resolved"))
    signature = F.when(F.col("kind") == "CONSTRUCTOR_CALL", "<init>()").otherwise(F.coalesce("found_signature", F.concat("method", F.lit("(?)"))))
    return out.select(
        "path", "caller", "caller_method", target.alias("target"), "method", signature.alias("signature"), "kind", F.col("range.line").alias("line"), F.col("range.col").alias("col"),
        (F.col("local") & (F.col("how") != "unsupported")).alias("resolved_locally"), (F.col("how") == "unsupported").alias("unresolved"), "handler",
    )


def metrics(resolved: DataFrame) -> DataFrame:
    """For each file: total, internal, external and unresolvable calls, and the share resolved (1 without calls)."""
    n = lambda c: F.count(F.when(c, 1))
    rows = resolved.groupBy("path").agg(F.count("*").alias("total"), n(F.col("resolved_locally")).alias("internal"), n(F.col("unresolved")).alias("unresolvable"))
    rows = rows.withColumn("external", F.col("total") - F.col("internal") - F.col("unresolvable"))
    return rows.withColumn("ratio", F.when(F.col("total") <= 0, 1.0).otherwise((F.col("internal") + F.col("external")) / F.col("total")))


def hierarchy(declared: DataFrame) -> DataFrame:
    """``(child, parent, kind, nth)``: names as written, superclass first."""
    up = declared.select(F.col("fqcn").alias("child"), F.explode(F.concat(F.when(F.col("superclass").isNotNull(), F.array(F.struct(F.col("superclass").alias("parent"), F.lit("extends").alias("kind"), F.lit(0).alias("nth")))).otherwise(F.array()), F.transform("interfaces", lambda x, i: F.struct(x.alias("parent"), F.lit("implements").alias("kind"), (i + 1).alias("nth"))))).alias("p"))
    return up.select("child", "p.*")


def supertypes(parents: DataFrame, limit: int = CLIMB) -> DataFrame:
    """All supertypes of each type, at most ``limit`` of each (part of the definition), cycle-safe: ``(child, parent, depth, position)``.

    Nearest first; on one level, those of the earlier type of the level below first, and of one type
    its superclass before its interfaces, which are a set, by name (``nth`` of :func:`hierarchy`;
    without it, all by name). ``position`` counts from 1.
    """
    nth = F.col("nth") if "nth" in parents.columns else F.row_number().over(Window.partitionBy("child").orderBy("parent"))
    step = stored(parents.where("child <> parent").select("child", "parent", nth.cast("int").alias("nth")).groupBy("child", "parent").agg(F.min("nth").alias("nth")), "parents")
    frontier = seen = stored(step.select("child", "parent", F.lit(1).alias("depth"), F.array("nth").alias("way")), "supers")
    for d in range(2, limit + 1):
        new = frontier.join(step.toDF("_c", "_p", "nth"), F.col("parent") == F.col("_c")).where("child <> _p")
        new = new.groupBy("child", F.col("_p").alias("parent")).agg(F.min(F.concat("way", F.array("nth"))).alias("way"))
        frontier = stored(new.join(seen.select("child", "parent"), ["child", "parent"], "left_anti").select("child", "parent", F.lit(d).alias("depth"), "way"), "supers")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    w = Window.partitionBy("child").orderBy("depth", "way", "parent")
    return seen.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit).select("child", "parent", "depth", "position")


def find_method(declared: DataFrame, supers: DataFrame) -> DataFrame:
    """``(fqcn, name, declarer)``: each method a type has, its own first, then of the first of :func:`supertypes` that declares it."""
    own = stage.methods(declared).select("fqcn", "name").distinct()
    far = supers.join(own.toDF("_t", "name"), F.col("parent") == F.col("_t")).select(F.col("child").alias("fqcn"), "name", F.col("parent").alias("declarer"), "position")
    rows = own.select("fqcn", "name", F.col("fqcn").alias("declarer"), F.lit(0).alias("position")).union(far)
    return rows.groupBy("fqcn", "name").agg(F.min_by("declarer", "position").alias("declarer"))


def subtypes(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """Direct subtypes of ``targets(target)``, names compared whole or by either's last segments: an equi-join on the last one, then the suffix check."""
    a = parents.withColumn("_l", F.element_at(F.split("parent", r"\."), -1))
    b = targets.select("target").distinct().withColumn("_r", F.element_at(F.split("target", r"\."), -1))
    same = (F.col("parent") == F.col("target")) | F.col("parent").endswith(F.concat(F.lit("."), "target")) | F.col("target").endswith(F.concat(F.lit("."), "parent"))
    return a.join(b, F.col("_l") == F.col("_r")).where(same).select("target", "child", "kind")
