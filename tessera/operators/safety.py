"""Change safety: which types a change touches, whom it reaches, and whether it keeps to its plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import covered

from . import graph


def _normal(col: str):
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(F.col(col), r"\\", "/"), "^(?:[a-z]+://[^/]*)?/?|[?#].*$", ""))


def _last(col: str):
    return F.element_at(F.split(col, "/"), -1)


def touched(vertices: DataFrame, modified: DataFrame) -> DataFrame:
    """Rows of ``vertices(id, path)`` whose path equals a ``modified(file)`` or either ends with the other (whole segments)."""
    rows = vertices.withColumn("_p", _normal("path"))
    return rows.join(covered(rows, modified.select(_normal("file").alias("_f"))), "_p", "left_semi").drop("_p")


def violations(modified: DataFrame, allowed: DataFrame, plan_file: str | None = None) -> DataFrame:
    """Modified files that no ``allowed(file)`` covers (equal, or either ends with the other); the plan's own file is ignored."""
    rows = modified.select("file").distinct()
    if plan_file:
        rows = rows.where(F.col("file") != plan_file)
    rows = rows.withColumn("_p", _normal("file"))
    return rows.join(covered(rows, allowed.select(_normal("file").alias("_f"))), "_p", "left_anti").select("file")


def suggested_tests(vertices: DataFrame, impacted: DataFrame) -> DataFrame:
    """Test files of impacted types: ``(file, simple_name)`` where a file is named ``...Test``, ``...Tests`` or ``...TestCase`` and that name contains a type's.

    Stretches of the file's name meet the names in an equi-join; only stretches as long as some name
    are made, and how long names are is all that the driver sees.
    """
    names = impacted.select("simple_name").where("simple_name <> ''").distinct()
    lengths = sorted(r[0] for r in names.select(F.length("simple_name")).distinct().collect())
    base = F.replace(_last("_p"), F.lit(".java"), F.lit(""))
    tests = vertices.where("path is not null").withColumn("_p", _normal("path")).where(F.col("_p").rlike(r"(Test|Tests|TestCase)\.java$")).select(F.col("path").alias("file"), base.alias("_base")).distinct()
    wanted = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("_base"))
    stretches = F.flatten(F.transform(wanted, lambda n: F.transform(F.sequence(F.lit(1), F.length("_base") - n + 1), lambda i: F.substring(F.col("_base"), i, n))))
    return tests.select("file", F.explode(F.array_distinct(stretches)).alias("simple_name")).join(names, "simple_name", "left_semi").select("file", "simple_name")


def diff_impact(vertices: DataFrame, edges: DataFrame, modified: DataFrame, depth: int = 3) -> dict[str, DataFrame]:
    """Touched types, their distinct callers with the least depth, and the tests to run."""
    hit = touched(vertices.where("path is not null"), modified)
    reached = graph.reach(edges, hit.select(F.col("id").alias("target")), depth)
    callers = reached.groupBy("id").agg(F.min("depth").alias("depth"))
    tests = callers.where(graph.is_test(F.col("id"))).select("id")
    named = vertices.join(hit.select(F.concat("simple_name", F.lit("Test")).alias("_t")), F.col("simple_name") == F.col("_t"), "left_semi").select("id")
    return {"touched": hit, "callers": callers, "tests": tests.union(named).distinct()}


def plan(vertices: DataFrame, edges: DataFrame, target: str, depth: int = 3) -> dict:
    """A change plan for one type: allowed files, callers, requirement sentences and tests; None if the type is unknown."""
    found = graph.lookup(vertices, target)
    if found is None:
        return None
    own = vertices.where(F.col("id") == found).first()
    simple = own["simple_name"]
    spark = vertices.sparkSession
    reached = graph.reach(edges, spark.createDataFrame([(found,)], "target string"), depth)
    callers = [r["id"] for r in reached.orderBy("depth", "id").select("id").collect()]
    tests = vertices.where(F.col("simple_name") == f"{simple}Test").orderBy("id").collect()
    rules = [f"WHEN {simple} is changed, THE change SHALL keep its public methods working for {len(callers)} callers.", f"WHEN {simple} is changed, THE change SHALL touch allowed files only."]
    if tests:
        rules.append(f"WHEN {simple} is changed, THE tests {', '.join(t['simple_name'] for t in tests)} SHALL pass.")
    recommended = sorted({t["id"] for t in tests} | {r["id"] for r in reached.where(graph.is_test(F.col("id"))).collect()})
    files = [x["path"] for x in [own, *tests] if x["path"]]
    return {"schemaVersion": "1.0.0", "targetClass": found, "allowedModifiedFiles": files, "impactedCallers": callers, "earsRules": rules, "recommendedTests": recommended}
