"""What a report or dashboard shows of finished tables: levels, facts, leading types, areas, and the architecture table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def display_level(score: Column) -> Column:
    """The level that a report shows; its bounds differ from those of the risk level."""
    return F.when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def display_ids(vertices: DataFrame) -> DataFrame:
    """Declared vertices with ``display``: the simple name where it is unique among them, else the full one."""
    rows = vertices.where("not is_boundary")
    counts = rows.groupBy(F.col("simple_name").alias("_simple")).agg(F.count("*").alias("_n"))
    return rows.join(counts, rows["simple_name"].eqNullSafe(F.col("_simple"))).withColumn("display", F.when(F.col("_n") > 1, F.col("id")).otherwise(F.col("simple_name"))).drop("_simple", "_n")


def areas(vertices: DataFrame) -> DataFrame:
    """``(area, title, classes)``: packages of the declared types; no package is "default"."""
    area = F.when(F.coalesce(F.trim("package"), F.lit("")) == "", "default").otherwise(F.col("package"))
    return vertices.where("not is_boundary").groupBy(area.alias("area")).agg(F.count("*").alias("classes")).withColumn("title", F.element_at(F.split("area", r"\."), -1))


def classes(vertices: DataFrame, hotspots: DataFrame, risk: DataFrame, cycles: DataFrame, history: DataFrame | None, edges: DataFrame) -> DataFrame:
    """One row for each declared type: display name, area, risk and shown level, rank, degrees, instability, churned lines, commits, authors and whether it is in a loop."""
    from . import risk as history_of

    rows = display_ids(vertices).select("id", "display", "kind", "package", "path")
    rows = rows.withColumn("area", F.when(F.coalesce(F.trim("package"), F.lit("")) == "", "default").otherwise(F.col("package")))
    loop = cycles.select(F.explode("path").alias("id")).distinct().withColumn("in_loop", F.lit(True))
    rows = rows.join(hotspots.select("id", "position", "in_degree", "out_degree"), "id", "left").join(risk.select("id", "overall"), "id", "left").join(loop, "id", "left")
    if history is None:
        rows = rows.withColumns({"churn": F.lit(0).cast("long"), "commits": F.lit(0).cast("long"), "authors": F.lit(0).cast("long")})
    else:
        lines = history.select(F.col("path").alias("_path"), (F.col("added") + F.col("deleted")).alias("churn"), "commits", "authors")
        rows = history_of.suffix_joined(rows.withColumnRenamed("path", "file"), lines, "file", "_path", "id").drop("_path").withColumnRenamed("file", "path")
        rows = rows.fillna({"churn": 0, "commits": 0, "authors": 0})
    own = graph.instability(edges.select("src", "dst"), rows.select("id")).select("id", "instability")
    rows = rows.join(own, "id", "left").fillna({"overall": 0.0, "in_degree": 0, "out_degree": 0, "instability": 0.0})
    return rows.withColumn("in_loop", F.coalesce("in_loop", F.lit(False))).withColumn("shown_level", display_level(F.col("overall")))


def facts(rows: DataFrame) -> DataFrame:
    """For each of ``rows(id, in_degree, in_loop, churn, authors)`` how grave its fan-in, loop, churn and authorship are, and what to do first."""
    return rows.select(
        "id",
        F.when(F.col("in_degree") >= 10, "hi").when(F.col("in_degree") >= 4, "med").otherwise("low").alias("dependents"),
        F.when(F.col("in_loop"), "hi").otherwise("low").alias("loop"),
        F.when(F.col("churn") >= 30, "hi").when(F.col("churn") > 0, "med").otherwise("low").alias("churned"),
        F.when((F.col("churn") > 0) & (F.col("authors") == 1), "med").otherwise("low").alias("ownership"),
        F.when(F.col("in_loop") & (F.col("in_degree") >= 8), "handle-with-care").when(F.col("in_loop"), "untangle").when(F.col("churn") >= 30, "add-tests").when(F.col("in_degree") >= 10, "keep-stable").otherwise("healthy").alias("advice"),
    )


def leading(rows: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """``(list, position, id, value)``: the 6 types of most risk, the 3 with most dependents, and the 5 that most others reach within ``depth`` calls. Ties go to the lesser id."""
    reached = graph.radius(edges, rows.select(F.col("id").alias("target")), depth, 0)
    parts = [("risk", rows.select("id", F.col("overall").cast("double").alias("value")), 6), ("dependents", rows.select("id", F.col("in_degree").cast("double").alias("value")), 3), ("radius", reached.select(F.col("target").alias("id"), F.col("reached").cast("double").alias("value")), 5)]
    out = None
    for name, df, n in parts:
        top = df.orderBy(F.desc("value"), "id").limit(n)
        top = top.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(F.desc("value"), "id")).alias("position"), "id", "value")  # of n rows
        out = top if out is None else out.union(top)
    return out


def radius_by_area(reached: DataFrame, areas_of: DataFrame, only: str = "all") -> DataFrame:
    """``(target, depth, area, n)``: what :func:`graph.reach` found by ``areas_of(id, area, shown_level)``; ``only``: "all", "high-risk" types, or those "cross-area" to the target."""
    rows = reached.join(areas_of.select(F.col("id").alias("_id"), "area", "shown_level"), F.col("id") == F.col("_id"))
    if only == "high-risk":
        rows = rows.where(F.col("shown_level") == "HIGH")
    elif only == "cross-area":
        rows = rows.join(areas_of.select(F.col("id").alias("_of"), F.col("area").alias("_own")), F.col("target") == F.col("_of")).where("area <> _own")
    return rows.groupBy("target", "depth", "area").agg(F.count("*").alias("n"))


def architectural(cycles: DataFrame, hot: DataFrame, places: DataFrame) -> DataFrame:
    """Findings CC001 for each of ``cycles(path)``, at its first type, and CC002 for each of ``hot(id, rank, in_degree, level)`` of high or critical risk; located by ``places(id, path, line, col)``."""
    loops = cycles.select(F.col("path").getItem(0).alias("id"), F.lit("CC001").alias("rule_id"), F.lit("HIGH").alias("severity"), F.concat(F.lit("Architectural cycle detected: "), F.array_join("path", " -> ")).alias("message"), F.concat(F.lit("cycleLength="), (F.size("path") - 1).cast("string")).alias("status"))
    said = F.format_string("High-risk architectural hotspot: %s (PageRank: %.4f, In-degree: %d, Risk: %s)", "id", "rank", "in_degree", "level")
    hot = hot.where(F.col("level").isin("HIGH", "CRITICAL")).select("id", F.lit("CC002"), F.lit("MEDIUM"), said, F.concat(F.lit("riskLevel="), "level"))
    where = places.select(F.col("id").alias("_id"), "path", "line", "col")
    rows = loops.union(hot).join(where, F.col("id") == F.col("_id"), "left")
    return rows.select("path", "line", "col", F.col("id").alias("raw"), "rule_id", "severity", F.lit("ARCHITECTURE").alias("category"), F.lit(None).cast("string").alias("cwe"), "message", "status")
