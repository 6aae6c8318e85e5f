"""Change history metrics and composite risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import ends, slashed


def author(name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(email), F.lit("")), F.lit("unknown"))


def churn(changes: DataFrame) -> DataFrame:
    """``changes(path, commit, author, added, deleted[, is_root])`` to ``(path, commits, added, deleted, authors)``; a root commit counts 10 added lines for each file."""
    added = F.when(F.col("is_root"), 10).otherwise(F.col("added")) if "is_root" in changes.columns else F.col("added")
    return changes.groupBy("path").agg(
        F.countDistinct("commit").alias("commits"), F.sum(added).alias("added"), F.sum("deleted").alias("deleted"), F.countDistinct("author").alias("authors")
    )


def bus_factor(changes: DataFrame) -> DataFrame:
    """``(path, bus_factor)``: 1 - H / H_max of the authors' shares of a file's commits, in [0, 1]; 1 for a single author."""
    each = changes.groupBy("path", "author").agg(F.count("*").alias("n"))
    # H = log2(total) - sum(n log2 n) / total, so one aggregate over the pre-aggregated counts is enough
    sums = each.groupBy("path").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"), F.count("*").alias("k"))
    h = F.log2(F.col("total").cast("double")) - F.col("s") / F.col("total")
    value = F.when(F.col("k") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - h / F.log2(F.col("k").cast("double")))))
    return sums.select("path", value.alias("bus_factor"))


def suffix_joined(left: DataFrame, right: DataFrame, left_path: str, right_path: str, left_key: str) -> DataFrame:
    """Rows of ``left`` with the row of ``right`` whose path equals theirs or ends one another, the longest of several (then the least), or nulls.

    Paths meet on whole ends. Of all rows of ``right`` below one end, the least is chosen before
    the join, so a file name that many share is no hot key. Joins are merges: what is broadcast is
    chosen by the size of files, which says little of the ends made of their rows.
    """
    row = F.struct(F.col(right_path).alias("_by"), *right.columns)
    given = right.where(F.col(right_path).isNotNull()).withColumn("_b", slashed(F.col(right_path)))
    equal = given.groupBy("_b").agg(F.min(row).alias("_row"))
    below = given.withColumn("_b", F.explode(ends(F.col("_b")))).groupBy("_b").agg(F.min(row).alias("_row"))
    asked = left.select(left_key, slashed(F.col(left_path)).alias("_a")).where("_a is not null").distinct()
    shorter = asked.select(left_key, F.explode(ends(F.col("_a"))).alias("_b")).join(equal.hint("merge"), "_b").select(left_key, F.length("_b").alias("_n"), "_row")
    longer = asked.join(below.withColumnRenamed("_b", "_a").hint("merge"), "_a").select(left_key, F.length("_a").alias("_n"), "_row")
    best = longer.union(shorter).groupBy(left_key).agg(F.min(F.struct((-F.col("_n")).alias("_n"), "_row")).alias("_best")).select(F.col(left_key).alias("_key"), "_best._row")
    return left.join(best.hint("merge"), F.col(left_key) == F.col("_key"), "left").select(*[F.col(c) for c in left.columns], *[F.col(f"_row.{c}").alias(c) for c in right.columns])


def level(score: Column) -> Column:
    return F.when(score <= 25, "LOW").when(score <= 50, "MEDIUM").when(score <= 75, "HIGH").otherwise("CRITICAL")


def composite(hotspots: DataFrame, metrics: DataFrame | None) -> DataFrame:
    """``hotspots(id, position, minmax_score, in_cycle[, path])`` with ``metrics(path, commits, added, deleted, bus_factor)`` to ``(id, overall, level, churn_score, position)``.

    With history: 0.40 rank + 0.30 churn + 0.20 cycle + 0.10 bus factor; without any: 0.60 and 0.40.
    """
    cycle = F.when(F.col("in_cycle"), 100.0).otherwise(0.0)
    if metrics is None:
        overall, rows = 0.60 * F.col("minmax_score") + 0.40 * cycle, hotspots.withColumn("churn_score", F.lit(0.0))
    else:
        raw = metrics.select("path", (F.col("commits") + (F.col("added") + F.col("deleted")) / 10.0).alias("churn"), "bus_factor")
        most = max(1.0, float(raw.agg(F.max("churn")).first()[0] or 0.0))
        joined = suffix_joined(hotspots.withColumnRenamed("path", "file"), raw, "file", "path", "id")
        rows = joined.withColumn("churn_score", 100.0 * F.coalesce("churn", F.lit(0.0)) / most)
        overall = 0.40 * F.col("minmax_score") + 0.30 * F.col("churn_score") + 0.20 * cycle + 0.10 * 100.0 * F.coalesce("bus_factor", F.lit(0.0))
    overall = F.greatest(F.lit(0.0), F.least(F.lit(100.0), overall))
    return rows.withColumn("overall", overall).select("id", "overall", level(F.col("overall")).alias("level"), "churn_score", "position")


def single_author(metrics: DataFrame) -> DataFrame:
    return metrics.where((F.col("authors") == 1) & (F.col("commits") + (F.col("added") + F.col("deleted")) / 10.0 > 0))
