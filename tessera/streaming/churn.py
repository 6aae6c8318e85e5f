"""Windowed churn over a stream of changes: an extension beyond the batch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(changes: DataFrame, late: str = "1 day", width: str = "7 days") -> DataFrame:
    """``changes(path, ts, added, deleted)``, streaming or not, to churn by path and window; rows later than ``late`` behind the newest are dropped in a stream."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", width), "path").agg(F.count("*").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted")).select(F.col("window.start").alias("begin"), "path", "commits", "added", "deleted")
