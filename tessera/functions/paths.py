"""Paths that are the same or end one another, joined on whole ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """``path`` with forward slashes and one before it."""
    return F.concat(F.lit("/"), F.regexp_replace(path, r"\\", "/"))


def ends(path: Column) -> Column:
    """All ends of a slashed path that begin with a slash, the longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/")))


def covered(paths: DataFrame, others: DataFrame) -> DataFrame:
    """Of ``paths(_p)``, slashed and not null, those that equal one of ``others(_f)`` or of which one ends with the other.

    Joins are on whole ends, a few for each path, so a file name that many paths share is no hot
    key: of all paths below it, each end is looked for once.
    """
    own, given = paths.select("_p").where("_p is not null").distinct(), others.select("_f").where("_f is not null").distinct()
    longer = own.select("_p", F.explode(ends(F.col("_p"))).alias("_f")).join(given, "_f", "left_semi").select("_p")
    shorter = own.join(given.select(F.explode(ends(F.col("_f"))).alias("_p")).distinct(), "_p", "left_semi")
    return longer.union(shorter).distinct()
