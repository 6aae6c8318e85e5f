"""Weakly connected components of an edge table, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.storage import stored

from .graph import in_one_task

#: Links that are joined up in one task, which then holds some 30 MB; more take the loop, with the same result.
TOGETHER = 1 << 18


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _joined_up(t: pa.Table) -> pa.Table:
    a, b = t.column("a").combine_chunks(), t.column("b").combine_chunks()
    ids = pc.unique(pa.concat_arrays([a, b]))
    ids = ids.take(pc.sort_indices(ids))
    a, b = np.array(pc.index_in(a, ids)), np.array(pc.index_in(b, ids))
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, least[a], low)
        np.minimum.at(new, least[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == least).all():
            return pa.table({"node": ids, "component": ids.take(pa.array(least))})
        least = new


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 50, together: int | None = None) -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; ``component`` is the least node reachable.

    Up to ``together`` (TOGETHER) links, which are counted, are joined up in one task. Of more, each round hangs neighbours on the least node they see (first the larger ones, then the
    smaller ones), so rounds grow with the logarithm of a component's size, and an edge never
    turns into more than one row. State is written to the shared folder in each round. Minima are
    pre-aggregated, and adaptive execution splits a hot node's rows in the joins. Edges with a
    null end are ignored; self-loops give a component of one.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    ends = stored(ends, "ends")
    if ends.count() <= (TOGETHER if together is None else together):
        kind = ends.schema["a"].dataType.simpleString()
        return in_one_task(ends, _joined_up, f"node {kind}, component {kind}")
    nodes = stored(ends.select("a").union(ends.select("b")).distinct(), "nodes")
    links = stored(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        now = _state(links)
        if now == before or not now[0]:
            break
        before = now
        both = links.union(links.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small-star")
    else:
        raise RuntimeError(f"no fixpoint within {rounds} rounds")
    return nodes.join(links.toDF("node", "component"), nodes["a"] == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
