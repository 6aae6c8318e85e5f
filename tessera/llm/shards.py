"""Sharding by longest-processing-time scheduling of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ordering import by_range, with_start
from tessera.functions.storage import stored

from .common import bounded, table

#: Sizes whose runs may be broadcast: some 0.3 kB each.
RUNS = 1 << 16


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Longest processing time first: ``(unit, size)`` pairs to shards through a heap of loads.

    Ties in size go by unit, ties in load by shard, so the result is a function of the input.
    """
    heap = [(0, shard) for shard in range(shards)]
    out = {}
    for unit, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        out[unit] = shard
        heapq.heappush(heap, (load + size, shard))
    return out


def runs(size: int, count: int, heap: list[tuple[int, int]]) -> list[tuple[int, list[int]]]:
    """Where the scheduler puts ``count`` units of one size, as ``(n, shards)``: the next n units go to those shards in turn.

    ``heap`` holds ``(load, shard)`` and is brought up to date. Shards that have been filled to one
    level take equal units in turn until the next fuller shard is as empty as they are; so there
    are no more runs than shards, however many the units, and each unit is where a heap step of
    its own would put it.
    """
    turn, out = [heapq.heappop(heap)], []
    while count:
        many = count
        if heap:
            level, other = heap[0]
            many = sum(-(-(level - load) // size) + ((level - load) % size == 0 and shard < other) for load, shard in turn)
        n = min(many, count)
        if n:
            out.append((n, [shard for _, shard in turn]))
        each, more = divmod(n, len(turn))
        turn = [(load + size * (each + (i < more)), shard) for i, (load, shard) in enumerate(turn)]
        count -= n
        if count:
            turn.append(heapq.heappop(heap))
        turn.sort()
    for x in turn:
        heapq.heappush(heap, x)
    return out


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every row of ``docs`` a shard and a slot; rows of equal text form a group that is never split.

    Returns the id column and ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``shard``, ``slot``
    (gapless from 0 in each shard, by id). The law is ``bytes``: shard sizes are near equal.

    Groups, the largest first and of equal ones that of the lesser SHA-256, go to the least-loaded
    shard; a group larger than a fair share makes its shard larger, since it can't be split. Where
    a group goes depends on its size and its number among those of its size alone. So the driver
    schedules sizes with their counts, and groups are numbered by ranges. D different sizes take
    D * (D + 1) / 2 bytes of text at least, so the driver sees the square root of twice the input's
    bytes at most.

    A null text counts as an empty one (size 1, crc32 0, one group with the empty texts). Repeated
    rows keep their own slots. An empty table gives no rows; extra columns are dropped.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    spark = docs.sparkSession
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("_group"),
        ),
        "shard-rows",
    )
    order = [F.col("_bytes").desc(), F.col("_group")]
    groups = by_range(rows.groupBy("_group").agg(F.sum("size").alias("_bytes")), order, "shard-groups")
    sizes = groups.groupBy("_bytes").agg(F.count("*").alias("n")).toArrow().sort_by([("_bytes", "descending")])
    heap, first, placed = [(0, shard) for shard in range(shards)], 0, []
    for size, n in zip(sizes.column("_bytes").to_pylist(), sizes.column("n").to_pylist(), strict=True):
        at, turns = 0, []
        for many, turn in runs(size, n, heap):
            turns.append({"start": at, "stop": at + many, "turn": turn})
            at += many
        placed.append((size, first, turns))
        first += n
    turns = stored(spark.createDataFrame(placed, "_size long, _first long, _turns array<struct<start:long,stop:long,turn:array<int>>>"), "shard-turns")
    nth = F.col("_nth") - F.col("_first")
    mine = F.filter("_turns", lambda t: (t["start"] <= nth) & (nth < t["stop"]))[0]
    scheduled = with_start(groups, order, F.lit(1), "_nth").join(bounded(turns, RUNS), F.col("_bytes") == F.col("_size"))
    shard_of = stored(scheduled.select("_group", F.get(mine["turn"], ((nth - mine["start"]) % F.size(mine["turn"])).cast("int")).alias("shard")), "shard-placed")
    keys = [F.col("shard"), F.col("_id"), F.col("text_crc32")]
    ordered = by_range(rows.join(shard_of, "_group").select("_id", "size", "text_crc32", "shard"), keys, "shard-order")
    starts, begin = [], 0
    for r in sorted(ordered.groupBy("shard").count().collect()):
        starts.append((r["shard"], begin))
        begin += r["count"]
    starts = spark.createDataFrame(starts, "shard int, _start long")  # a row for each shard
    ranked = with_start(ordered, keys, F.lit(1), "_rank").join(F.broadcast(starts), "shard")
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", (F.col("_rank") - F.col("_start")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``docs`` with their shard and slot under ``path``, one folder for each shard.

    The id must be unique and not null here, because shards are joined back by it: rows that
    repeat an id would multiply, those without one are left out. Columns ``shard`` and ``slot`` are
    replaced, others stay; an empty table writes no shard.
    """
    placed = assign(docs, shards, id_col=id_col, text_col=text_col).select(id_col, "shard", "slot")
    docs.drop("shard", "slot").join(placed, id_col).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in eight shards of near equal bytes; nulls, repeated rows and an empty table as in :func:`assign`, columns besides ``doc_id`` and ``text`` aren't read."""
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard")
    )
