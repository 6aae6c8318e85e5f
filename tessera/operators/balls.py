"""How much lies within some calls of many vertices, counted without a row for each pair.

The graph, in numbers and packed as bytes, goes whole to each of as many tasks as there are cores, and
each searches from its share of the vertices. Callers check that it has at most HELD_EDGES.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import by_range, with_start
from tessera.functions.storage import stored

#: Edges that a task holds: 4 bytes each and 8 a vertex, twice while they are put together.
HELD_EDGES = 64_000_000
#: Neighbours from which a vertex of the last step is counted by the size of its row instead of listed.
HEAVY = 64
#: Vertices to search from that are worth a task of their own.
WORTH = 2_000
PIECE = "kind int, first long, second long, a binary, b binary"
GRAPH, ASKED, SCORE = 0, 1, 2


def named(column, source: DataFrame, name: str, number: str = "n") -> DataFrame:
    """``(name, number)``: the distinct values of ``source(column)``, numbered from 0 in their order."""
    order = [F.col(name)]
    rows = with_start(by_range(source.select(F.col(column).alias(name)).distinct(), order, "names"), order, F.lit(1), number)
    return stored(rows.select(name, number), "numbers")


def _pieces(df: DataFrame, kind: int, b_type: str = "int32") -> DataFrame:
    """``df(a, b)``, whose order within its tasks stays, as rows of packed arrays; of a graph, ``a`` holds each vertex once and then how many edges it has there."""
    made = pa.schema([("kind", pa.int32()), ("first", pa.int64()), ("second", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                first, second = int(a[0]), int(b[0]) if kind == GRAPH else 0
                if kind == GRAPH:
                    a = np.concatenate(np.unique(a, return_counts=True))
                yield pa.RecordBatch.from_pylist([{"kind": kind, "first": first, "second": second, "a": a.astype(np.int32).tobytes(), "b": b.astype(b_type).tobytes()}], schema=made)

    return df.select("a", "b").mapInArrow(run, PIECE)


def in_numbers(step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, n)`` of the ends of ``step(_at, _next)``, and its rows as numbers ``(a, b)``."""
    nodes = named("id", step.select(F.explode(F.array("_at", "_next")).alias("id")), "id")
    links = step.join(nodes.select(F.col("id").alias("_at"), F.col("n").alias("a")), "_at").join(nodes.select(F.col("id").alias("_next"), F.col("n").alias("b")), "_next")
    return nodes, links.select("a", "b")


def searched(step: DataFrame, asked: DataFrame, many: int, run: Callable[[dict], Iterator[pa.RecordBatch]], schema: str, scores: DataFrame | None = None) -> DataFrame:
    """``run`` in tasks that each hold all of ``step(a, b)``, distinct numbers, and a share of ``asked(a, b)``, of which there are ``many``; rows of one ``b`` stay together."""
    spark = step.sparkSession
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-many // WORTH)))
    order = [F.col("a"), F.col("b")]
    graph = _pieces(step.repartitionByRange(*order).sortWithinPartitions(*order), GRAPH)
    whole = graph if scores is None else graph.union(_pieces(scores, SCORE, "float64"))
    every = stored(whole, "packed").crossJoin(F.broadcast(spark.range(tasks).toDF("task")))
    dealt = asked.withColumn("task", F.pmod(F.hash("b"), F.lit(tasks)).cast("long")).repartition(tasks, "task")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, t = (batch.column(c).to_numpy() for c in ("a", "b", "task"))
            for k in np.unique(t):
                yield pa.RecordBatch.from_pydict({"kind": pa.array([ASKED], pa.int32()), "first": pa.array([0], pa.int64()), "second": pa.array([0], pa.int64()), "a": [a[t == k].astype(np.int32).tobytes()], "b": [b[t == k].astype(np.int32).tobytes()], "task": pa.array([k], pa.int64())})

    parts = every.select("kind", "first", "second", "a", "b", "task").union(dealt.select("a", "b", "task").mapInArrow(share, PIECE + ", task long"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAPH: [], ASKED: [], SCORE: []}
        only = None
        for batch in batches:
            for r in batch.to_pylist():
                only = r["task"] if only is None else only
                if r["kind"] == ASKED or r["task"] == only:  # shares of two tasks may meet in one; the graph is the same
                    held[r["kind"]].append((r["first"], r["second"], r["a"], r["b"]))
        if held[ASKED]:
            yield from run(_assembled(held))

    return parts.repartitionByRange(tasks, "task").mapInArrow(work, schema)


def _assembled(held: dict[int, list]) -> dict:
    """The graph as the beginnings of its rows and their ascending ends, the share as arrays, scores by vertex."""
    join = lambda kind, i, t="int32": np.frombuffer(b"".join(x[i] for x in held[kind]), t)
    held[GRAPH].sort(key=lambda x: x[:2])
    asked, group, after = join(ASKED, 2), join(ASKED, 3), join(GRAPH, 3)
    heads = [np.frombuffer(x[2], np.int32).reshape(2, -1) for x in held[GRAPH]]
    held[GRAPH].clear()
    n = 1 + max((int(x.max()) for x in (*[v for v, _ in heads], after, asked) if len(x)), default=-1)
    start = np.zeros(n + 1, np.int64)
    for v, count in heads:
        start[v + 1] += count  # each vertex is once in a piece
    np.cumsum(start, out=start)
    out = {"n": n, "start": start, "after": after, "asked": asked, "group": group}
    if held[SCORE]:
        out["score"] = join(SCORE, 2), join(SCORE, 3, "float64")
    return out


def sizes(depth: int) -> Callable[[dict], Iterator[pa.RecordBatch]]:
    """For each vertex asked, how many others lie within ``depth`` steps: ``(n, reached)``.

    In the last step, the rows of heavy vertices aren't listed: one is counted by its length and what of it
    was seen before; only where several meet is their union made.
    """

    def run(held: dict) -> Iterator[pa.RecordBatch]:
        start, after = memoryview(held["start"]), memoryview(held["after"])

        def size(t: int) -> int:
            seen = {t}
            front = [t]
            for _ in range(depth - 1):
                found = set()
                for u in front:
                    found.update(after[start[u] : start[u + 1]].tolist())
                found -= seen
                seen |= found
                front = found
            heavy = []
            for u in front:
                i, j = start[u], start[u + 1]
                if j - i > HEAVY:
                    heavy.append((i, j))
                else:
                    seen.update(after[i:j].tolist())
            if len(heavy) == 1:
                i, j = heavy[0]
                row, mine = held["after"][i:j], np.fromiter(seen, np.int32, len(seen))
                at = np.searchsorted(row, mine)
                at[at == j - i] = 0
                return len(seen) + j - i - int((row[at] == mine).sum()) - 1
            if heavy:
                return len(np.unique(np.concatenate([np.fromiter(seen, np.int32, len(seen)), *[held["after"][i:j] for i, j in heavy]]))) - 1
            return len(seen) - 1

        asked = held["asked"].tolist()
        for k in range(0, len(asked), 10_000):
            some = asked[k : k + 10_000]
            yield pa.RecordBatch.from_pydict({"n": pa.array(some, pa.int64()), "reached": pa.array([size(t) for t in some], pa.int64())})

    return run


def _rows(start: np.ndarray, after: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The ends in the rows of all of ``of``, one after another."""
    many = start[of + 1] - start[of]
    return after[np.repeat(start[of] - np.cumsum(many) + many, many) + np.arange(many.sum())]


def by_group(depth: int, default: float, shared_from: int) -> Callable[[dict], Iterator[pa.RecordBatch]]:
    """For each group of vertices asked: callers at distance 1, farther ones, the greatest distance, the sum of score / 2 ** (distance - 1), and whether a vertex has ``shared_from`` direct callers.

    A caller counts at its least distance to a vertex of the group other than itself, so each keeps the two nearest of them.
    """

    def run(held: dict) -> Iterator[pa.RecordBatch]:
        start, after, asked, group, n = (held[x] for x in ("start", "after", "asked", "group", "n"))
        score = np.full(n, default)
        if "score" in held:
            at, value = held["score"]
            score[at[at < n]] = value[at < n]
        for g in np.unique(group):
            some = np.unique(asked[group == g])
            # (vertex, source) pairs; a vertex needs at most two sources, the nearest but itself being one of them
            at, of, known = some, some, some.astype(np.int64) * n + some
            most = int((start[some + 1] - start[some]).max(initial=0))
            near, all_at, all_of = [], some, some
            for d in range(1, depth + 1):
                many = start[at + 1] - start[at]
                to, source = _rows(start, after, at), np.repeat(of, many)
                pair = np.unique(to.astype(np.int64) * n + source)
                pair = pair[~np.isin(pair, known, assume_unique=True)]
                at, of = (pair // n).astype(np.int32), (pair % n).astype(np.int32)
                # of the sources new at this distance the first two, unless two nearer ones are held
                nth = np.arange(len(at)) - np.searchsorted(at, at) + _held(all_at, at)
                keep = nth < 2
                at, of = at[keep], of[keep]
                if not len(at):
                    break
                all_at, all_of = np.concatenate([all_at, at]), np.concatenate([all_of, of])
                known = np.unique(all_at.astype(np.int64) * n + all_of)
                near.append((d, np.unique(at[at != of])))
            direct = far = deepest = 0
            risk, done = 0.0, np.zeros(0, np.int32)
            for d, found in near:
                new = found[~np.isin(found, done, assume_unique=True)]
                done = np.concatenate([done, new])
                direct, far = (direct + len(new), far) if d == 1 else (direct, far + len(new))
                deepest = d if len(new) else deepest
                risk += float(score[new].sum()) / 2.0 ** (d - 1)
            yield pa.RecordBatch.from_pydict({"g": pa.array([g], pa.int64()), "direct": [direct], "transitive_only": [far], "reachable": [direct + far], "max_depth": pa.array([deepest], pa.int32()), "cumulative_risk": [risk], "shared_utility": [most >= shared_from]})

    return run


def _held(all_at: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each of ``at`` is in ``all_at``."""
    ordered = np.sort(all_at)
    return np.searchsorted(ordered, at, "right") - np.searchsorted(ordered, at, "left")
