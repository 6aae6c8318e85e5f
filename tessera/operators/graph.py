"""Dependency graphs as two tables, ``vertices(id, ...)`` and ``edges(src, dst, ...)``, and analytics over them.

Loops keep their state in written tables of the shared folder. Where a graph's checked size lets
it fit in one task (KERNEL_EDGES), PageRank and components run as one kernel there, with the same
result; larger graphs take the loop.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ordering import positioned
from tessera.functions.storage import stored

from . import balls, strong

KERNEL_EDGES = 1_000_000
#: Edges between numbers that one task holds, some 40 bytes each.
NUMBERED_EDGES = 32_000_000
DAMPING, TOLERANCE, ITERATIONS, DIGITS = 0.85, 1e-5, 100, 12
MAX_CYCLES, PER_COMPONENT, MAX_LENGTH = 50, 10, 10
KNOWN_PREFIXES = ("java.", "javax.", "jakarta.", "org.springframework.", "org.apache.", "com.fasterxml.jackson.")


def coalesced(calls: DataFrame, *details: str) -> DataFrame:
    """One edge for each (src, dst): ``call_count``, ``weight`` = log2(1 + calls), and ``details`` (the named columns, sorted) if any are named. Self-loops stay."""
    aggregates = [F.count("*").alias("call_count")]
    if details:
        aggregates.append(F.array_sort(F.collect_list(F.struct(*details))).alias("details"))
    out = calls.groupBy("src", "dst").agg(*aggregates)
    return out.withColumn("weight", F.log(1 + F.col("call_count").cast("double")) / F.log(F.lit(2.0)))


def with_boundary(types: DataFrame, edges: DataFrame) -> DataFrame:
    """All vertices: the declared ``types(id, ...)`` and, for ends of ``edges`` that none declares, boundary rows. Repeated ids count once."""
    declared = types.dropDuplicates(["id"]).withColumn("is_boundary", F.lit(False))
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    missing = ends.join(declared.select("id"), "id", "left_anti").withColumn("is_boundary", F.lit(True))
    return declared.unionByName(missing, allowMissingColumns=True)


def without_boundary(calls: DataFrame, types: DataFrame, prefixes: tuple[str, ...] = KNOWN_PREFIXES) -> DataFrame:
    """``calls`` to declared targets only; those of an undeclared caller go only if its name has a known library prefix."""
    known = types.select(F.col("id").alias("_id")).distinct()
    inside = calls.join(known, F.col("dst") == F.col("_id"), "left_semi")
    foreign = F.lit(False)
    for p in prefixes:
        foreign = foreign | F.col("src").startswith(p)
    outside = inside.where(foreign).join(known, F.col("src") == F.col("_id"), "left_semi")
    return inside.where(~foreign).unionByName(outside)


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, in_degree, out_degree)`` over distinct edges, self-loops included; vertices without edges have zeros."""
    ends = edges.select("src", "dst").distinct()
    ends = ends.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    if vertices is not None:
        ends = ends.union(vertices.select("id", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def in_one_task(df: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over all of ``df`` in one task; callers check its size first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return df.coalesce(1).mapInArrow(kernel, schema)


def _small(edges: DataFrame, limit: int | None) -> bool:
    return edges.count() <= (KERNEL_EDGES if limit is None else limit)


def pagerank(edges: DataFrame, vertices: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, kernel_edges: int | None = None) -> DataFrame:
    """``(id, rank)``: weighted PageRank over all vertices; what dangling vertices hold is spread evenly.

    Stops when no rank moves by ``tolerance`` or more (0: never), at ``iterations`` at the latest.
    ``edges`` may have ``weight``; without it each weighs 1.
    """
    weighted = edges.select("src", "dst", (F.col("weight") if "weight" in edges.columns else F.lit(1.0)).cast("double").alias("weight"))
    ends = weighted.select(F.col("src").alias("id")).union(weighted.select("dst"))
    ids = (ends if vertices is None else ends.union(vertices.select("id"))).distinct()
    weighted, ids = stored(weighted, "weighted"), stored(ids, "ids")
    if _small(weighted, kernel_edges) and _small(ids, kernel_edges):
        both = weighted.select("src", "dst", "weight").union(ids.select("id", F.lit(None).cast(ids.schema["id"].dataType), F.lit(0.0)))
        kind = ids.schema["id"].dataType.simpleString()
        return in_one_task(both, lambda t: _pagerank(t, damping, iterations, tolerance), f"id {kind}, rank double")
    n = ids.count()
    total = weighted.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = stored(weighted.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    ids = stored(ids.join(total.select(F.col("src").alias("id"), F.lit(False).alias("dangling")), "id", "left").select("id", F.coalesce("dangling", F.lit(True)).alias("dangling")), "dangling")
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        loose = ranks.where("dangling").agg(F.sum("rank")).first()[0] or 0.0
        got = ranks.join(shares, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = ranks.join(got, F.col("id") == F.col("dst"), "left").select("id", "dangling", F.col("rank").alias("old"), (F.lit((1 - damping + damping * loose) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        new = stored(new, "ranks")
        moved = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0 if tolerance else 1.0
        ranks = new.drop("old")
        if moved < tolerance:
            break
    return ranks.select("id", "rank")


def _pagerank(t: pa.Table, damping: float, iterations: int, tolerance: float) -> pa.Table:
    src, dst, weight = t.column("src").combine_chunks(), t.column("dst").combine_chunks(), np.array(t.column("weight"))
    only = np.array(dst.is_null())
    ids = pc.unique(src.filter(pa.array(only)))
    a = np.array(pc.index_in(src.filter(pa.array(~only)), ids))
    b = np.array(pc.index_in(dst.filter(pa.array(~only)), ids))
    w, n = weight[~only], len(ids)
    total = np.bincount(a, w, n)
    share, loose, rank = w / total[a], total == 0, np.full(n, 1.0 / n)
    for _ in range(iterations):
        new = (1 - damping + damping * rank[loose].sum()) / n + damping * np.bincount(b, rank[a] * share, n)
        moved, rank = np.abs(new - rank).max(), new
        if moved < tolerance:
            break
    return pa.table({"id": ids, "rank": rank})


def hotspots(ranks: DataFrame, edges: DataFrame, vertices: DataFrame | None = None, one_task: int | None = None) -> DataFrame:
    """Declared vertices by rank: ``position`` from 1 (ties by id; ranks that agree to ``DIGITS`` digits are ties, since the order of sums differs between forms), and ``minmax_score``: 100 (x - min) / (max - min) in [0, 100], 100 where all agree.

    More than ``one_task`` (KERNEL_EDGES) vertices are numbered by ranges; the extremes are a single aggregate.
    """
    rows = ranks
    if vertices is not None and "is_boundary" in vertices.columns:
        rows = rows.join(vertices.where("not is_boundary").select("id"), "id", "left_semi")
    rows = stored(rows, "declared")
    low, high = rows.agg(F.min("rank"), F.max("rank")).first()
    spread = (high or 0.0) - (low or 0.0)
    score = F.lit(100.0) if spread < 1e-9 else F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (F.col("rank") - low) / spread))
    scored = rows.join(degrees(edges), "id", "left").select("id", "rank", score.alias("minmax_score"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))
    return positioned(scored, [F.round("rank", DIGITS).desc(), F.asc("id")], one_task=KERNEL_EDGES if one_task is None else one_task)


def components(edges: DataFrame, vertices: DataFrame | None = None, kernel_edges: int | None = None, block_edges: int | None = None) -> DataFrame:
    """``(id, component, size, self_loop, cyclic)``: strongly connected components named by their least member; cyclic if larger than one. Vertices without edges are components of one.

    Up to KERNEL_EDGES edges, one task searches by name; up to NUMBERED_EDGES one by number; more
    are searched in blocks (:mod:`strong`), with the same result. ``kernel_edges`` replaces both limits.
    """
    ends = stored(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "ends")
    kind = ends.schema["src"].dataType.simpleString()
    if _small(ends, kernel_edges):
        found = in_one_task(ends, _tarjan, f"id {kind}, component {kind}")
    else:
        nodes, links = strong.numbered(ends, strong.BLOCK_EDGES if block_edges is None else block_edges)
        kernel = lambda e: in_one_task(e.select("a", "b"), strong.in_numbers, "n long, component long")
        limit = NUMBERED_EDGES if kernel_edges is None else kernel_edges
        parts = stored(kernel(links), "components") if _small(ends, limit) else strong.in_blocks(nodes, links, limit, kernel)
        least = nodes.select(F.col("n").alias("component"), F.col("id").alias("_least"))
        found = parts.join(nodes.select("n", "id"), "n").join(least, "component").select("id", F.col("_least").alias("component"))
    if vertices is not None:
        alone = vertices.select("id").distinct().join(found.select("id"), "id", "left_anti")
        found = found.union(alone.select("id", F.col("id").alias("component")))
    loops = ends.where("src = dst").select(F.col("src").alias("_loop"))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").join(loops, F.col("id") == F.col("_loop"), "left").select("id", "component", "size", F.col("_loop").isNotNull().alias("self_loop"), (F.col("size") > 1).alias("cyclic"))


def _tarjan(t: pa.Table) -> pa.Table:
    after, ids = defaultdict(list), set()
    for a, b in zip(t.column("src").to_pylist(), t.column("dst").to_pylist(), strict=True):
        after[a].append(b)
        ids |= {a, b}
    index, low, on, stack, place, out = {}, {}, set(), [], {}, []
    for root in sorted(ids):
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        place[root] = len(stack)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    place[w] = len(stack)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = stack[place[v] :]
                    del stack[place[v] :]
                    on.difference_update(members)
                    least = min(members)
                    out += [(m, least) for m in members]
    kind = t.schema.field("src").type
    return pa.table({"id": pa.array([x for x, _ in out], kind), "component": pa.array([c for _, c in out], kind)})


def cycles(edges: DataFrame, include_self_loops: bool = False, total: int = MAX_CYCLES, per_component: int = PER_COMPONENT, length: int = MAX_LENGTH, kernel_edges: int | None = None) -> DataFrame:
    """Elementary cycles of the strongly connected components, within the caps: ``(component, nth, path, length, truncated)``.

    ``path`` is closed (its ends are equal) and starts at its least vertex; opposite directions
    differ. Order: component, start, then depth first through sorted successors. ``truncated``, the
    same in all rows, tells that a cap was reached. Caps are the feature here: enumeration is exponential.
    A component of up to ``kernel_edges`` (KERNEL_EDGES) edges is searched in one task with an early
    stop at its cap; larger ones by joins that extend paths, with the same cycles.
    """
    found = stored(components(edges), "components")
    where = found.where(F.col("cyclic") | (F.col("self_loop") & F.lit(include_self_loops)))
    inside = (
        edges.select("src", "dst").distinct().join(where.select(F.col("id").alias("src"), "component"), "src").join(where.select(F.col("id").alias("dst"), F.col("component").alias("c")), "dst").where("component = c")
    ).select("component", "src", "dst")
    if not include_self_loops:
        inside = inside.where("src <> dst")
    kind = found.schema["id"].dataType.simpleString()

    def search(frame):
        import pandas as pd

        after = defaultdict(list)
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            after[a].append(b)
        for v in after.values():
            v.sort()
        out, cut = [], False
        for start in sorted(after):
            stack, path, on = [iter(after[start])], [start], {start}
            while stack and len(out) < per_component:
                nxt = next((x for x in stack[-1] if x >= start), None)
                if nxt is None:
                    stack.pop()
                    on.discard(path.pop())
                elif nxt == start:
                    out.append([*path, start])
                elif nxt not in on:
                    if len(path) >= length:
                        cut = True
                    else:
                        stack.append(iter(after[nxt]))
                        path.append(nxt)
                        on.add(nxt)
            if len(out) >= per_component:
                cut = True
                break
        c = frame["component"].iloc[0]
        return pd.DataFrame({"component": [c] * len(out), "nth": range(1, len(out) + 1), "path": out, "length": [len(p) - 1 for p in out], "cut": [cut] * len(out)})

    schema, most = f"component {kind}, nth int, path array<{kind}>, length int, cut boolean", KERNEL_EDGES if kernel_edges is None else kernel_edges
    inside = stored(inside, "inside")
    large = [r["component"] for r in inside.groupBy("component").count().where(F.col("count") > most).collect()]  # each has KERNEL_EDGES edges, so they are few
    rows = inside.where(~F.col("component").isin(large)).groupBy("component").applyInPandas(search, schema) if large else inside.groupBy("component").applyInPandas(search, schema)
    for c in large:
        found_here, cut = _large_cycles(inside.where(F.col("component") == F.lit(c)).select("src", "dst"), kind, per_component, length)
        rows = rows.union(edges.sparkSession.createDataFrame([(c, i + 1, x, len(x) - 1, cut) for i, x in enumerate(found_here)], schema))
    rows = stored(rows, "cycles")
    n, cut = rows.agg(F.count("*"), F.coalesce(F.max("cut"), F.lit(False))).first()
    return rows.orderBy("component", "nth").limit(total).select("component", "nth", "path", "length", F.lit(bool(cut or n >= total)).alias("truncated"))


def _large_cycles(edges: DataFrame, kind: str, count: int, length: int, starts: int = 256, width: int = 100_000) -> tuple[list[list], bool]:
    """The first ``count`` cycles of one component in the order of :func:`cycles`, and whether a cap was met.

    Depth-first order is that of the closed paths, compared vertex by vertex. Some starts at a time,
    least first, all their simple paths grow together by joins; of more than ``width`` paths the
    least go on, and cycles beyond the first path dropped don't count. If those before it are too
    few, the same starts are taken again with more paths, then one at a time.
    """
    spark, out, cut, after = edges.sparkSession, [], False, None
    while len(out) < count:
        left = edges if after is None else edges.where(F.col("src") > F.lit(after))
        some = [r[0] for r in left.select("src").distinct().orderBy("src").limit(starts).collect()]
        if not some:
            break
        open_ = spark.createDataFrame([([x],) for x in some], f"path array<{kind}>")
        closed, dropped, deep = [], None, False
        for n in range(1, length + 1):
            grown = open_.join(edges, F.element_at("path", -1) == F.col("src")).where(F.col("dst") >= F.col("path").getItem(0))
            grown = stored(grown.select(F.concat("path", F.array("dst")).alias("path"), (F.col("dst") == F.col("path").getItem(0)).alias("closed"), F.array_contains("path", F.col("dst")).alias("again")), "paths")
            closed += [list(r["path"]) for r in grown.where("closed").orderBy("path").limit(count).collect()]
            longer = grown.where("not again")
            if n == length:
                deep = not longer.isEmpty()
                break
            kept = longer.orderBy("path").limit(width + 1)
            kept = stored(kept, "kept")
            if kept.count() > width:
                last = list(kept.agg(F.max("path")).first()[0])
                dropped = last if dropped is None else min(dropped, last)
                kept = kept.where(F.col("path") < F.array(*map(F.lit, last)))
            open_ = kept.select("path")
            if open_.isEmpty():
                break
        good = sorted(c for c in closed if dropped is None or c < dropped)[: count - len(out)]
        if dropped is not None and len(out) + len(good) < count:
            starts, width = (1, width) if len(some) > 1 else (1, width * 8)
            continue
        out += good
        cut, after = cut or deep or dropped is not None, some[-1]
    return out, cut or len(out) >= count


def steps(edges: DataFrame, forward: bool = False) -> DataFrame:
    """``(_at, _next)``: each vertex and its callers, or what it calls, if ``forward``; once each, without self-loops."""
    step = edges.select(F.col("dst").alias("_at"), F.col("src").alias("_next")) if not forward else edges.select(F.col("src").alias("_at"), F.col("dst").alias("_next"))
    return step.where("_at <> _next").distinct()


def reach(edges: DataFrame, targets: DataFrame, depth: int = 10, forward: bool = False) -> DataFrame:
    """``(target, id, depth)``: the least number of calls from each vertex to each of ``targets(target)`` (from it, if ``forward``), up to ``depth``; a target isn't its own caller."""
    step = steps(edges, forward)
    limit = depth if depth > 0 else 10
    known = step.select("_at").union(step.select("_next")).distinct()
    frontier = targets.select("target").distinct().join(known, F.col("target") == F.col("_at"), "left_semi").withColumn("id", F.col("target")).withColumn("depth", F.lit(0))
    seen = frontier = stored(frontier, "reach")
    for d in range(1, limit + 1):
        new = frontier.join(step, F.col("id") == F.col("_at")).select("target", F.col("_next").alias("id")).distinct()
        frontier = stored(new.join(seen.select("target", "id"), ["target", "id"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def impact(reached: DataFrame, scores: DataFrame, default: float = 0.01) -> DataFrame:
    """For each target of :func:`reach`: ``direct`` callers, ``total``, and ``risk``: the sum of score / 2 ** (depth - 1), ``default`` for vertices without a score."""
    joined = reached.join(scores.select(F.col("id").alias("_id"), "score"), F.col("id") == F.col("_id"), "left")
    return joined.groupBy("target").agg(
        F.count(F.when(F.col("depth") == 1, 1)).alias("direct"),
        F.count("*").alias("total"),
        F.sum(F.coalesce("score", F.lit(default)) / F.pow(F.lit(2.0), F.col("depth") - 1)).alias("risk"),
    )


def is_test(name: Column) -> Column:
    """Whether a fully qualified type is a test by its name or package."""
    return F.element_at(F.split(name, r"\."), -1).rlike("(Test|Tests|IT|TestCase)$") | name.contains(".test.")


def lookup(vertices: DataFrame, name: str) -> str | None:
    """The vertex with that id, else the least of those with that simple name."""
    found = vertices.where((F.col("id") == name) | (F.col("simple_name") == name)).agg(F.max(F.when(F.col("id") == name, F.col("id"))), F.min("id")).first()
    return found[0] or found[1]


def shortest_path(edges: DataFrame, start: str, goal: str, max_hops: int = 10) -> DataFrame:
    """``(hop, src, dst, call_count)`` of the shortest call path, the lexicographically least of several; no rows if there is none within ``max_hops`` or the ends agree.

    Each vertex that is reached keeps the least of the shortest paths to it, which is the least of
    those to its predecessors and itself; so the goal's is the answer, and nothing goes to the driver
    but that one path.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    step = edges.select("src", "dst").where("src <> dst").distinct()
    frontier = reached = stored(spark.createDataFrame([(start, [start])], f"id {kind}, path array<{kind}>"), "path")
    found = None
    for _ in range(max_hops if start != goal else 0):
        new = frontier.join(step, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        frontier = stored(new.join(reached.select("id"), "id", "left_anti").select("id", F.concat("path", F.array("id")).alias("path")), "path")
        found = frontier.where(F.col("id") == F.lit(goal)).first()
        if found or frontier.isEmpty():
            break
        reached = reached.union(frontier)
    path = list(found["path"]) if found else []
    hops = spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(zip(path, path[1:], strict=False))], f"hop int, src {kind}, dst {kind}")
    counts = edges if "call_count" in edges.columns else edges.withColumn("call_count", F.lit(1).cast("long"))
    return hops.join(counts.select("src", "dst", "call_count"), ["src", "dst"]).select("hop", "src", "dst", "call_count").orderBy("hop")


def weakest_links(found: DataFrame, edges: DataFrame) -> DataFrame:
    """For each cycle of :func:`cycles` its edge with the fewest calls, the first of several: ``(component, nth, src, dst, call_count)``."""
    hop = found.select("component", "nth", "path", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "src")).withColumn("dst", F.element_at("path", F.col("i") + 2))
    ranked = hop.join(edges.select("src", "dst", "call_count"), ["src", "dst"])
    return ranked.groupBy("component", "nth").agg(F.min(F.struct("call_count", "i", "src", "dst")).alias("m")).select("component", "nth", "m.src", "m.dst", "m.call_count")


def instability(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, in_degree, out_degree, instability)``: outgoing over all edges, 0 without any; self-loops left out."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    rows = degrees(edges.where("src <> dst"), (ids if vertices is None else ids.union(vertices.select("id"))).distinct())
    n = F.col("in_degree") + F.col("out_degree")
    return rows.withColumn("instability", F.when(n == 0, 0.0).otherwise(F.col("out_degree") / n))


def radius(edges: DataFrame, targets: DataFrame, depth: int = 4, classes: int | None = None, direction: str = "in", kernel_edges: int | None = None) -> DataFrame:
    """How much of the graph lies within ``depth`` calls of each target: ``(target, reached, percent, band)``.

    ``direction``: "in" (what calls it), "out" (what it calls) or "both". ``classes`` is the number
    of all classes, the ends of edges if not given; the target itself isn't counted. A target that
    nothing reaches has 0.

    Up to ``kernel_edges`` (HELD_EDGES) edges, tasks that hold the graph count without a row for
    each pair, of which a vertex that many call makes as many as their square; larger graphs take
    :func:`reach`.
    """
    ends = edges.select("src", "dst")
    n = classes or ends.select("src").union(ends.select("dst")).distinct().count()
    ends = ends.union(ends.select("dst", "src")) if direction == "both" else ends
    step = stored(steps(ends, direction == "out"), "step")
    if step.count() <= (balls.HELD_EDGES if kernel_edges is None else kernel_edges):
        nodes, links = balls.in_numbers(step)
        asked = targets.select("target").distinct().join(nodes.withColumnRenamed("id", "target"), "target").select(F.col("n").alias("a"), F.col("n").alias("b"))
        found = balls.searched(links, asked, asked.count(), balls.sizes(depth if depth > 0 else 10), "n long, reached long")
        counts = found.join(nodes, "n").select(F.col("id").alias("target"), "reached")
    else:
        counts = reach(ends, targets, depth, forward=direction == "out").groupBy("target").agg(F.count("*").alias("reached"))
    rows = targets.select("target").distinct().join(counts, "target", "left").select("target", F.coalesce("reached", F.lit(0)).alias("reached"))
    rows = rows.withColumn("percent", 100.0 * F.col("reached") / F.lit(float(max(1, n - 1))))
    return rows.withColumn("band", F.when(F.col("percent") >= 60, "Critical").when(F.col("percent") >= 30, "Wide").when(F.col("percent") >= 10, "Moderate").otherwise("Contained"))


def method_edges(invocations: DataFrame) -> DataFrame:
    """The graph of methods, ``(src, dst, call_count, line)``, from calls between types: vertices are ``Type.method``; calls outside a method are of ``(init)``. ``line``: of the first call."""
    name = lambda owner, method, other: F.concat_ws(".", owner, F.when(F.coalesce(F.col(method), F.lit("")) == "", other).otherwise(F.col(method)))
    rows = invocations.select(name("caller", "caller_method", "(init)").alias("src"), name("target", "method", "(call)").alias("dst"), "line")
    return rows.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("call_count"), F.min("line").alias("line"))


def caller_tree(edges: DataFrame, target: str, depth: int = 3) -> DataFrame:
    """All call paths that end in ``target``, up to ``depth`` calls long, no vertex twice on a path: ``(depth, id, path)``, in the order of a printed tree.

    The number of paths grows with the depth's power, so this is for a report on one type.
    """
    spark = edges.sparkSession
    step = edges.select("src", "dst").distinct()
    kind = edges.schema["dst"].dataType.simpleString()
    frontier = spark.createDataFrame([(0, target, [target])], f"depth int, id {kind}, path array<{kind}>")
    out = None
    for d in range(1, depth + 1):
        grown = frontier.join(step, F.col("id") == F.col("dst")).where(~F.array_contains("path", F.col("src")))
        frontier = stored(grown.select(F.lit(d).alias("depth"), F.col("src").alias("id"), F.concat("path", F.array("src")).alias("path")), "tree")
        out = frontier if out is None else out.union(frontier)
        if frontier.isEmpty():
            break
    return out.orderBy("path")


def top_neighbours(edges: DataFrame, count: int = 8) -> DataFrame:
    """The ``count`` callees of each vertex with most calls: ``(src, dst, call_count, position, remainder, two_way)``; ``remainder``: how many more there are."""
    w = Window.partitionBy("src")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("two_way"))
    rows = edges.where("src <> dst").join(back, ["src", "dst"], "left")
    rows = rows.withColumn("position", F.row_number().over(w.orderBy(F.desc("call_count"), "dst"))).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("position") <= count).select("src", "dst", "call_count", "position", F.greatest(F.col("n") - count, F.lit(0)).alias("remainder"), F.coalesce("two_way", F.lit(False)).alias("two_way"))
