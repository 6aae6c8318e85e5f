"""Strongly connected components of graphs too large for names in one task: vertices become numbers, and the graph is one compact kernel or blocks that exchange messages."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ordering import by_range, with_start
from tessera.functions.storage import discarded, stored

#: Edges of a block, of which a task holds about 100 bytes each.
BLOCK_EDGES = 2_000_000
NONE = (1 << 63) - 1
LABELS = "block int, n long, label long, kind int"


def numbered(ends: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``(id, n, block)`` of the vertices, numbered from 0 in the order of their ids, and ``(a, b, ablock, bblock)`` of the edges. A block has about ``2 * size`` ends of edges."""
    each = ends.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("ends"))
    order = [F.col("id")]
    ranged = with_start(by_range(each, order, "ends"), order, F.lit(1), "n")
    nodes = with_start(ranged, order, F.col("ends"), "before")
    nodes = stored(nodes.select("id", "n", F.floor(F.col("before") / F.lit(2 * size)).cast("int").alias("block")), "numbers")
    edges = ends.join(nodes.select(F.col("id").alias("src"), F.col("n").alias("a"), F.col("block").alias("ablock")), "src")
    edges = edges.join(nodes.select(F.col("id").alias("dst"), F.col("n").alias("b"), F.col("block").alias("bblock")), "dst")
    return nodes, stored(edges.select("a", "b", "ablock", "bblock"), "numbered")


def _following(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the successors of each vertex begin, and all of them."""
    start = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(a, minlength=n), out=start[1:])
    return start, b[np.argsort(a, kind="stable")]


def in_numbers(t: pa.Table) -> pa.Table:
    """``(a, b)`` to ``(n, component)``: one depth-first search over arrays, some 40 bytes an edge; components are named by their least member."""
    ends = [np.concatenate([np.asarray(c) for c in t.column(x).chunks] or [np.zeros(0, np.int64)]) for x in ("a", "b")]
    del t
    ids = np.unique(np.concatenate([np.unique(x) for x in ends]))
    n = len(ids)
    start, after = _following(*[np.searchsorted(ids, x).astype(np.int32) for x in ends], n)
    del ends
    place, end, after = array("q", start[:-1].tobytes()), memoryview(start[1:].copy()), memoryview(after)
    index, low, part = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", [-1]) * n
    seen, stack = 0, []
    for root in range(n):
        if index[root]:
            continue
        work = [root]
        while work:
            v = work[-1]
            if not index[v]:
                seen += 1
                index[v] = low[v] = seen
                stack.append(v)
            p, e, least = place[v], end[v], low[v]
            while p < e:
                w = after[p]
                p += 1
                i = index[w]
                if not i:
                    work.append(w)
                    break
                if i < least and part[w] < 0:
                    least = i
            place[v], low[v] = p, least
            if work[-1] != v:
                continue
            work.pop()
            if work and least < low[work[-1]]:
                low[work[-1]] = least
            if least == index[v]:
                k = len(stack) - 1
                while stack[k] != v:
                    k -= 1
                name = min(stack[k:])
                for w in stack[k:]:
                    part[w] = name
                del stack[k:]
    return pa.table({"n": ids, "component": ids[np.frombuffer(part, np.int32)] if n else ids})


def _step(edges: pa.Table, state: pa.Table) -> pa.Table:
    """One block: take the messages in, let the least labels run along its own edges to the end, send what changed to other blocks."""
    kind, n, label = (state.column(c).to_numpy() for c in ("kind", "n", "label"))
    own = kind == 0
    order = np.argsort(n[own])
    ids, old = n[own][order], label[own][order]
    a, b, block = (edges.column(c).to_numpy() for c in ("a", "b", "bblock"))
    here = state.column("block")[0].as_py()
    inner = block == here
    start, after = _following(np.searchsorted(ids, a[inner]), np.searchsorted(ids, b[inner]), len(ids))
    start, after, new = start.tolist(), after.tolist(), old.tolist()
    first = np.argsort(label[~own], kind="stable")
    # least labels first, so that each vertex changes at most once
    for v, x in zip(np.searchsorted(ids, n[~own][first]).tolist(), label[~own][first].tolist(), strict=True):
        if x < new[v]:
            new[v], stack = x, [v]
            while stack:
                u = stack.pop()
                for w in after[start[u] : start[u + 1]]:
                    if x < new[w]:
                        new[w] = x
                        stack.append(w)
    new = np.array(new, np.int64)
    at = np.searchsorted(ids, a[~inner])
    sent = (new != old)[at]
    to, goal, value = block[~inner][sent], b[~inner][sent], new[at[sent]]
    order = np.lexsort((value, goal))
    to, goal, value = to[order], goal[order], value[order]
    only = np.ones(len(goal), bool)
    only[1:] = goal[1:] != goal[:-1]
    columns = [np.concatenate(x) for x in ((np.full(len(ids), here, np.int32), to[only]), (ids, goal[only]), (new, value[only]), (np.zeros(len(ids), np.int32), np.ones(only.sum(), np.int32)))]
    return pa.table(dict(zip(("block", "n", "label", "kind"), columns, strict=True)))


def spread_least(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(n, block, label)``: for each vertex of ``start(n, block, label)`` the least label of those that reach it by ``edges(a, b, ablock, bblock)``; NONE is no label.

    Rounds grow with the edges between blocks on a way, not with its length, and only blocks with new messages work in a round.
    """
    edges = stored(edges.select(F.col("ablock").alias("block"), "a", "b", "bblock").repartitionByRange("block"), "block-edges")
    first = stored(start.select("block", "n", F.lit(NONE).alias("label"), F.lit(0).alias("kind")).union(start.where(F.col("label") < NONE).select("block", "n", "label", F.lit(1))), "labels")
    held: dict[int, DataFrame] = {}
    mail, active = first, sorted(r[0] for r in first.select("block").distinct().collect())
    held = dict.fromkeys(active, first)

    def state(blocks: list[int]) -> DataFrame:
        tables: dict[int, tuple[DataFrame, list[int]]] = {}
        for k in blocks:
            tables.setdefault(id(held[k]), (held[k], []))[1].append(k)
        parts = [t.where((F.col("kind") == 0) & F.col("block").isin(which)) for t, which in tables.values()]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    waiting = set(active)
    while waiting:
        now = sorted(waiting)
        given = state(now).union(mail.where("kind = 1"))
        out = edges.where(F.col("block").isin(now)).groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_step, LABELS)
        old, mail = mail, stored(out, "labels")
        for k in now:
            held[k] = mail
        if all(t is not old for t in held.values()):
            discarded(old)
        waiting = {r[0] for r in mail.where("kind = 1").select("block").distinct().collect()}
    return state(sorted(held)).select("n", "block", "label") if held else start


def priority(n: Column, seed: int) -> Column:
    """A number for each vertex that no other has, in no order that a graph has: shifts and exclusive ors, which can be undone."""
    x = (n + 1).bitwiseXOR(F.lit(seed))
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def in_blocks(nodes: DataFrame, edges: DataFrame, limit: int, kernel) -> DataFrame:
    """``(n, component)`` of :func:`numbered`, by colours: each vertex takes the least priority that reaches it, and what reaches that vertex back is its component.

    Edges between colours are dropped. Priorities are new in each round and follow no order of the graph, so rounds are expected to
    grow with the logarithm of the vertices. Once ``limit`` edges are left, ``kernel`` joins them up.
    """
    alive = nodes.select("n", "block")
    left, done, seed = edges.where("a <> b"), [], 0
    while True:
        both = left.select(F.col("a").alias("n"), F.col("ablock").alias("block")).distinct().join(left.select(F.col("b").alias("n")).distinct(), "n", "left_semi")
        inner = stored(both.select("n", "block"), "inner")
        done.append(alive.join(inner, "n", "left_anti").select("n", F.col("n").alias("component")))  # no cycle holds what nothing calls or what calls nothing
        left = stored(left.join(inner.select(F.col("n").alias("a")), "a", "left_semi").join(inner.select(F.col("n").alias("b")), "b", "left_semi"), "left")
        if left.count() <= limit:
            found = kernel(left)
            done += [found, inner.join(found.select("n"), "n", "left_anti").select("n", F.col("n").alias("component"))]
            break
        seed += 0x9E3779B97F4A
        own = priority(F.col("n"), seed)
        colours = spread_least(left, inner.withColumn("label", own))
        same = left.join(colours.select(F.col("n").alias("a"), F.col("label").alias("_a")), "a").join(colours.select(F.col("n").alias("b"), F.col("label").alias("_b")), "b").where("_a = _b")
        same = stored(same.select("a", "b", "ablock", "bblock"), "same")
        roots = colours.withColumn("label", F.when(F.col("label") == own, F.col("label")).otherwise(F.lit(NONE)))
        back = spread_least(same.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("bblock").alias("ablock"), F.col("ablock").alias("bblock")), roots)
        members = stored(back.where(F.col("label") < NONE).select("n", "label"), "members")
        done.append(members.join(members.groupBy("label").agg(F.min("n").alias("component")), "label").select("n", "component"))
        left = same.join(members.select(F.col("n").alias("a")), "a", "left_anti").join(members.select(F.col("n").alias("b")), "b", "left_anti")
        alive = inner.join(members.select("n"), "n", "left_anti")
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return stored(out, "components")
