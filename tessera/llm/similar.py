"""Near copies by the similarity of their word shingles: SimHash candidates first, then an exact join behind a prefix filter.

Fingerprints that the pigeonring index links at few bits are the first candidates, and what they
link needs no further comparison. But similarity 0.8 is some ten of 64 bits apart, where no index
over fingerprints tells much apart; so pairs that they miss come from shared shingles, all of
them. Each candidate is settled by the texts' own shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from tessera.functions.storage import discarded, stored
from tessera.operators.components import components

from . import simhash
from .common import bounded, lean, slices

#: Words of a shingle; shared shingles of linked texts, as a part of all that either has (4 of 5).
WIDTH, PART, WHOLE = 5, 4, 5
#: Shingles that are put last in the order, and how often a batch must have one to name it. Any order gives the same links.
COMMON, OFTEN = 1 << 18, 3
#: Passes that compare with one text of each shared shingle, and the pairs (for each posting) below which all are compared.
ROUNDS, DENSE = 8, 4
#: Postings of a token whose pairs are made where they meet, if they make no more than so many pairs for each posting; those of more frequent tokens are joined.
RARE, PAIRS = 32, 3
#: Longs of parities that go along with the postings of frequent tokens: short texts just beyond the limit, which a large group has many of, seldom look alike in so many bits.
BRIEF = 8
#: Pairs that are compared at once, without looking for the nearest first.
FEW = 1 << 13
#: Bytes of the tokens that meet in one bucket.
BUCKET = 8 << 20
#: Bits that the fingerprints of first candidates may differ in.
BITS = simhash.BITS
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WIDTH + 1)], np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the text's distinct shingles, sorted; of a text shorter than one, of all its words; none without words."""
    words = (text or "").encode().lower().split()  # as for fingerprints
    if len(words) < WIDTH:
        return np.array([xxh64_intdigest(b" ".join(words))] if words else [], np.uint64).view(np.int64)
    one = np.array([xxh64_intdigest(w) for w in words], np.uint64)
    n = len(one) - WIDTH + 1
    mixed = sum(one[k : k + n] * FACTORS[k] for k in range(WIDTH))
    return np.unique((mixed ^ (mixed >> np.uint64(29))).view(np.int64))


def prefix(found: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The first shingles in a fixed order, those in ``last`` (sorted) after all others: texts that link share one of them."""
    at = np.searchsorted(last, found)
    rank = np.where((at < len(last)) & (last[np.minimum(at, len(last) - 1)] == found), 1, 0) if len(last) else np.zeros(len(found), np.int8)
    need = -(-PART * len(found) // WHOLE)
    return found[np.argsort(rank, kind="stable")][: len(found) - need + 1 if len(found) else 0]


def parities(found: np.ndarray, bits: int = 0) -> list[int]:
    """Whether each of some classes of shingles has an odd number of them, in ``bits`` bits, or else about as many as shingles.

    Two texts differ in as many shingles at least as in bits here. The number of classes is a power
    of two; folding its halves on each other gives the parities of half as many.
    """
    bits = bits or max(256, 1 << (len(found) - 1).bit_length() if len(found) else 0)
    odd = np.bincount((found.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def _signed(rows: DataFrame) -> DataFrame:
    """``(row, size, sign, fp, odd, brief)`` for each row, equal signs for equal sets, and rows ``(token, often)`` of shingles that a batch has often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4 << 20):
            sets = [shingles(t) for t in batch.column("_text").to_pylist()]
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            tokens, counts = tokens[counts >= OFTEN], counts[counts >= OFTEN]
            n, m = len(sets), len(tokens)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([batch.column("_row"), pa.nulls(m, pa.int64())]),
                    pa.array([len(s) for s in sets] + [None] * m, pa.int64()),
                    pa.array([xxh128_digest(s.tobytes()) for s in sets] + [None] * m, pa.binary()),
                    pa.array([simhash.majority(s) for s in sets] + [None] * m, pa.int64()),
                    pa.array([parities(s) for s in sets] + [None] * m, pa.list_(pa.int64())),
                    pa.array([parities(s, 64 * BRIEF) for s in sets] + [None] * m, pa.list_(pa.int64())),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(tokens, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(counts, pa.int64())]),
                ],
                ["_row", "size", "sign", "fp", "odd", "brief", "token", "often"],
            )

    return stored(rows.select("_row", "_text").mapInArrow(lean(run), "_row long, size long, sign binary, fp long, odd array<long>, brief array<long>, token long, often long"), "signs")


def _blocks(texts: DataFrame, last: np.ndarray, buckets: int) -> DataFrame:
    """Prefixes of all texts as ``(bucket, tokens, nodes, places, sizes)``: packed numbers, some thousand in a row. Bucket -1 holds the tokens in ``last``."""
    shared = texts.sparkSession.sparkContext.broadcast(last)  # COMMON numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4 << 20):
            sets = [shingles(t) for t in batch.column("_text").to_pylist()]
            first = [prefix(s, shared.value) for s in sets]
            sizes = [len(f) for f in first]
            token, node = np.concatenate(first), np.repeat(np.array(batch.column("_row")), sizes)
            place, size = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat([len(s) for s in sets], sizes)
            bucket = (token.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            if len(shared.value):
                at = np.minimum(np.searchsorted(shared.value, token), len(shared.value) - 1)
                bucket[shared.value[at] == token] = -1
            order = np.argsort(bucket, kind="stable")
            bucket, token, node, place, size = bucket[order], token[order], node[order], place[order], size[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-2))
            ends = [*cuts[1:].tolist(), len(bucket)]
            pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts.tolist(), ends, strict=False)], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pack(token), pack(node), pack(place.astype(np.int32)), pack(size.astype(np.int32))], ["bucket", *PACKED])

    return stored(texts.select("_row", "_text").mapInArrow(lean(run), "bucket long, tokens binary, nodes binary, places binary, sizes binary"), "prefixes")


#: Columns of :func:`_blocks` and the numbers in them.
PACKED = {"tokens": np.int64, "nodes": np.int64, "places": np.int32, "sizes": np.int32}


def _unpacked(table: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """Tokens, nodes, places and sizes of :func:`_blocks`."""
    return [np.frombuffer(b"".join(table.column(c).to_pylist()), kind).astype(np.int64) for c, kind in PACKED.items()]


def _met(token: np.ndarray, node: np.ndarray, place: np.ndarray, size: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Of postings sorted by token: the pairs of nodes, each once, that rare tokens make, and which postings of the others can make any.

    What is left of either text from the token's place on must hold all that the two need to share,
    if it is the first that they share. So a posting has room for texts up to some size.
    """
    starts = np.flatnonzero(np.diff(token, prepend=token[:1] - 1))
    counts = np.diff(np.append(starts, len(token)))
    group, room = np.repeat(np.arange(len(starts)), counts), WHOLE * size - (PART + WHOLE) * place
    alive = (PART * np.minimum.reduceat(size, starts)[group] <= room) & (counts > 1)[group] if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero((counts <= rare)[group])
    t, s, r = group[at], PART * size[at], room[at]
    found = [np.empty((0, 2), np.int64)]
    for d in range(1, rare):
        i = np.flatnonzero(t[d:] == t[:-d])
        if not len(i):
            break
        i = i[(s[i + d] <= r[i]) & (s[i] <= r[i + d])]
        found.append(np.stack([at[i], at[i + d]], axis=1))
    pairs = np.concatenate(found)
    few = (counts <= rare) & (np.bincount(group[pairs[:, 0]], minlength=len(starts)) <= PAIRS * np.bincount(group[alive], minlength=len(starts)))
    pairs = np.sort(node[pairs[few[group[pairs[:, 0]]]]], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)]] if len(pairs) else pairs, alive & ~few[group]


def _postings(texts: DataFrame, sizes: DataFrame, last: np.ndarray) -> DataFrame:
    """Rows ``(node, other)`` for texts that share a rare token of their prefixes, and ``(token, node, place, size)`` for the frequent tokens of each; ``place`` is the token's in its text's order.

    Tokens in ``last`` are known to be frequent and stay without a look. The others meet in buckets
    of about ``BUCKET`` bytes, to see which of them are alone, rare or frequent; since none of them
    is among the most frequent ones, no bucket is much larger.
    """
    every = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    blocks, rare = _blocks(texts, last, 24 * every * (WHOLE - PART) // WHOLE // BUCKET + 1), RARE
    names = ["token", "node", "place", "size", "other"]

    def met(table: pa.Table) -> pa.Table:
        token, node, place, size = _unpacked(table)
        order = np.argsort(token, kind="stable")
        token, node, place, size = token[order], node[order], place[order], size[order]
        pairs, kept = _met(token, node, place, size, rare)
        of_pairs, of_posts = pa.nulls(len(pairs), pa.int64()), pa.nulls(int(kept.sum()), pa.int64())
        both = [[of_pairs, token[kept]], [pairs[:, 0], node[kept]], [of_pairs, place[kept]], [of_pairs, size[kept]], [pairs[:, 1], of_posts]]
        return pa.Table.from_arrays([pa.chunked_array([pa.array(x, pa.int64()) for x in parts], pa.int64()) for parts in both], names)

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*map(pa.array, found := _unpacked(b)), pa.nulls(len(found[0]), pa.int64())], names)

    schema = "token long, node long, place long, size long, other long"
    rest = blocks.where("bucket >= 0").groupBy("bucket").applyInArrow(met, schema)
    posts = stored(rest.union(blocks.where("bucket < 0").drop("bucket").mapInArrow(lean(all_of), schema)), "postings")
    discarded(blocks)
    return posts


def _folded(odd: Column, longs: Column) -> Column:
    """Parities of at most twice as many ``longs`` as so many."""
    return F.when(F.size(odd) > longs, F.zip_with(F.slice(odd, F.lit(1), longs), F.slice(odd, longs + 1, longs), lambda a, b: a.bitwiseXOR(b))).otherwise(odd)


def _similar(pairs: DataFrame, rows: DataFrame, signs: DataFrame, known: DataFrame | None) -> DataFrame:
    """Of ``(x, y)``, those whose texts share enough shingles, or enough of them that components are the same.

    Sizes, then parities bar nearly all others. Few pairs are then compared at once. Of more, each text is first compared with the
    one that its parities are nearest to; what this and ``known`` links put in one component needs
    no comparison.
    """
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = pairs.join(signs.toDF("x", "sx", "ox"), "x").join(signs.toDF("y", "sy", "oy"), "y").where(f"{PART} * greatest(sx, sy) <= {WHOLE} * least(sx, sy)")
    longs = F.least(F.size("ox"), F.size("oy"))
    apart = F.aggregate(F.zip_with(_folded(F.col("ox"), longs), _folded(F.col("oy"), longs), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    s = F.col("sx") + F.col("sy")
    pairs = stored(pairs.select("x", "y", (apart / s).alias("apart"), ((PART + WHOLE) * apart <= (WHOLE - PART) * s).alias("may")).where("may").drop("may"), "candidates")
    nodes = stored(pairs.select("x").union(pairs.select("y")).distinct().toDF("_row"), "compared")
    texts = stored(rows.join(bounded(nodes), "_row").select("_row", "_text"), "texts")
    if pairs.count() <= FEW:
        found = _compared(pairs.select("x", "y"), texts)
        discarded(texts)
        return found
    first = stored(pairs.groupBy("y").agg(F.min(F.struct("apart", "x")).alias("m")).select("m.x", "y"), "nearest")
    found = _compared(first, texts)
    named = stored(components(found if known is None else found.union(known), "x", "y"), "near")
    rest = pairs.join(first, ["x", "y"], "left_anti").join(named.toDF("x", "cx"), "x", "left").join(named.toDF("y", "cy"), "y", "left")
    others = _compared(rest.where("coalesce(cx, x) <> coalesce(cy, y)").select("x", "y"), texts)
    discarded(texts)
    return found.union(others)


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose texts share enough shingles; one text is sent for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(slices([b], "tx", 4 << 20) for b in slices(batches, "ty", 4 << 20)):
            last, same, kept = None, None, []
            for x, y, tx, ty in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "tx", "ty")), strict=True):
                if last != y:
                    last, same = y, shingles(ty)
                other = shingles(tx)
                common = len(np.intersect1d(same, other, assume_unique=True))
                kept.append((PART + WHOLE) * common >= PART * (len(same) + len(other)))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(texts.toDF("x", "tx"), "x").join(texts.toDF("y", "ty"), "y")
    return stored(both.mapInArrow(lean(run), "x long, y long"), "similar")


def _named(posts: DataFrame, found: DataFrame) -> DataFrame:
    """``posts`` with the component that ``found`` has for each node."""
    return stored(posts.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")


def _by_fingerprint(heads: DataFrame) -> DataFrame:
    """Candidates ``(x, y)`` by SimHash: each text with the least of its fingerprint, and those where fingerprints link."""
    least = stored(heads.groupBy("fp").agg(F.min("_row").alias("node")), "fingerprints")
    same = heads.join(least, "fp").where("_row <> node").select(F.col("node").alias("x"), F.col("_row").alias("y"))
    near = simhash.links(least.select("fp"), BITS).join(least.toDF("x", "nx"), "x").join(least.toDF("y", "ny"), "y")
    return same.union(near.select(F.col("nx").alias("x"), F.col("ny").alias("y")))


def links(posts: DataFrame, rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Pairs ``(x, y)`` of similar texts, not all, but enough that their components are those of all.

    First come SimHash's candidates. Texts that link share a token of their prefixes. Pairs by rare
    tokens are there. By its frequent tokens each text is compared with one text of each, a row for
    each posting, so a large group of near copies never gives a pair of each two; texts in one
    component already need no comparison. When few pairs of different components are left, a pass
    doesn't link many of them, or no more rounds, all of them are compared that places, sizes and
    parities allow: the join itself holds these against each other. The one text is in turn that
    with the fewest rarer tokens before, to which most of a group are near, and any.
    """
    pair = lambda a, b: a.join(b, "token")
    sizes = f"{PART} * greatest(sx, sy) <= {WHOLE} * least(sx, sy)"
    apart = " + ".join(f"bit_count(ox{i} ^ oy{i})" for i in range(BRIEF))
    may = f"{PART + WHOLE} * ({apart}) <= {WHOLE - PART} * (sx + sy)"
    # what is left of either text from the places on must hold all that they need to share, if this is the first they share
    near = f"{PART} * sy <= {WHOLE} * sx - {PART + WHOLE} * px and {PART} * sx <= {WHOLE} * sy - {PART + WHOLE} * py"
    signs = heads.select("_row", "size", "odd")
    brief = heads.select(F.col("_row").alias("node"), *[F.col("brief")[i].alias(f"o{i}") for i in range(BRIEF)])
    often = stored(posts.where("other is null").drop("other").join(brief, "node"), "often")
    columns = {"node": "", "place": "p", "size": "s", "component": "c"} | {f"o{i}": f"o{{}}{i}" for i in range(BRIEF)}
    side = lambda df, at, of=lambda c: c: df.select("token", *[F.col(of(c)).alias(to.format(at) if "{" in to else to + at) for c, to in columns.items()])
    found = _similar(_by_fingerprint(heads.select("_row", "fp")), rows, signs, None)
    linked = stored(components(found, "x", "y"), "linked")
    every, before = posts.count(), None
    for k in range(ROUNDS + 1):
        named = _named(often, linked)
        weights = named.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
        left = weights.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2), F.lit(0))).first()[0]
        if k == ROUNDS or left <= DENSE * every or before is not None and 10 * left > 9 * before:
            break
        before = left
        first = F.xxhash64(F.lit(k), "node") if k % 2 else F.col("place")
        one = named.groupBy("token").agg(F.min(F.struct(first.alias("h"), *columns)).alias("o"))
        pairs = pair(side(named, "x"), side(one, "y", "o.{}".format)).where(f"cx <> cy and {sizes} and {may}").select("x", "y")
        found = found.union(_similar(pairs, rows, signs, found))
        linked = stored(components(found, "x", "y"), "linked")
    both = pair(side(named, "x"), side(named, "y")).where(f"x < y and cx <> cy and {near} and {may}").select("x", "y")
    rare = posts.where("other is not null").select(F.col("node").alias("x"), F.col("other").alias("y")).distinct()
    rare = rare.join(linked.toDF("x", "cx"), "x", "left").join(linked.toDF("y", "cy"), "y", "left").where("coalesce(cx, x) <> coalesce(cy, y)").select("x", "y")
    return found.union(_similar(both.union(rare), rows, signs, found))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of similar texts: that of the least id (of its repeated rows, one; null ids after others).

    Two texts link if they share at least ``PART`` of ``WHOLE`` of the distinct shingles that either
    has. Equal sets are one class before any link is sought, those of texts without words (null,
    empty) too. Columns stay, whatever their names; an empty table stays empty.
    """
    kept = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(kept))])
    numbered = stored(held.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select("_row", F.col(f"c{kept.index(id_col)}").alias("_id"), F.col(f"c{kept.index(text_col)}").alias("_text"))
    signs = _signed(rows)
    common = signs.where("token is not null").groupBy("token").agg(F.sum("often").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON)
    last = np.sort(np.array([r[0] for r in common.select("token").collect()], np.int64))
    key = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row")).alias("k")
    classes = stored(signs.where("_row is not null").select("_row", "sign").join(rows.select("_row", key), "_row").groupBy("sign").agg(F.min("k").alias("k")).select(F.col("k.row").alias("_row"), "k"), "classes")
    heads = stored(signs.where("_row is not null").join(bounded(stored(classes.select("_row"), "heads")), "_row").select("_row", "size", "fp", "odd", "brief"), "head-signs")
    discarded(signs)
    posts = _postings(rows.join(bounded(heads.select("_row")), "_row"), heads.select("_row", "size"), last)
    near = components(stored(links(posts, rows, heads), "links"), "x", "y")
    named = stored(classes.join(near, F.col("_row") == F.col("node"), "left").select("_row", "k", F.coalesce("component", "_row").alias("component")), "components")
    first = stored(named.groupBy("component").agg(F.min("k").alias("k")).select(F.col("k.row").alias("_row")), "first")
    discarded(posts, heads, classes, named)
    return numbered.join(bounded(first), "_row", "left_semi").select(*held.columns).toDF(*kept)
