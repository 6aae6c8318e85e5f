"""Benchmark decontamination over a distributed positional inverted index of the training tokens."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.storage import stored

from .common import bounded, lean, slices, table
from .words import words

#: Words of a window, and how far a term may be from its place in a proximity match.
WINDOW, SLOP = 13, 3
#: Test items are taken in groups of about so many bytes, each broadcast; a larger test set takes more passes, not more memory.
TEST_BYTES = 4 << 20
#: Bytes of text in a block of the index, and candidates looked at together.
BLOCK, CANDIDATES = 1 << 20, 1 << 19
#: An index for one search leaves out words of no test item if those have so many different words at most (8 bytes each, broadcast).
VOCABULARY = 4 << 20

INDEX = "rows array<long>, ids array<long>, n_words array<long>, terms binary, counts binary, docs binary, places binary"
FOUND = "row long, doc_id long, n_words long, n_hit long, longest int, spans array<struct<start:int,stop:int>>, items array<string>, near array<string>"


class Tests:
    """Windows of one group of test items: ``vocabulary`` of sorted word hashes, windows as term ids by their length, and their items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        found = words(pa.array([t or "" for _, t in items], pa.string()))
        self.vocabulary, terms = np.unique(found.hash, return_inverse=True)
        known: dict[tuple, set] = defaultdict(set)
        for i, (item, _) in enumerate(items):
            own = terms[found.of[i] : found.of[i + 1]].tolist()
            for k in range(max(1, len(own) - window + 1) if own else 0):
                known[tuple(own[k : k + window])].add(item)
        by_length = defaultdict(list)
        for w, of in known.items():
            by_length[len(w)].append((w, sorted(x for x in of if x is not None)))
        self.windows = {n: (np.array([w for w, _ in x], np.int64), [of for _, of in x]) for n, x in by_length.items()}

    def rarest_first(self, frequency: np.ndarray) -> None:
        """Set the order in which a window's terms are intersected, from the documents that each term is in."""
        self.order = {n: np.argsort(frequency[w], axis=1, kind="stable") for n, (w, _) in self.windows.items()}


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: np.ndarray | None = None) -> DataFrame:
    """Positional postings of all words of ``docs``, in blocks of documents; written, to be searched as often as there are tests.

    A row is a block: for each term (the 64-bit hash of a word, ascending) its tokens, the documents
    it is in, and the ascending places of its tokens. Places count words in the block, with a gap
    between documents. With ``only``, sorted hashes, other terms are left out: for a search whose
    tests have no others. A null or empty text has no words; repeated rows are documents of their
    own. An empty table makes an empty index. Columns besides the two aren't read.
    """
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(only)  # VOCABULARY at most

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            w = words(batch.column("text"))
            kept = np.arange(len(w.hash))
            if shared is not None:
                kept = np.flatnonzero(_found(shared.value, w.hash)[0])
            place, hashes, row = kept + w.row[kept] * GAP, w.hash[kept], w.row[kept]
            order = np.argsort(hashes, kind="stable")
            hashes, place, row = hashes[order], place[order], row[order]
            first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]) != 0)
            of_doc = np.ones(len(hashes), np.int64)
            of_doc[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            yield pa.RecordBatch.from_pydict(
                {
                    "rows": [batch.column("row").to_pylist()],
                    "ids": [batch.column("id").to_pylist()],
                    "n_words": [np.diff(w.of)],
                    "terms": [hashes[first].tobytes()],
                    "counts": [np.diff(np.append(first, len(hashes))).astype(np.int32).tobytes()],
                    "docs": [(np.add.reduceat(of_doc, first) if len(first) else first).astype(np.int32).tobytes()],
                    "places": [place.astype(np.uint32).tobytes() if not len(place) or place.max() < 1 << 32 else place.astype(np.int64).tobytes()],
                },
                schema=SCHEMA,
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(lean(blocks), INDEX), "postings")


def _found(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``hashes`` are in ``known`` (sorted), and where."""
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return (known[at] == hashes if len(known) else np.zeros(len(hashes), bool)), at


def _postings(block: dict, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the terms in ``vocabulary`` that a block has: their numbers there, ascending, tokens, documents, and all places one after another."""
    terms, counts, docs = np.frombuffer(block["terms"], np.uint64), np.frombuffer(block["counts"], np.int32).astype(np.int64), np.frombuffer(block["docs"], np.int32)
    places = np.frombuffer(block["places"], np.uint32 if len(block["places"]) == 4 * counts.sum() else np.int64)
    if len(terms) == 0 or len(vocabulary) == 0:
        none = np.empty(0, np.int64)
        return none, none, none, none
    if len(vocabulary) < len(terms):
        known, at = _found(terms, vocabulary)
        number, at = np.flatnonzero(known), at[known]
    else:
        known, number = _found(vocabulary, terms)
        number, at = number[known], np.flatnonzero(known)
    first, many = (np.cumsum(counts) - counts)[at], counts[at]
    where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    return number, many, docs[at].astype(np.int64), places[where].astype(np.int64)


GAP = WINDOW + 2 * SLOP + 2
SCHEMA = pa.schema(
    [
        ("rows", pa.list_(pa.int64())),
        ("ids", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())),
        ("terms", pa.binary()),
        ("counts", pa.binary()),
        ("docs", pa.binary()),
        ("places", pa.binary()),
    ]
)


def intersected(tests: Tests, n: int, span: int, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Candidates ``(window, start, exact)`` that have all of their terms: begun from each window's rarest term, cut by one offset-adjusted list after another."""
    windows, _ = tests.windows[n]
    order = tests.order[n]
    keys = np.repeat(terms.astype(np.int64), counts) * span + places
    size = np.zeros(len(tests.vocabulary), np.int64)
    size[terms] = counts
    first = np.zeros(len(tests.vocabulary), np.int64)
    first[terms] = np.cumsum(counts) - counts
    lead = np.take_along_axis(windows, order[:, :1], 1)[:, 0]
    alive = np.flatnonzero((size[windows] > 0).all(axis=1))
    ends = np.cumsum(size[lead[alive]])
    begin = 0
    while begin < len(alive):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CANDIDATES, "right")))
        w = alive[begin:stop]
        begin = stop
        many = size[lead[w]]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[lead[w]], many)
        w = np.repeat(w, many)
        start = places[at] - order[w, 0]
        exact = np.ones(len(w), bool)
        for k in range(1, n):
            off = order[w, k]
            base = windows[w, off] * span
            want = base + np.maximum(start + off - slop, 0)
            i = np.searchsorted(keys, want)
            i[i == len(keys)] = len(keys) - 1
            near = (keys[i] >= want) & (keys[i] <= base + start + off + slop)
            w, start, exact, base, off = w[near], start[near], exact[near], base[near], off[near]
            want = base + start + off
            i = np.searchsorted(keys, want)
            i[i == len(keys)] = len(keys) - 1
            exact &= keys[i] == want
            if not len(w):
                break
        if len(w):
            yield w, start, exact


def search(postings: DataFrame, tests, slop: int) -> DataFrame:
    """For each document of the index, the words and items of its exact matches and the items of its proximity matches. ``tests``: a broadcast :class:`Tests`."""

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tests.value
        for batch in batches:
            for block in batch.to_pylist():
                yield one(t, block)

    def one(t: Tests, block: dict) -> pa.RecordBatch:
        n_words = np.array(block["n_words"], np.int64)
        docs = len(n_words)
        bases = np.cumsum(n_words) - n_words + np.arange(docs) * GAP
        span = int(n_words.sum()) + (docs + 1) * GAP
        terms, counts, _, places = _postings(block, t.vocabulary)
        longest = [0] * docs
        change = np.zeros(span + 1, np.int32)
        items, near = defaultdict(set), defaultdict(set)
        for n in t.windows if len(terms) else ():
            of = t.windows[n][1]
            for w, start, exact in intersected(t, n, span, terms, counts, places, slop):
                np.add.at(change, start[exact], 1)
                np.add.at(change, start[exact] + n, -1)
                doc = np.searchsorted(bases, np.maximum(start, 0), "right") - 1
                for d, x, e in set(zip(doc.tolist(), w.tolist(), exact.tolist(), strict=True)):
                    (items if e else near)[d].update(of[x])
                    longest[d] = max(longest[d], n * e)
        hit = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        spans = defaultdict(list)
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            d = int(np.searchsorted(bases, a, "right")) - 1
            spans[d].append({"start": a - int(bases[d]), "stop": b - int(bases[d])})
        return pa.RecordBatch.from_pydict(
            {
                "row": block["rows"],
                "doc_id": block["ids"],
                "n_words": n_words,
                "n_hit": [sum(x["stop"] - x["start"] for x in spans[d]) for d in range(docs)],
                "longest": longest,
                "spans": [spans[d] for d in range(docs)],
                "items": [sorted(items[d]) for d in range(docs)],
                "near": [sorted(near[d] | items[d]) for d in range(docs)],
            },
            schema=RESULT,
        )

    return postings.mapInArrow(lean(matched), FOUND)


RESULT = pa.schema(
    [
        ("row", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("longest", pa.int32()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ("items", pa.list_(pa.string())),
        ("near", pa.list_(pa.string())),
    ]
)


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Match every document with the windows of every test item.

    Returns a row for each row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside any
    exact occurrence of a window), ``longest`` (words of the longest window that occurs, or 0),
    ``spans`` (the words hit, as ranges), ``items`` (ids, as strings, of items with an exact
    occurrence) and ``near`` (ids of items of which all terms of a window occur at most ``slop``
    words from their places; exact ones too).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Words are
    equal if their 64-bit hashes are; a false hit would take a collision inside a window of which
    all other words agree. Null and empty texts have no words and match nothing. Repeated
    documents keep a row each, repeated items count once, an item without id adds hits only. An
    empty table on either side gives no hits. Extra columns of either side are ignored.

    The index is made once. Test items go over it in groups of about ``TEST_BYTES``; of each group,
    only the documents that are hit are written, and the group's broadcast is let go.
    """
    if window + 2 * slop + 2 > GAP:
        raise ValueError(f"window + 2 * slop is at most {GAP - 2}")
    tests = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where(F.octet_length("text") > 0)
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // TEST_BYTES) or 1

    def group(g: int) -> Tests:
        rows = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect()
        return Tests([(r["item"], r["text"]) for r in rows], window)

    only: np.ndarray | None = np.empty(0, np.uint64)
    held = None
    for g in range(groups):
        held = group(g)
        only = np.union1d(only, held.vocabulary)
        if len(only) > VOCABULARY:
            only = None
            break
    postings = index(docs, id_col, text_col, only)
    if groups == 1:
        held.rarest_first(frequencies(postings, held.vocabulary))
        return search(postings, docs.sparkSession.sparkContext.broadcast(held), slop).drop("row")
    return _merged(postings, (group(g) for g in range(groups)), slop)


def _merged(postings: DataFrame, groups: Iterator[Tests], slop: int) -> DataFrame:
    """What :func:`search` gives for all ``groups``, one after another, as one; ranges that touch are one."""
    context, hits = postings.sparkSession.sparkContext, []
    for tests in groups:
        tests.rarest_first(frequencies(postings, tests.vocabulary))
        shared = context.broadcast(tests)
        found = search(postings, shared, slop).where((F.size("near") > 0) | (F.col("n_hit") > 0))
        hits.append(stored(found.select("row", "longest", "spans", "items", "near"), "hits"))
        shared.destroy()
    every = hits[0]
    for x in hits[1:]:
        every = every.union(x)
    before = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    ranges = every.select("row", F.explode("spans").alias("s")).select("row", "s.*").distinct().withColumn("reach", F.max("stop").over(before))
    ranges = ranges.withColumn("n", F.sum((F.col("reach").isNull() | (F.col("start") > F.col("reach"))).cast("int")).over(up_to))
    ranges = ranges.groupBy("row", "n").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    ranges = ranges.groupBy("row").agg(F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    ids = every.groupBy("row").agg(F.max("longest").alias("longest"), *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")])
    hit = stored(ids.join(ranges, "row", "left"), "hit")
    rows = postings.select(F.explode(F.arrays_zip("rows", "ids", "n_words")).alias("d")).select(F.col("d.rows").alias("row"), F.col("d.ids").alias("doc_id"), "d.n_words")
    none = lambda c: F.coalesce(c, F.array().cast(dict(hit.dtypes)[c]))
    return rows.join(hit, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("longest", F.lit(0)).alias("longest"), *[none(c).alias(c) for c in ("spans", "items", "near")])


def frequencies(postings: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Documents of each term of ``vocabulary`` over the whole index; one sum for each task and term is shuffled."""
    shared = postings.sparkSession.sparkContext.broadcast(vocabulary)  # of one group

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                number, _, docs, _ = _postings(block, shared.value)
                total[number] += docs
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": at, "n": total[at]}, schema=pa.schema([("term", pa.int64()), ("n", pa.int64())]))

    out = np.zeros(len(vocabulary), np.int64)
    found = postings.select("terms", "counts", "docs", "places").mapInArrow(lean(counted), "term long, n long")
    for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    shared.destroy()
    return out


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, **names) -> DataFrame:
    """``docs`` without those that hold ``window`` consecutive words of a test item, wherever; the columns stay, whatever their names.

    All words of an item that has fewer may be common ones, so those count only where a twentieth
    of the document's words or more is hit. Rows that share an id go together; rows without id stay,
    as do null and empty texts. Empty tables on either side take nothing away.
    """
    kept, name = docs.columns, names.get("id_col", "doc_id")
    hit = matches(docs, items, window, **names).where((F.col("n_hit") > 0) & ((F.col("longest") >= window) | (20 * F.col("n_hit") >= F.col("n_words"))))
    gone = bounded(stored(hit.select(F.col("doc_id").alias("_hit")).distinct(), "hit"))
    held = docs.toDF(*[f"_{i}" for i in range(len(kept))])  # no name of theirs is that of the hits
    return held.join(gone, F.col(f"_{kept.index(name)}") == F.col("_hit"), "left_anti").toDF(*kept)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all windows of ``benchmark`` in ``documents``; nulls, repeated rows, empty tables and other columns as in :func:`matches`."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS k FROM b WHERE len(w) > 0)
),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)
),
m AS (SELECT r, k, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
i AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
