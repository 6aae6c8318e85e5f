"""Approximate nearest neighbours by additive quantisation and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.storage import stored

from .common import kind, table

#: Codebooks, their entries (one byte each), the beam of the encoder, and the bounded sample they are fitted on.
BOOKS, ENTRIES, BEAM, SAMPLE, ROUNDS, FITS = 16, 256, 4, 8192, 5, 1
#: Neighbours asked for, rows of an index block, and candidates of a query that are reranked in each block.
NEAREST, BLOCK, SHORTLIST = 20, 8192, 160
#: Queries that one pass over the index holds (broadcast, so many vectors at most), and those scored together.
PASS, TOGETHER = 16_384, 128
#: Part of a sum's terms that single precision may be off by.
ROUNDING = 1e-5


class Quantiser(NamedTuple):
    """``books``: codebooks x entries x dimensions; a vector is the sum of one entry of each."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of ``x`` and the squared norms of what they decode to: in each step the ``beam`` best partial sums go on."""
        n, (m, k, dim) = len(x), self.books.shape
        codes = np.zeros((n, 1, m), np.uint8)
        rest = x.reshape(n, 1, dim)
        for i, book in enumerate(self.books):
            half = 0.5 * (book**2).sum(axis=1)
            # what is left of x after an entry, squared, is that before it plus twice this
            gain = half - rest.reshape(-1, dim) @ book.T + 0.5 * (rest.reshape(-1, dim) ** 2).sum(axis=1)[:, None]
            gain = gain.reshape(n, -1)
            width = min(beam, gain.shape[1])
            best = np.argpartition(gain, width - 1, axis=1)[:, :width]
            parent, entry = best // k, best % k
            codes = np.take_along_axis(codes, parent[:, :, None], 1)
            codes[:, :, i] = entry
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[entry]
        best = (rest**2).sum(axis=2).argmin(axis=1)
        at = np.arange(n)
        return codes[at, best], ((x - rest[at, best]) ** 2).sum(axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = self.books[0][codes[:, 0]].copy()
        for i in range(1, len(self.books)):
            out += self.books[i][codes[:, i]]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]] if len(x) >= k else np.concatenate((x, np.zeros((k - len(x), x.shape[1]), x.dtype)))
    for _ in range(ROUNDS):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        order = np.argsort(near, kind="stable")
        heads, starts = np.unique(near[order], return_index=True)
        centres[heads] = np.add.reduceat(x[order], starts) / np.diff(np.append(starts, len(x)))[:, None]
    return centres


def fitted(x: np.ndarray, books: int = BOOKS) -> Quantiser:
    """Codebooks fitted to ``x``: k-means of residuals, one book after another, then all books at once by least squares on the codes."""
    rng = np.random.default_rng(0)
    rest, out = x.astype(np.float32), []
    for _ in range(books):
        centres = _kmeans(rest, ENTRIES, rng)
        out.append(centres)
        rest = rest - centres[((centres**2).sum(axis=1) - 2 * rest @ centres.T).argmin(axis=1)]
    q = Quantiser(np.stack(out))
    for _ in range(FITS):
        codes, _ = q.encode(x.astype(np.float32))
        one = codes.astype(np.int64) + np.arange(books) * ENTRIES
        gram, right = np.zeros((books * ENTRIES, books * ENTRIES), np.float32), np.zeros((books * ENTRIES, x.shape[1]), np.float32)
        for i in range(books):
            np.add.at(right, one[:, i], x)
            for j in range(books):
                np.add.at(gram, (one[:, i], one[:, j]), 1)
        gram[np.diag_indices_from(gram)] += 0.1
        q = Quantiser(np.linalg.solve(gram, right + 0.1 * q.books.reshape(-1, x.shape[1])).reshape(q.books.shape).astype(np.float32))
    return q


def usable(vector: Column, dim: int | None = None) -> Column:
    """True for vectors that take part: no null or non-finite component, not all zero, of ``dim`` components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    right = F.size(vector) == dim if dim else F.lit(True)
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0) & right, F.lit(False))


def lengths(vectors: DataFrame, vector_col: str = "embedding") -> list[int]:
    """The lengths of usable vectors. Vectors of different lengths have no inner product, so each length is a search of its own."""
    rows = vectors.where(usable(F.col(vector_col)))
    return sorted(r[0] for r in rows.select(F.size(vector_col)).distinct().collect())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, Quantiser, int] | None:
    """Quantise every usable row: ``(row, vec_id, vector, codes, norm)`` in the shared folder, with the quantiser and the dimension; None without such rows.

    The codebooks are fitted on ``sample`` rows at most, chosen by the hash of the vector; all rows
    are encoded. Rows without id take no part. All vectors must be of one length (ValueError); see
    :func:`lengths` for tables where they aren't. Repeated rows are rows of their own, other columns
    aren't read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().collect()
    if not sizes:
        return None
    if len(sizes) > 1:
        raise ValueError(f"vectors of lengths {sorted(r['dim'] for r in sizes)} can't be in one index")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    mark = F.pmod(F.xxhash64("vector", "vec_id"), F.lit(1 << 40))
    some = rows.where(mark < int((1 << 40) * min(1, 1.5 * sample / n))).select("vector", mark.alias("mark")).orderBy("mark").limit(sample)
    q = fitted(_matrix(some.select("vector").toArrow().column("vector"), dim))
    shared = vectors.sparkSession.sparkContext.broadcast(q)  # codebooks x entries x dimensions

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                codes, norms = shared.value.encode(_matrix(part.column("vector"), dim).astype(np.float32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32())], [*part.schema.names, "codes", "norm"])

    schema = rows.withColumn("row", F.monotonically_increasing_id()).schema.add("codes", kind("binary")).add("norm", kind("float"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(encode, schema), "quantised"), q, dim


def nearest(indexed: tuple[DataFrame, Quantiser, int], queries: Column, count: int = NEAREST, shortlist: int = SHORTLIST, measure: str = "inner") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``count`` nearest rows to each indexed row for which ``queries`` holds.

    Queries go over the whole index in passes of a bounded number of bytes, each written before the
    next, so one broadcast is held at a time. In each block of the
    index, candidates are scored by lookup tables (one inner product with each codebook entry,
    added up by codes; for ``l2`` with the stored norm of the decoded vector), and the best
    ``shortlist`` are reranked on the original vectors in double precision. The worst of the
    nearest so far is then a cut, and all other candidates that the error of their codes lets
    reach it are reranked too, so the result is exact. Of equal vectors, a block keeps one more
    than ``count``, those of the least ids: others can't be among the nearest. ``score`` is the inner product, or minus the
    squared distance for ``l2``. Ties go to the smaller id. A query's own row is no candidate, but
    other rows with its id or vector are. With fewer candidates than ``count``, all are returned.
    """
    table_, q, dim = indexed
    spark = table_.sparkSession
    asked = table_.where(queries).select("row", "vec_id", "vector")
    passes = -(-asked.count() // max(1, PASS * 64 // dim)) or 1
    books, found = len(q.books), []
    for p in range(passes):
        some = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).toArrow()
        if some.num_rows:
            shared = spark.sparkContext.broadcast((np.array(some.column("row")), np.array(some.column("vec_id")), _matrix(some.column("vector"), dim), q.books))
            found.append(stored(table_.mapInArrow(_searcher(shared, books, dim, count, shortlist, measure), "qrow long, query_id long, vec_id long, score double"), "nearest"))
            shared.destroy()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def _few_equal(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the rows of ``x`` that have fewer than ``most`` equal ones of lesser id, in order."""
    whole = np.ascontiguousarray(x + 0.0)  # no negative zeros
    _, group = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[nth < most])


def _searcher(shared, books: int, dim: int, count: int, shortlist: int, measure: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, exact, entries = shared.value
        order = np.argsort(own)
        tables = [(entries.reshape(-1, dim) @ exact[a : a + TOGETHER].T.astype(np.float32)).reshape(books, ENTRIES, -1) for a in range(0, len(ids), TOGETHER)] if len(ids) <= 8 * TOGETHER else None
        best = np.full((len(ids), count), -np.inf)
        best_id = np.zeros((len(ids), count), np.int64)
        for rows, vec, x, codes, norms in blocks(batches):
            keep = _few_equal(x, vec, count + 1)
            rows, vec, x, codes, norms = rows[keep], vec[keep], x[keep], np.ascontiguousarray(codes[:, keep]), norms[keep]
            decoded = sum(entries[m][codes[m]].astype(np.float64) for m in range(books))
            error, length = np.sqrt(((x - decoded) ** 2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
            # what single precision may add: a few thousand roundings of the largest term
            loose = ROUNDING * (length + error + sum(np.sqrt((entries[m].astype(np.float64) ** 2).sum(axis=1))[codes[m]] for m in range(books)))
            found = np.searchsorted(own[order], rows)
            found[found == len(own)] = 0
            mine = {int(order[f]): i for i, f in enumerate(found) if own[order[f]] == rows[i]}  # queries in this block
            for b, a in enumerate(range(0, len(ids), TOGETHER)):
                some = exact[a : a + TOGETHER]
                lut = tables[b] if tables else (entries.reshape(-1, dim) @ some.T.astype(np.float32)).reshape(books, ENTRIES, -1)
                near = lut[0].take(codes[0], axis=0)
                for m in range(1, books):
                    near += lut[m].take(codes[m], axis=0)
                if measure == "l2":
                    near *= 2
                    near -= norms[:, None]
                near = np.ascontiguousarray(near.T)
                for k in range(a, min(a + TOGETHER, len(ids))):
                    if k in mine:
                        near[k - a, mine[k]] = -np.inf
                width = min(shortlist, near.shape[1])
                top = np.argpartition(near, near.shape[1] - width, axis=1)[:, -width:]
                if measure == "l2":
                    score = -((x[top] - some[:, None, :]) ** 2).sum(axis=2)
                else:
                    score = (x[top] * some[:, None, :]).sum(axis=2)
                score[np.take_along_axis(near, top, 1) == -np.inf] = -np.inf
                score = np.concatenate((best[a : a + TOGETHER], score), axis=1)
                vecs = np.concatenate((best_id[a : a + TOGETHER], vec[top]), axis=1)
                first = np.lexsort((vecs, -score), axis=-1)[:, :count]
                best[a : a + TOGETHER] = np.take_along_axis(score, first, 1)
                best_id[a : a + TOGETHER] = np.take_along_axis(vecs, first, 1)
                if width == near.shape[1]:
                    continue
                np.put_along_axis(near, top, -np.inf, 1)
                size = np.sqrt((some**2).sum(axis=1))
                if measure == "l2":
                    apart = np.sqrt(np.maximum(size[:, None] ** 2 - near - 2 * (size[:, None] + length + error) * loose, 0))
                    bound = -(np.maximum(apart * (1 - ROUNDING) - error - loose, 0) ** 2)
                    bound[near == -np.inf] = -np.inf
                else:
                    bound = near + size[:, None] * (error + loose)
                cut = best[a : a + TOGETHER, -1]
                may = (bound >= cut[:, None]) & (near > -np.inf)
                some_rows = np.flatnonzero(may.any(axis=0))
                if not len(some_rows):
                    continue
                part = x[some_rows]
                close = part @ some.T
                slack = 1e-10 * (1 + (size[:, None] + length[some_rows]) ** 2)
                close = (2 * close.T - (length[some_rows] ** 2) - size[:, None] ** 2 if measure == "l2" else close.T) + slack
                also = may[:, some_rows] & (close >= cut[:, None])
                for i in np.flatnonzero(also.any(axis=1)):
                    # the product already tells nearly all apart: only what can be among the first is scored as the others were
                    of = np.flatnonzero(also[i])
                    if len(of) > count:
                        of = of[close[i, of] >= np.partition(close[i, of] - 2 * slack[i, of], len(of) - count)[len(of) - count]]
                    of = some_rows[of]
                    score = -((x[of] - some[i]) ** 2).sum(axis=1) if measure == "l2" else (x[of] * some[i]).sum(axis=1)
                    score, vecs = np.concatenate((best[a + i], score)), np.concatenate((best_id[a + i], vec[of]))
                    first = np.lexsort((vecs, -score))[:count]
                    best[a + i], best_id[a + i] = score[first], vecs[first]
        i, k = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(ids[i]), pa.array(best_id[i, k]), pa.array(best[i, k])], ["qrow", "query_id", "vec_id", "score"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, BLOCK - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(held)
        codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, books)
        return np.array(t.column("row")), np.array(t.column("vec_id")), _matrix(t.column("vector"), dim), np.ascontiguousarray(codes.T), np.array(t.column("norm"))

    return search


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of ``embeddings`` to those whose vec_id is divisible by 20, among the vectors of their length.

    Rows without id and unusable vectors (null, zero, null or non-finite components) take no part;
    repeated rows are rows of their own; an empty table gives no rows; other columns aren't read.
    """
    vectors = table(spark, sf_dir, "embeddings")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n in lengths(vectors):
        if indexed := index(vectors.where(F.size("embedding") == n)):
            out = out.union(nearest(indexed, F.col("vec_id") % 20 == 0))
    return out
