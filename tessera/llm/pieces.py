"""SentencePiece encoding by sampling the piece lattice, and lossless decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from math import exp, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind, lean, slices, table
from .words import LENGTH, mixed, powers, words

MODEL = "piece_bpe_32k.model"
#: The weight of a piece is (rank + OFFSET) ** -ALPHA: Zipf's law, since a BPE model's scores are ranks only. A lesser ALPHA gives more varied segmentations.
ALPHA, OFFSET, SEED = 1.0, 2.7, 0
#: Stretches of at most SHORT bytes are filtered together, as arrays, with the draws that longer ones take one by one; bytes of text in one such step.
SHORT, TOGETHER = 32, 1 << 20
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Ids and weights of byte strings by their 64-bit hashes, looked up as arrays: one place for each hash, a second one for those whose place is taken."""

    BITS = 20

    def __init__(self, pieces: list[tuple[bytes, int, float]]):
        order = sorted(pieces, key=lambda x: x[1])
        found = words(pa.array([x[0] for x in order], pa.binary()), ANY, SAME)
        self.hash = np.append(found.hash, np.uint64(0))
        self.id = np.append(np.array([x[1] for x in order], np.int32), np.int32(-1))
        self.weight = np.append(np.array([x[2] for x in order]), 0.0)
        none = len(order)
        self.first = np.full(1 << self.BITS, none, np.int32)
        self.second = np.full(1 << self.BITS, none, np.int32)
        for i, h in enumerate(found.hash.tolist()):
            for table, at in ((self.first, h >> (64 - self.BITS)), (self.second, h & ((1 << self.BITS) - 1))):
                if table[at] == none:
                    table[at] = i
                    break
            else:
                raise ValueError("two pieces need one place")
        self.none = none

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, ``none`` for those that are no piece."""
        at = self.first[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)]
        miss = np.flatnonzero((at != self.none) & (self.hash[at] != hashes))
        again = self.second[(hashes[miss] & np.uint64((1 << self.BITS) - 1)).astype(np.int64)]
        at[miss] = np.where(self.hash[again] == hashes[miss], again, self.none)
        return at


ANY, SAME = np.ones(256, bool), np.arange(256, dtype=np.uint8)
#: Bytes of a character by its first byte; 0 for the bytes that follow.
CHAR = np.repeat(np.array([1, 0, 2, 3, 4], np.int8), [0x80, 0x40, 0x20, 0x10, 0x10])


STEP = np.uint64(0x9E3779B97F4A7C15)


def draws(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each stretch's key and place in it: the same whichever way the stretch is filtered."""
    return (mixed(mixed(keys) + places.astype(np.uint64) * STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattice:
    """Pieces of a SentencePiece model with weights; encodes by forward filtering and backward sampling.

    Pieces only have spaces at their front, so the lattice of a text falls apart before each run
    of spaces (and around line breaks, if no piece holds one): such stretches are independent given
    the text. The different stretches of a batch are filtered forward together, then all their
    occurrences are sampled backward together. Places are bytes; a character that is no piece is
    walked through by the pieces of its bytes.
    """

    def __init__(self, path: str, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.surface: list[bytes] = [b""] * n
        self.bytes = np.zeros(256, np.int32)
        self.low = (n + OFFSET) ** -alpha
        pieces = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(SPACE, " ")
                if re.search(r"[^ ] |\n", text):
                    raise ValueError("pieces with spaces or line breaks inside aren't supported")
                self.surface[i] = text.encode()
                pieces.append((self.surface[i], i, (max(0.0, -model.get_score(i)) + OFFSET) ** -alpha))
        self.table = Table(pieces)
        self.of = {x: (i, w) for x, i, w in pieces}
        self.longest = max(len(x) for x in self.of)

    def edges(self, data: np.ndarray, sums: np.ndarray, down: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For stretches of ``size`` bytes: ids (or -1) and weights (or 0) by stretch, end and length of the piece that ends there."""
        n = len(begin)
        ids = np.full((n, size + 1, size + 1), -1, np.int32)
        weights = np.zeros((n, size + 1, size + 1))
        for a in range(size):
            at = begin + a
            for k in range(1, min(size - a, self.longest) + 1):
                row = self.table.find(mixed((sums[at + k] - sums[at]) * down[at] + np.uint64(k * LENGTH % (1 << 64))))
                ids[:, a + k, k], weights[:, a + k, k] = self.table.id[row], self.table.weight[row]
        raw = data[begin[:, None] + np.arange(size)]
        char = CHAR[raw]
        for a in range(size):
            for k in range(1, min(4, size - a) + 1):
                odd = np.flatnonzero((char[:, a] == k) & (ids[:, a + k, k] < 0))
                for b in range(a, a + k) if len(odd) else ():
                    ids[odd, b + 1, 1], weights[odd, b + 1, 1] = self.bytes[raw[odd, b]], self.low
        return ids, weights

    def sampled(self, ids: np.ndarray, weights: np.ndarray, row: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Segmentations of the stretches ``row``, each under its key: for each step back, which occurrences take it and their ids.

        Forward: the summed weight of all segmentations up to each place. Backward: the piece that
        ends at a place is drawn by its share of that sum.
        """
        size = ids.shape[1] - 1
        total = np.zeros((len(ids), size + 1))
        total[:, 0] = 1
        for b in range(1, size + 1):
            weights[:, b, 1 : b + 1] *= total[:, b - 1 :: -1] if b > 1 else total[:, :1]
            total[:, b] = weights[:, b].sum(axis=1)
        np.cumsum(weights, axis=2, out=weights)
        weights /= np.maximum(total, 1e-300)[:, :, None]
        who, place = np.arange(len(row)), np.full(len(row), size)
        while len(who):
            share = weights[row, place]
            k = (draws(keys, place)[:, None] >= share[:, :-1]).sum(axis=1)
            step = ids[row, place, k]
            lost = np.flatnonzero(step < 0)  # a draw that rounding put beyond the last share
            for i in lost:
                k[i] = np.flatnonzero(ids[row[i], place[i]] >= 0)[-1]
                step[i] = ids[row[i], place[i], k[i]]
            yield who, step
            place = place - k
            on = place > 0
            who, place, keys, row = who[on], place[on], keys[on], row[on]

    def long(self, unit: bytes, key: int) -> list[int]:
        """A long stretch: the same in logarithms, whose sums don't run out of range, with the same draws."""
        n, known = len(unit), self.of
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        odd, a = set(), 0
        while a < n:
            k = int(CHAR[unit[a]])
            if unit[a : a + k] not in known:
                odd.update(range(a, a + k))
            a += k
        for a in range(n):
            if a in odd:
                ends[a + 1].append((a, int(self.bytes[unit[a]]), log(self.low)))
            for b in range(a + 1, min(n, a + self.longest) + 1) if CHAR[unit[a]] else ():
                if got := known.get(unit[a:b]):
                    ends[b].append((a, got[0], log(got[1])))
        total = [0.0] + [-inf] * n
        for b in range(1, n + 1):
            terms = [total[a] + w for a, _, w in ends[b]]
            if terms and (top := max(terms)) > -inf:
                total[b] = top + log(sum(exp(t - top) for t in terms))
        u = draws(np.full(n, key, np.uint64), np.arange(1, n + 1)).tolist()
        out, b = [], n
        while b:
            x, chosen = u[b - 1], None
            for a, i, w in sorted(ends[b], reverse=True):  # short pieces first, as there
                if total[a] == -inf:
                    continue
                chosen = a, i
                x -= exp(total[a] + w - total[b])
                if x < 0:
                    break
            b = chosen[0]
            out.append(chosen[1])
        return out[::-1]

    def encode(self, texts: list[str | None], keys: list[str], seed: int = SEED) -> list[np.ndarray]:
        """Ids of each text. The draws depend on the row's key and ``seed`` alone, so a row's segmentation is the same in any run, order or partition."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        marks = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "little") for k in keys], np.uint64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        edge = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        if not n:
            return [np.empty(0, np.int32) for _ in raw]
        space, line = data == 0x20, data == 0x0A
        start = np.zeros(n, bool)
        start[1:] = line[1:] | line[:-1] | (space[1:] & ~space[:-1])
        start[edge[:-1][np.diff(edge) > 0]] = True
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, n))
        doc = np.searchsorted(edge, begin, "right") - 1
        nth = np.arange(len(begin)) - np.searchsorted(begin, edge[:-1])[doc]
        key = marks[doc] + (nth + 1).astype(np.uint64) * STEP
        up, down = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        whole = mixed((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64) * np.uint64(LENGTH))
        count = np.zeros(len(begin), np.int64)
        steps: list[tuple[np.ndarray, int, np.ndarray]] = []
        for k in np.unique(size).tolist():
            of = np.flatnonzero(size == k)
            if k > SHORT:
                for i in of.tolist():
                    ids = self.long(data[begin[i] : begin[i] + k].tobytes(), int(key[i]))
                    count[i] = len(ids)
                    steps.append((np.full(len(ids), i), -1, np.array(ids, np.int32)))
                continue
            _, one, row = np.unique(whole[of], return_index=True, return_inverse=True)
            part = max(1, (1 << 20) // (k + 1) ** 2)  # so many different stretches have arrays of some 12 MB
            by_row = np.argsort(row, kind="stable") if len(one) > part else None
            for lo in range(0, len(one), part):
                some = np.arange(len(of)) if by_row is None else by_row[np.searchsorted(row[by_row], lo) : np.searchsorted(row[by_row], lo + part)]
                ids, weights = self.edges(data, sums, down, begin[of[one[lo : lo + part]]], k)
                for t, (who, step) in enumerate(self.sampled(ids, weights, row[some] - lo, key[of[some]])):
                    at = of[some[who]]
                    count[at] += 1
                    steps.append((at, t, step))
        last = np.cumsum(count)
        out = np.empty(last[-1], np.int32)
        for at, t, step in steps:
            if t < 0:
                out[last[at[0]] - len(at) : last[at[0]]] = step
            else:
                out[last[at] - 1 - t] = step
        first = np.concatenate(([0], last))[np.searchsorted(begin, edge)]
        return [out[a:b] for a, b in zip(first, first[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.surface.__getitem__, ids.tolist())).decode()[1:]


_lattices: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, alpha: float) -> Lattice:
    """One for each worker process, model and weight."""
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattice(path, alpha)
    return _lattices[path, alpha]


def encoded(docs: DataFrame, model: str | None = None, alpha: float = ALPHA, seed: int = SEED, key_col: str = "doc_id", text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array ``out`` of piece ids, sampled from the lattice of each text under the row's key.

    An empty text has no ids, a null text null. Rows that repeat key and text get the same ids; a
    null key is a key like any other. Characters without a piece become the pieces of their bytes,
    so every text can be decoded. Other columns stay, one named ``out`` is replaced; an empty
    table gives no rows.
    """
    path = model or model_path()
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).schema.add(out, kind("array<int>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(path, alpha)
        for batch in slices(batches, text_col, TOGETHER):
            texts, keys = batch.column(text_col).to_pylist(), batch.column(key_col).to_pylist()
            ids = pieces.encode(texts, keys, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _lists(texts, ids)], [*kept, out])

    return docs.select(*kept).mapInArrow(lean(run), schema)


def _lists(texts: list[str | None], ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]), pa.int32()), mask=pa.array([t is None for t in texts], pa.bool_()))


def decoded(docs: DataFrame, model: str | None = None, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``docs`` with the string ``out``, the text of the ids; null ids give null. Other columns stay, one named ``out`` is replaced."""
    path = model or model_path()
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(path, ALPHA)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, np.int32)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    return docs.select(*kept).mapInArrow(lean(run), schema)


DIGEST = "doc_id long, n_pieces long, ids array<int>, text_crc32 long, lossless boolean"


def digested(docs: DataFrame, model: str | None = None, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids``, and the crc32 of the decoded text with whether it is the text itself.

    A null text has null ids, no pieces, crc32 0 and is lossless; an empty one has no ids. Rows that
    repeat id and text get the same ids; a null id is a key like any other. Other columns, whatever
    their names, are dropped; an empty table gives no rows.
    """
    path = model or model_path()
    docs = docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattice(path, ALPHA)
        for batch in slices(batches, "text", TOGETHER):
            texts, docs_ = batch.column("text").to_pylist(), batch.column("doc_id")
            ids = pieces.encode(texts, docs_.to_pylist())
            back = [None if t is None else pieces.decode(x) for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    docs_,
                    pa.array([len(x) for x in ids], pa.int64()),
                    _lists(texts, ids),
                    pa.array([zlib.crc32((t or "").encode()) for t in back], pa.int64()),
                    pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_pieces", "ids", "text_crc32", "lossless"],
            )

    return docs.select("doc_id", "text").mapInArrow(lean(run), DIGEST)


def op8_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every whole text of ``documents`` and whether they decode to it; nulls, empty texts, repeated rows, an empty table and other columns as in :func:`digested`."""
    return digested(table(spark, sf_dir, "documents"))
