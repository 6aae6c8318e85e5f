"""Token ids in binary segments: one zstandard frame for each document, a shared trained dictionary and an offset index."""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.storage import discarded, scratch, stored

from .common import lean, slices, table
from .words import LENGTH, LOWER, mixed

TOKENIZER = "word_bpe_49k.json"
END = 1
#: The dictionary's size and the bounded sample of whole documents it is trained on: so many of them, and so many bytes of text, at most.
DICTIONARY, SAMPLE, SAMPLE_BYTES = 64 << 10, 2000, 8 << 20
#: A segment is closed at so many bytes or documents.
SEGMENT_BYTES, SEGMENT_DOCS = 4 << 20, 8192
MAGIC = b"TZID1\n"
HEAD = struct.Struct("<6s32sBQQ")

SEGMENTS = "part int, seq int, first_doc long, last_doc long, n_docs long, n_tokens long, data binary"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What the tokenizer's pattern tells apart: white space, letters, other signs, and digits, each a piece of its own.
SPACE, LETTER, OTHER, DIGIT = range(4)
#: Kinds of bytes; those of longer characters are letters but for what ``split`` finds.
KINDS = np.full(256, OTHER, np.uint8)
KINDS[0x09:0x0E] = KINDS[0x20] = SPACE
KINDS[0x30:0x3A] = DIGIT
KINDS[0x61:0x7B] = KINDS[0x80:] = LETTER
#: Kinds of the characters U+0080 to U+00BF by their second byte.
LATIN = np.full(256, OTHER, np.uint8)
LATIN[[0x85, 0xA0]] = SPACE
LATIN[[0xAA, 0xB5, 0xBA]] = LETTER
LATIN[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
#: A text can be cut behind white space and digits, and between a letter and a sign, without cutting a piece; here those of one byte, in either case.
CUT = (np.arange(256) < 0x80) & ((KINDS == SPACE) | (KINDS == DIGIT))
LETTERS = (np.arange(256) < 0x80) & (KINDS[LOWER] == LETTER)
SIGNS = (np.arange(256) < 0x80) & (KINDS[LOWER] == OTHER)
#: Zero bytes behind the bytes of a stretch, so that a piece's last words can be read whole.
PAD = 40


def odd(data: np.ndarray) -> np.ndarray:
    """Places of first bytes of characters beyond U+012F, but for dashes, quotation marks, dots and the like and the euro sign."""
    at = np.flatnonzero(data >= 0xC4)
    first, second, third = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    dash = (second == 0x80) & (((third >= 0x90) & (third <= 0xA7)) | ((third >= 0xB0) & (third <= 0xB8)))
    return at[~np.where(first == 0xC4, second <= 0xAF, (first == 0xE2) & (dash | ((second == 0x82) & (third == 0xAC))))]


def split(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text without odd characters in lower case, with ``PAD`` zeros behind, and begin and end of its pieces."""
    n = len(data)
    low = np.zeros(n + PAD, np.uint8)
    low[:n] = LOWER[data]
    kinds = KINDS[low[:n]]
    lead = np.flatnonzero(data >= 0xC2)
    byte = data[lead]
    low[lead[byte == 0xC4] + 1] |= 1  # U+0100 to U+012F: of two, the even one is the capital
    accents, twos, threes = (lead[byte == k] for k in (0xC3, 0xC2, 0xE2))
    second = low[accents + 1]
    sign = (second == 0x97) | (second == 0xB7)
    low[accents[(second <= 0x9E) & ~sign] + 1] += 0x20
    kinds[twos] = kinds[twos + 1] = LATIN[low[twos + 1]]
    for at, size in ((accents[sign], 2), (threes, 3)):
        for k in range(size):
            kinds[at + k] = OTHER
    start = np.ones(n, bool)
    start[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT)
    start[twos + 1] = False
    quote = np.flatnonzero(low[:n] == 0x27)
    quote = quote[start[quote]]
    a, b = low[quote + 1], low[quote + 2]
    size = np.where(np.isin(a, ENDINGS), 1, 2 * (((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)))
    quote, size = quote[size > 0], size[size > 0]  # 's 't 'm 'd, 're 've 'll
    start[quote + 1] = False
    behind = quote + 1 + size
    start[behind[behind < n]] = True
    edge = np.flatnonzero(start)
    inside = kinds[edge] != SPACE
    return low, edge[inside], np.append(edge[1:], n)[inside]


ENDINGS = np.frombuffer(b"stmd", np.uint8)


class Known:
    """Ids of pieces, looked up as arrays of occurrences.

    Open addressing by a hash of a piece's bytes, taken as 64-bit words; its length and all its
    words are compared, so what is found is the piece itself. A full table keeps the pieces that
    were met again since the last time, if they fill half of it at most.
    """

    WORDS, BITS, BLOCK = 4, 21, 1 << 18
    LONGEST = 8 * WORDS
    MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    MIX = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

    def __init__(self, dtype: np.dtype, most: int):
        self.most = most
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        room = most + self.BLOCK
        self.size, self.again = np.zeros(room, np.uint8), np.zeros(room, bool)
        self.word = np.empty((self.WORDS, room), np.uint64)
        self.first, self.count = np.empty(room, np.int32), np.empty(room, np.int32)
        self.ids, self.n, self.used = np.empty(1 << 20, dtype), 0, 0

    def words(self, low: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The 64-bit words of pieces: those that have a first, second ... word, and these words."""
        at = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        out = [(np.arange(len(begin)), at[begin] & self.MASK[np.minimum(size, 8)])]
        for k in range(8, self.LONGEST, 8):
            of = np.flatnonzero(size > k)
            out.append((of, at[begin[of] + k] & self.MASK[np.minimum(size[of] - k, 8)]))
        return out

    def home(self, size: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        h = words[0][1] + size.astype(np.uint64) * np.uint64(LENGTH)
        for m, (of, w) in zip(self.MIX[1:], words[1:], strict=True):
            h[of] += mixed(w) * m
        return (mixed(h) >> np.uint64(64 - self.BITS)).astype(np.int32)

    def probed(self, size: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], at: np.ndarray) -> np.ndarray:
        """The piece of each occurrence, or -1; ``at`` comes to be where the search ended."""
        entry = self.slot[at]
        same = (self.size[entry] == size) & (self.word[0][entry] == words[0][1]) & (entry >= 0)
        for k, (of, w) in enumerate(words[1:], 1):
            same[of] &= self.word[k][entry[of]] == w
        left = np.flatnonzero(~same & (entry >= 0))
        entry[left] = -1
        if len(left):
            full = self.full(len(size), words, left)
        rows = np.arange(len(left))
        while len(rows):
            at[left[rows]] = (at[left[rows]] + 1) & ((1 << self.BITS) - 1)
            found = self.slot[at[left[rows]]]
            same = (found >= 0) & (self.size[found] == size[left[rows]]) & (self.word[:, found] == full[:, rows]).all(axis=0)
            entry[left[rows[same]]] = found[same]
            rows = rows[~same & (found >= 0)]
        return entry

    def full(self, n: int, words: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> np.ndarray:
        """All words of some occurrences, zeros where a piece has ended."""
        out, whole = np.empty((self.WORDS, len(rows)), np.uint64), np.empty(n, np.uint64)
        for k, (of, w) in enumerate(words):
            whole[:] = 0
            whole[of] = w
            out[k] = whole[rows]
        return out

    def placed(self, size: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Give pieces that aren't in the table, from empty slots on, new numbers: the number of each occurrence, and one occurrence for each new number."""
        claim, owner, rows = self.most + self.BLOCK, np.empty(len(size), np.int32), np.arange(len(size), dtype=np.int32)
        while len(rows):
            free = rows[self.slot[at[rows]] < 0]
            self.slot[at[free]] = claim + free  # one of those that want a slot gets it
            who = self.slot[at[rows]] - claim
            same = who >= 0
            who = np.maximum(who, 0)
            same &= (size[who] == size[rows]) & (word[:, who] == word[:, rows]).all(axis=0)
            owner[rows[same]] = who[same]
            rows = rows[~same]
            at[rows] = (at[rows] + 1) & ((1 << self.BITS) - 1)
        new = np.flatnonzero(owner == np.arange(len(size)))
        number = np.empty(len(size), np.int32)
        number[new] = self.n + np.arange(len(new))
        self.slot[at[new]] = number[new]
        self.size[number[new]], self.word[:, number[new]] = size[new], word[:, new]
        self.again[number[new]] = False
        self.n += len(new)
        return number[owner], new

    def put(self, first: int, ids: np.ndarray, count: np.ndarray) -> None:
        """The ids of the pieces numbered from ``first`` on."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids[: self.used], np.empty(max(len(self.ids), len(ids)), self.ids.dtype))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[first : first + len(count)] = self.used + np.cumsum(count) - count
        self.count[first : first + len(count)] = count
        self.used += len(ids)

    def cleared(self) -> None:
        kept = np.flatnonzero(self.again[: self.n])
        if 2 * len(kept) > self.most:
            kept = kept[:0]
        size, word, count, first = self.size[kept], self.word[:, kept], self.count[kept], self.first[kept]
        ids = self.ids[spread(first, count)]
        self.slot[:], self.n, self.used = -1, 0, 0
        if len(kept):
            every = np.arange(len(kept))
            at = self.home(size, [(every, word[0]), *((of := np.flatnonzero(size > 8 * k), word[k][of]) for k in range(1, self.WORDS))])
            _, new = self.placed(size, word, at)
            if len(new) != len(kept):
                raise AssertionError("a piece was there twice")
            self.put(0, ids, count)

    def find(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all occurrences one after another, and how many each has; ``encode`` gives them for new pieces. At most ``BLOCK`` occurrences."""
        if self.n + len(begin) > self.most:
            self.cleared()
        size = end - begin
        long = np.flatnonzero(size > self.LONGEST)
        short = np.flatnonzero(size <= self.LONGEST) if len(long) else np.arange(len(size))
        some = size[short]
        words = self.words(low, begin[short], some)
        at = self.home(some, words)
        number = self.probed(some, words, at)
        self.again[number[number >= 0]] = True
        miss = np.flatnonzero(number < 0)
        fresh, n = [], self.n
        if len(miss):
            number[miss], new = self.placed(some[miss], self.full(len(some), words, miss), at[miss])
            fresh = [low[a:b].tobytes() for a, b in zip(begin[short[miss[new]]].tolist(), end[short[miss[new]]].tolist(), strict=True)]
        out = np.empty(len(size), np.int32)
        out[short] = number
        used = self.used
        if fresh:
            self.put(n, *encode(fresh))
            used = self.used
        if len(long):  # numbers behind the others, until the next call
            longer: dict[bytes, int] = {}
            out[long] = [longer.setdefault(low[a:b].tobytes(), self.n + len(longer)) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
            self.put(self.n, *encode(list(longer)))
        count = self.count[out]
        ids = self.ids[spread(self.first[out], count)]
        self.used = used
        return ids, count


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``first`` and have ``count`` places."""
    last = np.cumsum(count)
    return np.repeat(first - (last - count), count) + np.arange(last[-1] if len(last) else 0)


class Encoder:
    """Ids of whole texts as little-endian bytes.

    A tokenizer that lower-cases, drops white space and splits letters, digits and other signs
    treats each such piece by itself, so pieces are encoded by the library once and kept (a
    bounded number of them); texts are split and pieces looked up as arrays. Texts with characters
    for which that isn't certain (normalisation, special tokens) and other tokenizers go through
    the library whole. So does one text in ``ASSURED``, to compare: should they ever differ, all
    go whole from then on.
    """

    SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    #: Bytes of text split at once; pieces kept; pieces for one call of the library.
    STRETCH, KEPT, JOINED, ASSURED = 1 << 18, 1 << 20, 500, 256

    def __init__(self, path: str):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.library.to_str())
        steps = [(x["type"], x.get("pattern", {}).get("Regex"), x.get("content")) for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
        self.by_piece = (
            steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
            and split[0].get("pattern", {}).get("Regex") == self.SPLIT
            and split[0].get("invert") is True
            and split[-1].get("type") == "ByteLevel"
            and not split[-1].get("add_prefix_space")
            and not spec["model"].get("dropout")
        )
        #: The same model for pieces, which the normaliser and the splitter have nothing left to do with.
        self.model = Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [x["content"].encode() for x in spec["added_tokens"]]
        self.known = Known(self.dtype, self.KEPT)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single pieces one after another, and how many each has: the library takes many in one text, which it splits at the spaces again."""
        ids, count = [], []
        for k in range(0, len(pieces), self.JOINED):
            some = pieces[k : k + self.JOINED]
            got = self.model.encode(b" ".join(some).decode(), add_special_tokens=False)
            word = np.array(got.word_ids, np.int64)
            if len(word) and word[-1] + 1 == len(some):
                ids.append(np.array(got.ids, self.dtype))
                count.append(np.bincount(word, minlength=len(some)))
            else:
                each = [np.frombuffer(x, self.dtype) for x in self._whole([x.decode() for x in some])]
                ids.append(np.concatenate(each))
                count.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(count)

    def _stretches(self, data: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of some ``STRETCH`` bytes that end where no piece goes on."""
        a, n = 0, len(data)
        while a < n:
            b, k = min(n, a + self.STRETCH), 1 << 12
            while b < n:
                now, then = data[b - 1 : min(n, b + k) - 1], data[b : b + k]
                hit = CUT[now] | (LETTERS[now] & SIGNS[then])
                if hit.any():
                    b += int(hit.argmax())
                    break
                b, k = min(n, b + k), 2 * k
            yield a, b
            a = b

    def _split(self, raw: list[bytes]) -> list[bytes]:
        """Ids of texts by their pieces."""
        data = np.frombuffer(b"\n".join(raw), np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
        cuts, out, total = np.zeros(len(begins), np.int64), [np.empty(0, self.dtype)], 0
        for a, b in self._stretches(data):
            low, begin, end = split(data[a:b])
            before = np.zeros(len(begin) + 1, np.int64)
            for k in range(0, len(begin), self.known.BLOCK):
                ids, count = self.known.find(low, begin[k : k + self.known.BLOCK], end[k : k + self.known.BLOCK], self._pieces)
                out.append(ids)
                before[k + 1 : k + 1 + len(count)] = count
            before = total + np.cumsum(before)
            lo, hi = np.searchsorted(begins, (a, b))
            cuts[lo:hi] = before[np.searchsorted(begin, begins[lo:hi] - a)]
            total = before[-1]
        cuts[np.searchsorted(begins, len(data)) :] = total
        ids = np.concatenate(out)
        return [ids[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        if not self.by_piece or not texts:
            return self._whole(texts)
        raw = [t.encode() for t in texts]
        joined = b"\n".join(raw)
        ends = np.cumsum([len(x) + 1 for x in raw])
        plain = np.ones(len(raw), bool)
        plain[np.searchsorted(ends, odd(np.frombuffer(joined, np.uint8)), "right")] = False
        for s in self.special:
            if s in joined:
                plain &= [s not in x for x in raw]
        del joined
        whole = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        split = iter(self._split([x for x, p in zip(raw, plain, strict=True) if p]))
        out = [next(split) if p else next(whole) for p in plain]
        assured = [i for i, (x, p) in enumerate(zip(raw, plain, strict=True)) if p and zlib.crc32(x) % self.ASSURED == 0]
        if self._whole([texts[i] for i in assured]) != [out[i] for i in assured]:
            self.by_piece = False
            return self._whole(texts)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer, so that what it keeps serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of ``samples``; where there are too few to train one, their last bytes serve."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


class Document(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray


def packed(docs: list[tuple[int | None, int, bytes]], start: int, dictionary_hash: bytes, dtype: np.dtype) -> bytes:
    """A segment: head, ids of the documents, whether each is null, their starts, offsets of their frames, and the frames."""
    n = len(docs)
    starts = start + np.concatenate(([0], np.cumsum([x[1] for x in docs]))).astype("<u8")
    offsets = np.concatenate(([0], np.cumsum([len(x[2]) for x in docs]))).astype("<u8")
    return b"".join(
        [
            HEAD.pack(MAGIC, dictionary_hash, dtype.itemsize, n, start),
            np.array([x[0] or 0 for x in docs], "<i8").tobytes(),
            np.array([x[0] is None for x in docs], bool).tobytes(),
            starts.tobytes(),
            offsets.tobytes(),
            *(x[2] for x in docs),
        ]
    )


def opened(data: bytes, dictionary: bytes, wanted: set[int] | None = None) -> Iterator[Document]:
    """The documents of a segment, or only those ``wanted``; other frames aren't decompressed."""
    magic, mark, width, n, _ = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    if mark != hashlib.sha256(dictionary).digest():
        raise ValueError("the segment was written with another dictionary")
    at = HEAD.size
    ids = np.frombuffer(data, "<i8", n, at)
    nulls = np.frombuffer(data, bool, n, at := at + 8 * n)
    starts = np.frombuffer(data, "<u8", n + 1, at := at + n)
    offsets = np.frombuffer(data, "<u8", n + 1, at := at + 8 * (n + 1)).astype(np.int64) + at + 8 * (n + 1)
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    for i in range(n):
        if wanted is None or (not nulls[i] and int(ids[i]) in wanted):
            raw = unpack.decompress(data[offsets[i] : offsets[i + 1]])
            yield Document(None if nulls[i] else int(ids[i]), int(starts[i]), np.frombuffer(raw, f"<u{width}"))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` in ascending id order and write ``path/segments``, ``path/parts`` and ``path/dictionary``.

    Segments are binary values of a Parquet table, so any store that Spark writes to will do and a
    lost executor's output is never half-visible. Each is a file image of its own: magic, the
    dictionary's SHA-256, offset index, and a frame for each document. ``parts`` holds how many
    ids come before each part of the id range; a segment's starts count from its part.

    Texts are encoded and compressed where they are; what is written, ranged by id and packed
    is their frames. A null or empty text is a document of the end id alone. Null ids come first.
    Rows that repeat an id are all kept, in order of their texts' hashes. An empty table writes
    empty tables. Extra columns aren't written, whatever their names.
    """
    spark, file = docs.sparkSession, tokenizer or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tail = np.array([end], encoder(file).dtype).tobytes()
    dictionary = trained([x + tail for x in encoder(file).encode(_sample(rows))])
    mark = hashlib.sha256(dictionary).digest()
    spark.createDataFrame([(bytearray(dictionary), mark.hex())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(file)
        last = np.array([end], known.dtype).tobytes()
        pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_content_size=True)
        for batch in slices(batches, "text", 4 << 20):
            texts = batch.column("text").to_pylist()
            ids = known.encode(texts)
            n = [len(x) // known.dtype.itemsize + 1 for x in ids]
            ties = [int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little", signed=True) for t in texts]
            frames = pa.array([pack.compress(x + last) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ties, pa.int64()), pa.array(n, pa.int64()), frames], ["doc_id", "tie", "n", "frame"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(file)
        held: list[tuple[int | None, int, bytes]] = []
        seq = size = start = part = 0

        def closed() -> pa.RecordBatch:
            nonlocal held, seq, size, start
            tokens, ids = sum(x[1] for x in held), [x[0] for x in held if x[0] is not None]
            row = (part, seq, min(ids, default=None), max(ids, default=None), len(held), tokens, packed(held, start, mark, known.dtype))
            held, seq, size, start = [], seq + 1, 0, start + tokens
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, SCHEMA.types, strict=True)], schema=SCHEMA)

        for batch in slices(batches, "frame", 4 << 20):
            part = batch.column("part")[0].as_py()
            for doc, n, frame in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                held.append((doc, n, frame))
                size += len(frame)
                if size >= SEGMENT_BYTES or len(held) >= SEGMENT_DOCS:
                    yield closed()
        if held:
            yield closed()

    frames = stored(rows.mapInArrow(lean(encode), "doc_id long, tie long, n long, frame binary"), "frames")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = frames.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ranged.select(F.spark_partition_id().alias("part"), "doc_id", "n", "frame").mapInArrow(lean(segments), SEGMENTS).write.parquet(f"{path}/segments")
    discarded(frames)
    sums = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part of the range
    sums.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base")).write.parquet(f"{path}/parts")


def _sample(rows: DataFrame) -> list[str]:
    """At most ``SAMPLE`` whole texts of ``SAMPLE_BYTES`` together, by the hash of the id; longer ones than that are passed over."""
    n = rows.count()
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    some = rows.where(mark < int((1 << 40) * min(1, 1.5 * SAMPLE / max(n, 1)))).select(mark.alias("mark"), F.octet_length("text").alias("size"), "text").where("size > 0")
    chosen, total = [], 0
    for r in some.select("mark", "size").orderBy("mark", "size").limit(SAMPLE).collect():
        if total + r["size"] <= SAMPLE_BYTES:
            chosen.append((r["mark"], r["size"]))
            total += r["size"]
    if not chosen:
        return []
    wanted = some.sparkSession.createDataFrame(sorted(set(chosen)), "mark long, size int")
    return [r["text"] for r in some.join(F.broadcast(wanted), ["mark", "size"], "left_semi").orderBy("mark", "size").select("text").limit(len(chosen)).collect()]


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read(spark: SparkSession, path: str, only: list[int] | None = None, ids: bool = True) -> DataFrame:
    """Documents from the files of :func:`write`: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, with ``ids``, the ids themselves.

    With ``only``, segments that can't hold those documents are skipped by the scan, and of the
    others just the frames asked for are decompressed. Rows that repeat an id are all returned;
    files of an empty table give no rows.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    if only is not None:
        hit = F.lit(False)
        for x in only:
            hit = hit | ((F.col("first_doc") <= x) & (F.col("last_doc") >= x))
        segments = segments.where(hit)
    bases = spark.read.schema("part int, base long").parquet(f"{path}/parts")  # as many rows as parts
    wanted = None if only is None else set(only)
    schema = READ.append(pa.field("ids", pa.list_(pa.int32()))) if ids else READ

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("data"), strict=True):
                rows = [(d.doc_id, base + d.start, len(d.ids), zlib.crc32(d.ids.astype("<u4").tobytes()), *([d.ids.astype(np.int32)] if ids else [])) for d in opened(data.as_py(), dictionary, wanted)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return segments.join(F.broadcast(bases), "part").select("base", "data").mapInArrow(lean(decode), out)


def op7_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as token ids and read back; nulls, empty texts, repeated ids and an empty table as in :func:`write`."""
    path = scratch(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, ids=False)
