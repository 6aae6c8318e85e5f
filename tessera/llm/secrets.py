"""Secret scans that unwrap nested encodings and map what they find back to the text."""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import kind, lean, slices, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal, so the length can be in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: Escapes that stand for one character each, with escapes of the escape sign itself taken in one step.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"(?<!\\)\\+(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
ENTITY = re.compile(r"&(?:amp;)*#(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same broken into lines of 64 or 76.
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/]{64}\r?\n)+[A-Za-z0-9+/]{0,64}={0,2}|(?:[A-Za-z0-9+/]{76}\r?\n)+[A-Za-z0-9+/]{0,76}={0,2}")
HEXED = re.compile(r"(?:[0-9a-f]{2}){12,}|(?:[0-9A-F]{2}){12,}")
#: Where compressed streams begin: gzip, bzip2, xz, zstandard. A zlib stream, whose mark is weak, is looked for at the front only.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Streams are decoded and scanned in chunks of so many bytes; a chunk is scanned with the end of the one before, as far as its last word begins or so many characters.
CHUNK, OVERLAP, WORD = 8 << 20, 1 << 16, 4 << 20
#: What ends an endless stream: all that one text's streams inflate to, and the memory that a stream may ask its decoder for. What is beyond is reported as "opaque".
INFLATED, DECODER = 1 << 30, 512 << 20


class Span(NamedTuple):
    start: int
    rank: int
    kind: str
    end: int


def scan(text: str) -> list[Span]:
    """Base matches, leftmost non-overlapping for each kind; code points, end exclusive."""
    found = [Span(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [Span(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)]
    return found + [Span(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]


def _point(digits: str, base: int = 16) -> str:
    n = int(digits, base)
    return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"


def _percent(run: str) -> list[tuple[int, int, str]]:
    """Pieces of a run of URL escapes: each escape with its character, or the whole run if some characters take several bytes."""
    ones = list(ONE.finditer(run))
    out = bytes.fromhex("".join(m[1] for m in ones)).decode("utf-8", "replace")
    return [(m.start(), m.end(), c) for m, c in zip(ones, out, strict=True)] if len(out) == len(ones) else [(0, len(run), out)]


class Layer(NamedTuple):
    """Decoded ``text``; characters from ``at[i]`` on come from ``of[i]`` on in the original, one by one if ``steps[i]`` is 1, else all from the stretch up to ``to[i]``."""

    text: str | None
    at: list[int]
    of: list[int]
    to: list[int]
    steps: list[int]
    depth: int

    def place(self, start: int, end: int) -> tuple[int, int]:
        i, k = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return self.of[i] + self.steps[i] * (start - self.at[i]), self.of[k] + end - self.at[k] if self.steps[k] else self.to[k]


def whole(text: str | None, start: int, end: int, depth: int) -> Layer:
    """A layer all of which comes from one stretch; None for the text of one that isn't decoded."""
    return Layer(text, [0], [start], [end], [0], depth)


def replaced(layer: Layer, pieces: list[tuple[int, int, str]]) -> Layer:
    """``layer`` with the stretches of ``pieces`` replaced; each new stretch maps to what it replaces."""
    text, out, size, done = layer.text, [], 0, 0
    at, of, to, steps = [], [], [], []

    def copied(a: int, b: int) -> None:
        nonlocal size
        i = bisect_right(layer.at, a) - 1
        while a < b:
            stop = min(b, layer.at[i + 1]) if i + 1 < len(layer.at) else b
            at.append(size)
            of.append(layer.of[i] + layer.steps[i] * (a - layer.at[i]))
            to.append(layer.to[i])
            steps.append(layer.steps[i])
            out.append(text[a:stop])
            size += stop - a
            a, i = stop, i + 1

    for a, b, new in pieces:
        copied(done, a)
        if new:
            low, high = layer.place(a, b)
            at.append(size)
            of.append(low)
            to.append(high)
            steps.append(0)
            out.append(new)
            size += len(new)
        done = b
    copied(done, len(text))
    return Layer("".join(out), at, of, to, steps, layer.depth + 1)


class Opaque(Exception):
    """A stream that asks for too much."""


def _decoder(head: bytes):
    """A new decoder for what begins with ``head``, or None: ``decompress(data, most)``, ``eof``, ``unused_data``."""
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=DECODER)
    if head[:3] == b"\x1f\x8b\x08" or _zlib(head):
        return zlib.decompressobj(47)
    return None


def _zlib(head: bytes) -> bool:
    return len(head) > 2 and head[0] & 0x0F == 8 and head[0] >> 4 < 8 and (head[0] << 8 | head[1]) % 31 == 0


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What a compressed stream holds, in chunks, with all of its members one after another; it ends where the stream is broken."""
    rest = next(pieces, b"")
    if rest[:4] == b"\x28\xb5\x2f\xfd":
        yield from _unzstd(chain([rest], pieces))
        return
    while (decoder := _decoder(rest)) is not None:
        try:
            while True:
                out = decoder.decompress(rest, CHUNK)
                rest = getattr(decoder, "unconsumed_tail", b"")
                if out:
                    yield out
                if decoder.eof:
                    rest = decoder.unused_data or next(pieces, b"")
                    break
                if not rest and (getattr(decoder, "needs_input", not out)):
                    rest = next(pieces, b"")
                    if not rest:
                        return
        except lzma.LZMAError as e:
            if "emory" in str(e):
                raise Opaque from e
            return
        except (zlib.error, OSError, EOFError, ValueError):
            return


def _unzstd(pieces: Iterator[bytes]) -> Iterator[bytes]:
    class Source:
        def __init__(self):
            self.held = b""

        def read(self, size: int) -> bytes:
            self.held = self.held or next(pieces, b"")
            out, self.held = self.held[:size], self.held[size:]
            return bytes(out)

    try:
        with zstandard.ZstdDecompressor(max_window_size=DECODER).stream_reader(Source(), read_across_frames=True) as stream:
            while out := stream.read(CHUNK):
                yield out
    except zstandard.ZstdError as e:
        if "emory" in str(e):
            raise Opaque from e


def _from(pieces: Iterator[bytes], at: int) -> Iterator[bytes]:
    """``pieces``, the first one from ``at`` on."""
    yield memoryview(next(pieces))[at:].tobytes()
    yield from pieces


def texts(pieces: Iterator[bytes]) -> Iterator[str]:
    """Bytes as text to scan: UTF-8, or a character for each byte where they aren't, without zero bytes (so ASCII in UTF-16 or UTF-32 is itself).

    More than a chunk comes as overlapping texts: of what is cut, the last word is in the next one too.
    """
    kept, decode = "", None
    for piece in pieces:
        plain = piece.replace(b"\0", b"")
        if decode is None:
            try:
                codecs.getincrementaldecoder("utf-8")().decode(plain)
                decode = codecs.getincrementaldecoder("utf-8")("replace").decode
            except UnicodeDecodeError:
                decode = codecs.getincrementaldecoder("latin-1")().decode
        text = kept + decode(plain)
        yield text
        last = max(text.rfind(c) for c in " \t\n\r")
        kept = text[max(0, len(text) - WORD, min(len(text) - OVERLAP, last)) :]


def contents(make: Callable[[], Iterator[bytes]], left: list[int], seen: set[bytes]) -> Iterator[str | None]:
    """Texts of the bytes that ``make`` gives, through any number of compressed layers; None stands for a stream that asks for too much.

    A layer that begins as one before it ends the descent (streams can hold themselves). ``left``
    holds how many bytes may still be inflated.
    """
    first = next(make(), b"")
    mark = hashlib.blake2b(first, digest_size=16).digest()
    if not first or mark in seen:
        return
    seen.add(mark)
    whole_stream = False
    for at in sorted({*(m.start() for m in MAGIC.finditer(first)), *[0] * _zlib(first)}):

        def inner(at: int = at) -> Iterator[bytes]:
            for x in inflated(_from(make(), at)):
                left[0] -= len(x)
                if left[0] < 0:
                    raise Opaque
                yield x

        try:
            if next(inner(), None) is not None:
                whole_stream |= at == 0
                yield from contents(inner, left, seen)
        except Opaque:
            whole_stream |= at == 0
            yield None
    if not whole_stream:
        yield from texts(make())


def _unbase64(run: str) -> Iterator[bytes]:
    """``run`` decoded from each of its first four letters on, since other letters of that alphabet may come before what is encoded."""
    body = re.sub(r"\s+", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    for at in range(4):
        part = body[at : len(body) - ((len(body) - at) % 4 == 1)]
        yield base64.b64decode(part + "=" * (-len(part) % 4))


def layers(layer: Layer, left: list[int]) -> Iterator[Layer]:
    """What ``layer`` encodes: itself with escapes of one kind replaced, and the content of each base64 or hexadecimal run. ``left``: bytes that may be inflated."""
    text = layer.text
    if "%" in text and (pieces := [(m.start() + a, m.start() + b, c) for m in PERCENT.finditer(text) for a, b, c in _percent(m[0])]):
        yield replaced(layer, pieces)
    if "\\" in text and (pieces := [(m.start(), m.end(), _point(m[1] or m[2] or m[3] or m[4])) for m in ESCAPE.finditer(text)]):
        yield replaced(layer, pieces)
    if "&" in text and (pieces := [(m.start(), m.end(), _point(m[1], 10) if m[1] else _point(m[2])) for m in ENTITY.finditer(text)]):
        yield replaced(layer, pieces)
    for m in chain(BASE64.finditer(text), WRAPPED.finditer(text) if "\n" in text else ()):
        for raw in _unbase64(m[0]):
            yield from (whole(x, *layer.place(*m.span()), layer.depth + 1) for x in contents(lambda raw=raw: iter([raw]), left, set()))
    for m in HEXED.finditer(text):
        yield from (whole(x, *layer.place(*m.span()), layer.depth + 1) for x in contents(lambda m=m: iter([bytes.fromhex(m[0])]), left, set()))


class Found(NamedTuple):
    base: list[Span]
    added: list[Span]
    depth: int


def find(text: str | None) -> Found:
    """Base spans of ``text``, the spans that decoded layers add, and the depth of the deepest layer that held a secret.

    The worklist starts with the text; each layer is scanned, and what it encodes joins the
    worklist until nothing is new. A layer seen before (its hash, and where it begins and ends in
    the original) isn't taken again, so cycles end. A span in a layer maps through the layers to
    the code points it came from: single escapes to their own places, the content of a base64,
    hexadecimal or compressed run to the whole run. A span found before isn't added again.
    """
    text = text or ""
    base = sorted(scan(text))
    known, added, deepest = {(s.start, s.end, s.kind) for s in base}, [], 0
    left = [INFLATED]
    seen, work = set(), deque([layers(Layer(text, [0], [0], [len(text)], [1], 0), left)])
    while work:
        layer = next(work[0], None)  # layers are made one at a time: a chunk of a long stream is let go before the next is decoded
        if layer is None:
            work.popleft()
            continue
        ends = layer.place(0, max(1, len(layer.text or "")))
        mark = (ends, layer.text is None or hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        for s in scan(layer.text) if layer.text is not None else [Span(0, len(KINDS), "opaque", 1)]:
            start, end = layer.place(s.start, s.end)
            if (start, end, s.kind) not in known:
                known.add((start, end, s.kind))
                added.append(Span(start, s.rank, s.kind, end))
                deepest = max(deepest, layer.depth)
        if layer.text:
            work.appendleft(layers(layer, left))
    return Found(base, sorted(added), deepest)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SPANS = "array<struct<kind:string,start:int,end:int,decoded:boolean>>"


def secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with the column ``out``: all spans of secrets of each text, in order; the other columns stay.

    A span has a kind (``assign``, ``access``, ``hex``, or ``opaque`` for compressed streams beyond
    ``INFLATED`` bytes in one text or ``DECODER`` bytes of a decoder's memory, whose rest is not decoded), code points of the original text, and whether it is of a decoded
    layer (URL escapes, Unicode or HTML escapes, base64, hexadecimal, gzip, zlib, bzip2, xz, zstandard).
    Null and empty texts have none. Every row is its own; an empty table gives no rows. A column
    named ``out`` is replaced.
    """
    schema = docs.drop(out).schema.add(out, kind(SPANS))
    kept = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("decoded", pa.bool_())]))
        for batch in slices(batches, text_col, 4 << 20):
            rows = []
            for text in batch.column(text_col).to_pylist():
                f = find(text)
                rows.append([{"kind": s.kind, "start": s.start, "end": s.end, "decoded": d} for s, d in sorted([(s, False) for s in f.base] + [(s, True) for s in f.added])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, ranges)], [*kept, out])

    return docs.select(*kept).mapInArrow(lean(run), schema)


def redact(text: str | None) -> str | None:
    """``text`` with each span of a secret, decoded or not, as ``<secret>``; overlapping spans are one."""
    if not text:
        return text
    f = find(text)
    out, at = [], 0
    merged: list[list[int]] = []
    for s in sorted(f.base + f.added):
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end])
    for a, b in merged:
        out += [text[at:a], "<secret>"]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``; all rows and columns stay. Null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 4 << 20):
            at, kind = batch.schema.get_field_index(text_col), batch.schema.field(text_col).type
            texts = [redact(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, kind))

    return docs.mapInArrow(lean(run), docs.schema)


DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, depth int"


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of ``documents``; null and empty texts have none, repeated rows agree, an empty table gives no rows, other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = [find(t) for t in batch.column("text").to_pylist()]
            counts = [[sum(s.kind == k for s in f.base) for f in found] for k in KINDS]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    **{f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=True)},
                    "base_sha256": [hashlib.sha256(joined(f.base).encode()).hexdigest() for f in found],
                    "spans": [joined(sorted(f.base + f.added)) for f in found],
                    "depth": pa.array([f.depth for f in found], pa.int32()),
                }
            )

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(lean(run), DIGEST)
