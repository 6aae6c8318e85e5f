"""Words of whole Arrow text batches as arrays: no Python object for each word."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
LENGTH = 0xD6E8FEB86659FD93
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z. All bytes of non-ASCII characters are 0x80 and over.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Words(NamedTuple):
    """The words of a batch in order. ``row``: index of each word's text; ``begin``, ``end``: bytes in ``data``; ``of``: first word of each text, and their number."""

    row: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    of: np.ndarray
    data: np.ndarray


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers from 0 to ``n``. Made anew each time, as products of few, so that a worker holds no long tables."""
    return tuple(_powers(b, n) for b in (BASE, pow(BASE, -1, 1 << 64)))


def _powers(base: int, n: int, low: int = 1 << 11) -> np.ndarray:
    first = np.cumprod(np.r_[np.uint64(1), np.full(low - 1, base, np.uint64)], dtype=np.uint64)
    far = np.cumprod(np.r_[np.uint64(1), np.full(n // low, pow(base, low, 1 << 64), np.uint64)], dtype=np.uint64)
    return np.multiply.outer(far, first).ravel()[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and each text's offset in them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, inside: np.ndarray = ALNUM, lower: np.ndarray = LOWER) -> Words:
    """Maximal runs of the bytes ``inside``, hashed over what ``lower`` makes of them (A-Z to a-z) to 64 bits."""
    data, offsets = raw(texts)
    n = len(data)
    mask = inside[data]
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, mask
    after = np.empty(n + 1, bool)
    after[:n], after[n] = mask, False
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first, last = before[:n].copy(), after[1:].copy()
    first[cuts] = False
    last[cuts - 1] = False
    begin = np.flatnonzero(mask & ~first)
    end = np.flatnonzero(mask & ~last) + 1
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((lower[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    value = mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(LENGTH))
    of = np.searchsorted(begin, offsets)
    return Words(np.repeat(np.arange(len(offsets) - 1), np.diff(of)), begin, end, value, of, data)
