"""Hashes of all words of many texts at once, in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, with a random number
for each byte value: differences of one running sum, so the work is a few
passes over the bytes, whatever the number of words. Long words could be built
to collide there (Thue-Morse orders of two letters); words of more than LONG
bytes have a BLAKE2 digest instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
SLICE = 1 << 18
LONG = 32
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
VALUE = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64)


class Texts(NamedTuple):
    """Texts of some rows as one run of UTF-8 bytes: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, in order: hash, row of its text, place of its first byte."""

    hash: np.ndarray
    row: np.ndarray
    start: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, Texts]]:
    """Consecutive rows of a string column, about size bytes at a time: (first row, texts). Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, raw = column.buffers()
    off = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, Texts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, n of each; kept up to a slice's length."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, SLICE + 1)
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        step = np.full(size, base, np.uint64)
        step[0] = 1
        made.append(np.cumprod(step, dtype=np.uint64))
    if size <= 2 * SLICE:
        _powers = tuple(made)
    return tuple(made)


def words(texts: Texts, lower: bool = True) -> Words:
    """All words of the texts. A text far longer than a slice is cut at blanks, so memory is bounded by its bytes. Without lower, case counts."""
    n = len(texts.data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    inside = ~BLANK[texts.data]
    edge = np.zeros(n + 1, bool)
    edge[texts.offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    parts = []
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + 2 * SLICE, "right")))
        at, to = int(start[lo]), int(end[hi - 1])
        power, inverse = _power_tables(to - at)
        total = np.zeros(to - at + 1, np.uint64)
        value = VALUE[LOWER] if lower else VALUE
        np.cumsum(value[texts.data[at:to]] * power[: to - at], out=total[1:])
        s, e = start[lo:hi] - at, end[lo:hi] - at
        parts.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)))
        lo = hi
    row = np.repeat(np.arange(len(texts.offsets) - 1), np.diff(np.searchsorted(start, texts.offsets)))
    made = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    for i in np.flatnonzero(end - start > LONG):
        raw = texts.data[start[i] : end[i]]
        made[i] = int.from_bytes(blake2b((LOWER[raw] if lower else raw).tobytes(), digest_size=8).digest(), "little")
    return Words(made, row, start)


def line_numbers(texts: Texts, w: Words) -> np.ndarray:
    """For each word the number of \\n before it in its text."""
    before = np.zeros(len(texts.data) + 1, np.int32)
    np.cumsum(texts.data == 10, out=before[1:])
    return (before[w.start] - before[texts.offsets[:-1]][w.row]).astype(np.int64)
