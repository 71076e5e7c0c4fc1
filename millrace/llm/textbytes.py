"""Vectorised work on the UTF-8 bytes of many texts at once.

A hash of any byte range comes from prefix sums of (byte + 1) * base^position modulo the prime 2^31 - 1, for two bases, so that hashing
all words of a block takes a few passes of numpy and no loop over words. Two different ranges of n bytes have one hash with a probability
of about (n / 2^31)^2 at most over the choice of bases: unlike a modulus that is a power of two, a prime has no strings that collide
whatever the base (Thue-Morse words do so modulo 2^64). Where equality of single strings decides and bytes are at hand, callers compare
those as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_146_297_863, 1_806_572_641)
_31, _LIFT = np.uint64(31), np.uint64(2) * PRIME
#: Texts are worked on in blocks of about so many bytes; a longer text is a block of its own.
BLOCK = 1 << 20
#: So many products of a byte and a residue add up without overflow.
_RUN = 1 << 23
_powers: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """Something equal modulo PRIME, below 2^31 + 4 for any 64-bit x."""
    x = (x & PRIME) + (x >> _31)
    return (x & PRIME) + (x >> _31)


def powers(base: int, n: int) -> np.ndarray:
    """base^i modulo PRIME, for i up to n at least."""
    if base not in _powers or len(_powers[base]) <= n:
        size, out, done = max(n, BLOCK) + 1, np.ones(1, np.uint64), 1
        while done < size:
            out = np.concatenate((out, _fold(out[: size - done] * np.uint64(pow(base, done, int(PRIME))))))
            done = len(out)
        _powers[base] = _fold(out)
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, so that any of their bits are as good as others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix(buf: np.ndarray) -> np.ndarray:
    """For each base a row of sums, for range_hash()."""
    out, value = np.zeros((len(BASES), len(buf) + 1), np.uint64), buf.astype(np.uint64) + np.uint64(1)
    for row, base in zip(out, BASES, strict=True):
        up = powers(base, len(buf))
        for a in range(0, len(buf), _RUN):
            b = min(len(buf), a + _RUN)
            np.cumsum(value[a:b] * up[a:b], out=row[a + 1 : b + 1])
            if a:
                row[a + 1 : b + 1] = _fold(row[a + 1 : b + 1]) + row[a]
        if len(buf) > _RUN:
            row[:] = _fold(row)
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = None
    for row, base in zip(sums, BASES, strict=True):
        down = powers(pow(base, -1, int(PRIME)), sums.shape[1])
        x = _fold(_fold(row[end] + _LIFT - row[start]) * down[start])
        x = (x + ((x + np.uint64(1)) >> _31)) & PRIME
        out = x if out is None else out | (x << _31)
    return mix(out)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


#: Bytes that end a term: ASCII but letters and digits.
NO_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(buf: np.ndarray, offsets: np.ndarray, ends: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts of a block, and the first word of each text (one entry more than texts).
    A word ends where its text ends, or at a byte marked in `ends`."""
    solid = ~ends[buf]
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[(offsets < len(buf))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    stop = offsets[offsets > 0] - 1
    last[stop] = solid[stop]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without a copy; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(batch: pa.RecordBatch, col: str = "text", limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows with about limit bytes each."""
    column = batch.column(batch.schema.get_field_index(col))
    data, offsets = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi

