"""Vectorised kernels over Arrow string columns: word bounds, word and shingle hashes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 uses none of these bytes
inside a longer character, so words of the bytes are words of the text. All kernels work on a
slice of a column at a time (``slices``), so memory follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.empty(max(n + 1, 1 << 16), dtype=np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        have = np.cumprod(have, dtype=np.uint64)
        if n < 8 * SLICE_BYTES:
            _powers[base] = have
    return have


_INVERSE = pow(_BASE, -1, 1 << 64)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = BASE**i times the polynomial hash of data[i:j], modulo 2**64."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    if len(data):
        np.cumsum(_BYTE[data] * powers(_BASE, len(data))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start] + (end - start).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, of one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of rows i..j of a column: start, end (in ``data``) and row (from 0)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, i: int, j: int):
        self.data = data[offsets[i] : offsets[j]]
        self.offsets = offsets[i : j + 1] - offsets[i]
        self.rows = j - i
        inside = ~_SPACE[self.data]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        before[edges] = False
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[self.offsets[1:][np.diff(self.offsets) > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)
        self.inside = inside

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, A-Z as a-z if ``lower``."""
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        return span_hash(prefix_hashes(data), self.start, self.end)


def ngram_hashes(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each window of n words within a row, and the index of its first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out *= np.uint64(_BASE)
        out ^= hashes[k : k + m]
        out ^= out >> np.uint64(29)
    first = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(out[first]), first
