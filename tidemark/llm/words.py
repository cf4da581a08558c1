"""Words and word windows of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes that are not separators.  Its hash is a polynomial over the bytes
modulo 2**64, taken from prefix sums, so the work per byte is a few array operations.  Two different
words (or windows) share a hash with probability about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20  # bytes of text worked on at once; a longer document is a piece of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words made of letters: everything but ASCII letters and bytes of multi-byte characters.
NO_LETTER = np.ones(256, bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xCA9B0C3EBA1BAE2D)
    return x ^ (x >> U64(32))


BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * U64(_BASE))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"][:n], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or of one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high
        low = high


class Words:
    """Words of some documents: ``start``/``end`` are byte positions, ``first[i]:first[i + 1]`` those of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = ~separator[self.data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self._sums: np.ndarray | None = None

    def hashes(self, end: np.ndarray | None = None) -> np.ndarray:
        """Of the words, or of their bytes before ``end``."""
        end = self.end if end is None else end
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(BYTE[self.data] * up[:-1], out=self._sums[1:])
        return _mix((self._sums[end] - self._sums[self.start]) * down[self.start] + (end - self.start).astype(np.uint64))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` consecutive values from each position; those that run over the end are missing."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * U64(_STEP) + hashes[j: j + n]
    return _mix(total)


def inside(first: np.ndarray, size: int) -> np.ndarray:
    """Positions whose window of ``size`` words stays in its document."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(left >= size)


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All integers of the ranges low[i] .. high[i] - 1, one after the other."""
    sizes = np.maximum(high - low, 0)
    total = np.repeat(high - np.cumsum(sizes), sizes)
    return total + np.arange(int(sizes.sum()))


def row_of(first: np.ndarray) -> np.ndarray:
    """Document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
