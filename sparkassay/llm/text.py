"""Vectorised views of UTF-8 text in Arrow batches: words, lines and hashes without a Python loop per word.

A word is a run of bytes outside space and 0x09-0x0D. Hashes are 64-bit polynomials of the bytes, finished by a mixer;
equal byte strings always have equal hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n; kept for the next chunk, but not those of a longer text."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(max(n, CHUNK_BYTES) + 1, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    if n <= CHUNK_BYTES:
        _powers[:] = out
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def plain(column) -> pa.Array:
    """A string or binary column as large binary without nulls; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a ``plain`` array and the limits of its values."""
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, limit: int = CHUNK_BYTES):
    """(first, last) row ranges of a ``plain`` array of about ``limit`` bytes each; a longer value stands alone."""
    _, at = raw(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, len(column))
        first = last


class Hashes:
    """Hashes of any spans of one byte array, from one cumulative sum."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(flags: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and value numbers of the runs of true flags; no run crosses a limit."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    inside = limits[(limits > 0) & (limits < len(flags))]
    first[inside] = flags[inside]
    last[inside - 1] = flags[inside - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(limits, start, "right") - 1


def words(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and value numbers of all words."""
    return runs(~SPACE[data], limits)


def lines(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and value numbers of all non-empty stretches between line feeds."""
    return runs(data != 10, limits)


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of one value, and the place of its first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out *= np.uint64(0xF1357AEA2E62A9C5)
        out += h[i : len(h) - k + 1 + i]
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    return mix(out[at] ^ np.uint64(k)), at
