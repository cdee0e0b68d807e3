"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes other than space and 0x09-0x0D. Work goes block by block, so memory
follows the block size and not the batch; a text longer than a block is scanned in pieces that end at
white space. Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_ROWS = np.random.Generator(np.random.PCG64(0x1EAF)).integers(0, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    global _powers
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            step = np.full(n, _BASE, dtype=np.uint64)
            back = np.full(n, _BASE_INVERSE, dtype=np.uint64)
            step[0] = back[0] = 1
            _powers = (np.multiply.accumulate(step), np.multiply.accumulate(back))
    return _powers


def tidy(run: Callable) -> Callable:
    """A batch function that gives freed memory back to the system when its task ends: workers are used again."""
    @functools.wraps(run)
    def tidied(batches):  # noqa: ANN001, ANN202
        out = run(batches)
        if not isinstance(out, Iterator):
            _trim()
            return out
        return _until_end(out)

    return tidied


def _until_end(batches: Iterator) -> Iterator:
    try:
        yield from batches
    finally:
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    if data is None or len(offsets) < 2:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of rows lo..hi of a column; row r has words ptr[r]..ptr[r + 1]."""

    lo: int
    hi: int
    ptr: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)


def _scan(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of data; bounds: where texts begin or end."""
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    solid = ~SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[bounds[bounds < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[bounds[bounds > 0] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_ROWS[LOWER[data]] * up[:n], out=total[1:])
        return start, end, mix((total[end] - total[start]) * down[start])


def words(column: pa.Array, block: int = BLOCK_BYTES) -> Iterator[Words]:
    """Words of a column, in blocks of rows of about `block` bytes. A-Z count as a-z in the hash."""
    data, offsets = utf8(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, side="right")) - 1)
        first, last = int(offsets[lo]), int(offsets[hi])
        found, at = [], first
        while at < last:
            stop = last
            if last - at > 2 * block:
                stop = at + block
                while stop < last and not SPACE[data[stop]]:
                    gap = np.flatnonzero(SPACE[data[stop : stop + 65536]])
                    stop = min(last, stop + (int(gap[0]) if len(gap) else 65536))
            bounds = offsets[lo : hi + 1]
            bounds = bounds[(bounds >= at) & (bounds <= stop)] - at
            s, e, h = _scan(data[at:stop], bounds)
            found.append((s + at, e + at, h))
            at = stop
        s, e, h = (np.concatenate(x) for x in zip(*found)) if found else _scan(data[:0], offsets[:0])
        yield Words(lo, hi, np.searchsorted(s, offsets[lo : hi + 1]), s, e, h)
        lo = hi


def grams(w: Words, size: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every window of `size` words, `skip` words left out after each. Order counts."""
    reach = (size - 1) * (skip + 1) + 1
    n = len(w.hash) - reach + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    row = w.row
    inside = row[:n] == row[reach - 1 :]
    with np.errstate(over="ignore"):
        total = np.full(n, size * 8 + skip, dtype=np.uint64)
        for k in range(size):
            at = k * (skip + 1)
            total = mix(total * _U(_BASE) + w.hash[at : at + n])
    return row[:n][inside], total[inside]


def shingle_sets(w: Words, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row: windows of `size` words; the whole sequence where it is shorter."""
    row, shingle = grams(w, size)
    at = np.searchsorted(row, np.arange(w.hi - w.lo + 1))
    counts = w.counts
    for r in range(w.hi - w.lo):
        if at[r] < at[r + 1]:
            yield np.unique(shingle[at[r] : at[r + 1]])
        elif counts[r]:
            with np.errstate(over="ignore"):
                total = np.full(1, 1000 + counts[r], dtype=np.uint64)
                for h in w.hash[w.ptr[r] : w.ptr[r + 1]]:
                    total = mix(total * _U(_BASE) + h)
            yield total
        else:
            yield shingle[:0]
