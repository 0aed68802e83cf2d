"""Vectorised word hashing over Arrow string columns.

Arrow keeps the texts of a batch back to back in one buffer. Words are found and hashed there with numpy, without
a Python object for each word. A batch is taken in blocks of about `BLOCK` bytes, so memory doesn't follow the batch;
a text longer than that is a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time.
BLOCK = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Also ends words at ASCII characters other than letters, digits and the apostrophe.
PLAIN = np.array([not (chr(b).isalnum() or chr(b) == "'") if b < 128 else False for b in range(256)])
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def powers(base: int | np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        with np.errstate(over="ignore"):
            out[1:] = base
            np.multiply.accumulate(out, out=out)
    return out


class Powers:
    """Powers of a base and of its inverse, extended as longer blocks come."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.n = _U(base), _U(pow(base, -1, 1 << 64)), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, BLOCK + 1)
            self.up, self.down = powers(self.base, self.n), powers(self.inverse, self.n)
        return self.up, self.down


_BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
_WORD_POWERS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(at: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about `most` bytes together, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow; after a task the worker, which waits for others beside the JVM, gives freed memory back to the system."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps it otherwise
            trim(0)

    return task


class Words:
    """Words of some rows: hash, byte range (in `data`) and row of each; `first[r]:first[r+1]` are the words of row r."""

    __slots__ = ("data", "end", "first", "hash", "n", "row", "start")

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool, apart: np.ndarray = _SPACE) -> None:
        base = int(at[0])
        at = at - base
        data = data[base : base + int(at[-1])]
        self.data = data = _LOWER[data] if lower else data
        n = len(data)
        inside = ~apart[data]
        # a text's end also ends a word
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edges = at[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        start[edges] = inside[edges]
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        end[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.n = len(self.start)
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        up, down = _BYTE_POWERS.upto(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[data] * up[:n], out=total[1:])
            h = (total[self.end] - total[self.start]) * down[self.start]
            self.hash = mix(h + (self.end - self.start).astype(np.uint64) * _BASE)

    def rolling(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of words i .. i+k-1 for every i, also where they span rows."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        up, down = _WORD_POWERS[which].upto(self.n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.hash * up[: self.n], out=total[1:])
            return mix((total[k:] - total[:-k]) * down[: self.n - k + 1] + _U(k))

    def grams(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of k words that stays in one row, and the index of its first word."""
        if self.n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        i = np.flatnonzero(self.row[: self.n - k + 1] == self.row[k - 1 :])
        return self.rolling(k, which)[i], i

    def sequence(self, which: int = 0) -> np.ndarray:
        """Hash of all words of each row in order; 0 for a row without words."""
        up, down = _WORD_POWERS[which].upto(self.n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self.hash * up[: self.n], out=total[1:])
            a, b = self.first[:-1], self.first[1:]
            return np.where(b > a, mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)), _U(0))


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False, most: int = BLOCK, apart: np.ndarray = _SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) for block after block of a string column."""
    data, at = buffers(column)
    for i, j in blocks(at, most):
        yield i, j, Words(data, at[i : j + 1], lower, apart)


def kept_text(w: Words, keep: np.ndarray) -> pa.Array:
    """Each row's words where `keep` is true, joined by one space."""
    start, size, row = w.start[keep], (w.end - w.start)[keep], w.row[keep]
    n = len(w.first) - 1
    per_row = np.bincount(row, minlength=n)
    last = np.zeros(len(start), bool)
    last[np.cumsum(per_row)[per_row > 0] - 1] = True
    room = size + ~last
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(room, out=at[1:])
    out = np.full(int(at[-1]), 32, np.uint8)
    if len(start):
        shift = np.repeat(at[:-1] - start, size)
        source = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        out[source + shift] = w.data[source]
    offsets = at[np.concatenate([[0], np.cumsum(per_row)])].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
