"""Array kernels over the bytes of an Arrow string column.

Every function works on one slice of documents: ``data`` holds their UTF-8
bytes back to back and ``offsets`` the document borders. Nothing here knows
about Spark; the operators call these kernels inside ``mapInArrow`` tasks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Small enough that a kernel's arrays stay in the processor's cache and a worker's memory low.
SLICE_BYTES = (1 << 19) - 1
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE_CODES = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=U) | U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(n, 1), U)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(pow(base, done, 2**64))
        done += step
    return out


class _Powers:
    """Powers of the polynomial's base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = _powers(_BASE, 1 << 12)
        self.down = _powers(_BASE_INVERSE, 1 << 12)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(_BASE_INVERSE, size)
        return self.up, self.down


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words, so that sums of hashes spread over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, borders from 0) of runs of rows of about ``limit`` bytes; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def return_memory() -> None:
    """Gives this process' free memory back to the system, which else keeps the pages of arrays that are gone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker, which Spark keeps for later tasks, returns its free memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        return_memory()

    return tidied


class Runs(NamedTuple):
    """Byte runs of a slice: start, end (exclusive), number of runs of each document, first run of each document."""

    start: np.ndarray
    end: np.ndarray
    count: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def _by_doc(start: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> Runs:
    at = np.searchsorted(start, offsets)
    return Runs(start, end, np.diff(at), at[:-1])


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Runs:
    """Maximal runs of bytes that ``space`` doesn't mark; documents are borders."""
    gap = space[data]
    before = np.empty(len(data) + 1, bool)
    before[1:] = gap
    inner = offsets[:-1]
    before[inner] = True
    after = np.empty(len(data) + 1, bool)
    after[:-1] = gap
    after[offsets[1:]] = True
    start = np.flatnonzero(before[:-1] & ~gap)
    end = np.flatnonzero(after[1:] & ~gap) + 1
    return _by_doc(start, end, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> Runs:
    r"""The pieces between ``\n`` bytes, empty ones too."""
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    end = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
    docs = np.diff(np.searchsorted(cut, offsets)) + 1
    first = np.concatenate([[0], np.cumsum(docs)[:-1]]) if len(docs) else docs
    return Runs(start, end, docs, first)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte runs, equal for equal bytes wherever they stand."""
    up, down = _POWERS.get(len(data) + 1)
    codes = _BYTE_CODES[LOWER[data] if lower else data]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(codes * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


def gram_hashes(h: np.ndarray, runs: Runs, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each ``k`` successive words in one document, and the index of their first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    last = runs.first + runs.count
    for back in range(1, k):
        bad = last - back
        bad = bad[(bad >= runs.first) & (bad < n)]
        ok[bad] = False
    out = np.zeros(n, U)
    for j in range(k):
        out += h[j : j + n] * U(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
    at = np.flatnonzero(ok)
    return mix(out[at] + U(k)), at


def distinct_in_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by (document, hash), a mask of first occurrences in that order, and its sorted documents."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    first = np.ones(len(order), bool)
    first[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return order, first, d


def counts(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes of each document."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def sum_by_doc(values: np.ndarray, runs: Runs) -> np.ndarray:
    """Sums of a value of each run by document, in the runs' order."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[runs.first + runs.count] - sums[runs.first]
