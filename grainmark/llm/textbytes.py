"""Vectorised words, lines and hashes over the UTF-8 bytes of an Arrow column.

A text column of an Arrow batch is one byte buffer plus row offsets. These
helpers work on that buffer with numpy, in slices of a few megabytes, so no
Python object is made for a word. Null texts have no bytes.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BLOCK = 1 << 20
SEED = 0x9E3779B97F4A7C15
_BASE = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_codes(seed: int = SEED) -> np.ndarray:
    """A 64-bit code for each of the 256 byte values."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(seed | 1))


def lowered(codes: np.ndarray) -> np.ndarray:
    """The same codes, with A-Z taking those of a-z."""
    out = codes.copy()
    out[65:91] = codes[97:123]
    return out


CODES = byte_codes()
CODES_LOWER = lowered(CODES)

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lowered.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of ``[^\x20\x09-\x0D]``.
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False



_KEPT: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, held by this process until ``drop_kept``."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def drop_kept() -> None:
    _KEPT.clear()


def hand_back() -> None:
    """Give the process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy(task: Callable, keep: bool = False) -> Callable:
    """A task over Arrow batches that hands its worker's free memory back when it ends.

    Workers live on from task to task; without this each keeps the largest size it had.
    What earlier tasks kept is dropped first, unless ``keep`` says that this one uses it.
    """

    @functools.wraps(task)
    def run(batches):
        if not keep:
            drop_kept()
        yield from task(batches)
        hand_back()

    return run


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE^0 … BASE^(n-1) modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not (wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(o, o[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[o[lo] : o[hi]], o[lo : hi + 1] - o[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes of ``inside``; no run crosses rows."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = inside[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    starts = np.flatnonzero(w & (~before | edge[:n]))
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    return starts, ends, rows


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """A 64-bit hash of each span's bytes (spans ascending, disjoint, not empty)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    stop = np.cumsum(size)
    out = np.empty(len(starts), np.uint64)
    power = powers(int(size.max()))
    lo = 0
    while lo < len(starts):  # about a megabyte at a time keeps the work in cache
        hi = max(lo + 1, int(np.searchsorted(stop, stop[lo] - size[lo] + _BLOCK, "right")))
        n = size[lo:hi]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        terms = codes[buf[np.repeat(starts[lo:hi], n) + within]] * power[within]
        out[lo:hi] = np.add.reduceat(terms, first)
        lo = hi
    return mix(out ^ (size.astype(np.uint64) * _U(SEED)))


def window_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of words i … i+k-1, True where all k are of one row) for each i."""
    n = len(words)
    h = np.zeros(n, np.uint64)
    if n < k:
        return h, np.zeros(n, bool)
    m = n - k + 1
    acc = np.zeros(m, np.uint64)
    for j in range(k):
        acc = acc * _BASE + words[j : j + m]
    h[:m] = mix(acc + _U(k))
    ok = np.zeros(n, bool)
    ok[:m] = rows[:m] == rows[k - 1 :]
    return h, ok


def row_counts(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    c = np.bincount(rows, weights=weights, minlength=n)
    return c.astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, … (count of them) for each pair, one after the other."""
    total = int(counts.sum())
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total, dtype=np.int64)
