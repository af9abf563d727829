"""Periodic runs of words, by string synchronising sets at dyadic scales.

A run is a stretch of consecutive words with smallest period q and at least
max(``least``, 2 q) words that no neighbouring word extends with the same period.

At scale t, a power of two, the synchronising set holds the places i whose window of t
words, or the one t words later, has the smallest hash of all windows that start at
i … i + t. Whether i belongs to the set depends on the words i … i + 2t - 1 only, so a run of
period q in [3t, 6t) holds two members q apart with equal contexts of 2t words. Pairs of
members with equal contexts at such distances propose their distance as a period. There
are few: windows of period t/3 or less are left out of the sets, so equal contexts lie more
than t/3 apart.

Leaving them out loses two kinds of runs, found separately. Periods below 12 come from
comparing the words with themselves, shifted. A run whose halves are both pieces of highly
periodic regions lies where two runs of one smaller period p meet; the distances that bring
them into phase are one residue class modulo p. Every proposal is extended word by word to
both sides, and stretches that two periods share belong to the smaller one.

A slice of documents is one string with a unique word after each document, so no run
crosses documents. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from .names import free
from .textbytes import SOLID, mix, ranges, span_hashes, spans, text_slices, tidy

LEAST = 12
_SMALL = 12  # periods below are found by shifting; the first scale, 4, takes 12 to 23
_CELLS = 1 << 20
_NONE = np.uint64(2**64 - 1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _extent(w: np.ndarray, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many words from places x and y on, to the right or (step -1) to the left, are equal; x < y."""
    n = len(w)
    out = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    width = 8
    while len(live):
        going = []
        for part in np.array_split(live, max(1, len(live) * width // _CELLS)):
            k = np.arange(width) * step
            i = x[part, None] + step * out[part, None] + k
            j = i + (y - x)[part, None]
            inside = (i >= 0) if step < 0 else (j < n)
            same = inside & (w[np.clip(i, 0, n - 1)] == w[np.clip(j, 0, n - 1)])  # near an end both may lie outside
            whole = same.all(axis=1)
            out[part] += np.where(whole, width, same.argmin(axis=1))
            going.append(part[whole])
        live = np.concatenate(going)
        width = min(4096, 2 * width)
    return out


def _stretched(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of period d that hold the places lo … hi - 1 of equal words d apart."""
    return lo - _extent(w, lo - 1, lo - 1 + d, -1), hi + d + _extent(w, hi, hi + d, 1)


def _close_pairs(place: np.ndarray, context: np.ndarray, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """(s, d): places s and s + d of equal contexts with near <= d < far; places ascend."""
    order = np.argsort(context, kind="stable")
    p, c = place[order], context[order]
    starts, steps = [], []
    at = np.arange(len(p))
    gap = 0
    while True:
        gap += 1
        at = at[at + gap < len(p)]
        at = at[(c[at] == c[at + gap]) & (p[at + gap] - p[at] < far)]
        if not len(at):
            break
        d = p[at + gap] - p[at]
        wide = d >= near
        starts.append(p[at[wide]])
        steps.append(d[wide])
    if not starts:
        return place[:0], place[:0]
    return np.concatenate(starts), np.concatenate(steps)


def _merged(s: np.ndarray, d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches s … s + size - 1 of one d that touch, as one: (first, end, d)."""
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + size)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return s[first], s[last] + size, d[first]


def _small_periods(w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of periods below 12, and of all shorter stretches of three periods and 4 words."""
    runs, short = [], []
    for q in range(1, min(_SMALL, len(w))):
        at = np.flatnonzero(w[q:] == w[:-q])
        if not len(at):
            continue
        edge = np.flatnonzero(np.diff(at) != 1) + 1
        lo = at[np.concatenate(([0], edge))]
        hi = at[np.append(edge, len(at)) - 1] + 1 + q
        for out, need in ((runs, max(least, 2 * q)), (short, max(4, 3 * q))):
            k = np.flatnonzero(hi - lo >= need)
            out.append(np.stack((lo[k], hi[k], np.full(len(k), q))))
    none = np.zeros((3, 0), np.int64)
    return np.concatenate([none, *runs], axis=1), np.concatenate([none, *short], axis=1)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period, by start and end."""
    order = np.lexsort((runs[2], runs[1], runs[0]))
    runs = runs[:, order]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])
    return runs[:, new]


def _members(h: np.ndarray, t: int) -> np.ndarray:
    """The synchronising set of scale t for window hashes h (the largest value marks windows left out)."""
    low = h
    size = 1
    while size < t:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:-1], low[1:])  # of windows i … i + t
    return np.flatnonzero((low != _NONE) & ((low == h[: len(low)]) | (low == h[t : t + len(low)])))


def _periodic_windows(regions: np.ndarray, t: int, n: int) -> np.ndarray:
    """True for the places whose window of t words has a period of t/3 or less."""
    lo, hi, p = regions
    k = (3 * p <= t) & (hi - lo >= t)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, lo[k], 1)
    np.add.at(step, hi[k] - t + 1, -1)
    return np.cumsum(step[:n]) > 0


def _seams(w: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Runs of period 9 p and more where two runs of period p meet or overlap."""
    lo, hi, p = runs
    k = np.flatnonzero((p > 1) & (hi - lo >= np.maximum(_SMALL, 9 * p)))
    k = k[np.lexsort((lo[k], p[k]))]
    found = [np.zeros((3, 0), np.int64)]
    for a, b in zip(k[:-1], k[1:]):
        if p[a] != p[b] or lo[b] > hi[a]:
            continue
        root, turn = w[lo[b] : lo[b] + p[b]], w[lo[a] : lo[a] + 2 * p[a] - 1].tobytes()
        shift = turn.find(root.tobytes())
        while shift % 8 and shift > 0:
            shift = turn.find(root.tobytes(), shift + 1)
        if shift < 0:
            continue
        shift //= 8
        least = max(_SMALL, 9 * int(p[a]))
        q = least + (int(lo[b] - lo[a]) - shift - least) % int(p[a])
        d = np.arange(q, min(hi[a] - lo[a], hi[b] - lo[b]) + p[a], p[a], dtype=np.int64)
        start = np.maximum(lo[a], lo[b] - d)
        end = np.minimum(hi[a], hi[b] - d)
        ok = end > start
        d, start, end = d[ok], start[ok], end[ok]
        if len(d):
            s, e = _stretched(w, start, end, d)
            found.append(np.stack((s, e, d)))
    return np.concatenate(found, axis=1)


def runs_of(w: np.ndarray, ends: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of every run in a string of word hashes, by start and end.

    The string is cut at ``ends`` (each the place of a word that occurs nowhere else).
    """
    real, short = _small_periods(w, least)
    known = [_smallest(real)]
    regions = short
    sizes = np.diff(np.concatenate(([-1], ends)))
    t = 4
    while len(sizes) and sizes.max() > 6 * t:
        # Documents too short for a run of this scale drop out.
        keep = np.repeat(sizes > 6 * t, sizes)
        if keep.all():
            place, part, inside = None, w, regions
        else:
            place = np.flatnonzero(keep)
            part = w[place]
            new = np.cumsum(keep) - 1
            inside = regions[:, keep[regions[0]]].copy()
            inside[:2] = new[inside[0]], new[inside[1] - 1] + 1
        h = part
        for k in range(t.bit_length() - 1):
            h = mix(h[: -(1 << k)] * _A + mix(h[1 << k :] ^ _B))
        window = np.where(_periodic_windows(inside, t, len(h)), _NONE, h)
        s = _members(window, t)
        s, d = _close_pairs(s, mix(h[s] * _A + mix(h[s + t] ^ _B)), 3 * t, 6 * t)
        if len(s):
            lo, hi, d = _merged(s, d, 2 * t)
            lo, hi = _stretched(part, lo, hi, d)
            ok = hi - lo >= np.maximum(least, 2 * d)
            found = np.stack((lo[ok], hi[ok], d[ok]))
            if place is not None:
                found[:2] = place[found[0]], place[found[1] - 1] + 1
            known.append(found)
            regions = np.concatenate((regions, found), axis=1)
        t *= 2
    runs = _smallest(np.concatenate(known, axis=1))
    more = _seams(w, runs)
    ok = more[1] - more[0] >= np.maximum(least, 2 * more[2])
    return _smallest(np.concatenate((runs, more[:, ok]), axis=1))


def _slice_runs(buf: np.ndarray, off: np.ndarray, least: int):
    """Words (starts, ends, rows), run rows and runs (start, length, period), and the words to keep, of a slice of texts."""
    n = len(off) - 1
    starts, ends, rows = spans(buf, off, SOLID)
    count = np.bincount(rows, minlength=n).astype(np.int64)
    stop = np.cumsum(count + 1) - 1
    first = stop - count
    w = np.empty(len(rows) + n, np.uint64)
    at = np.arange(len(rows)) + rows
    w[at] = span_hashes(buf, starts, ends)
    w[stop] = mix(np.arange(1, n + 1, dtype=np.uint64) * _B)
    lo, hi, q = runs_of(w, stop, least)
    order = np.lexsort((q, lo))
    lo, hi, q = lo[order], hi[order], q[order]
    row = np.searchsorted(stop, lo)
    step = np.zeros(len(w) + 1, np.int64)
    np.add.at(step, lo + q, 1)
    np.add.at(step, hi, -1)
    keep = (np.cumsum(step[:-1]) == 0)[at]
    return (starts, ends, rows, count), (row, lo - first[row], hi - lo, q), keep


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """The words of each row with one space between."""
    size = ends - starts
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    room = size + ~last
    place = np.cumsum(room) - room
    out = np.full(int(room.sum()), 32, np.uint8)
    out[ranges(place, size)] = buf[ranges(starts, size)]
    total = np.concatenate(([0], np.cumsum(np.bincount(rows, weights=room, minlength=n)))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(total), pa.py_buffer(out)]).cast(pa.string())


def periodic_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``_n_words``, ``_runs`` (start, length, period; by start, then period) and ``_collapsed``.

    Words are maximal stretches of bytes other than blanks and \\x09 to \\x0D, numbered
    from 0. ``_collapsed`` holds the words, with one space between, that no run contains
    after its first ``period`` words. Null, empty and blank texts have no words, no runs
    and an empty ``_collapsed``. All columns and rows stay, repeated ones too; the names of
    the new columns give way to the table's own. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index(text)
    added = []
    for c in ("_n_words", "_runs", "_collapsed"):
        added.append(free(c, [*names, *added]))

    def run(batches):
        for b in batches:
            column = b.column(at)
            for lo, hi, buf, off in text_slices(column):
                n = hi - lo
                (starts, ends, rows, count), (row, s, length, q), keep = _slice_runs(buf, off, least)
                each = pa.StructArray.from_arrays([pa.array(s), pa.array(length), pa.array(q)], names=["start", "length", "period"])
                ptr = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ptr), each)
                kept = _joined(buf, starts[keep], ends[keep], rows[keep], n)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in b.columns), pa.array(count), lists, kept], names=[*names, *added])

    kind = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    fields = [T.StructField(added[0], T.LongType()), T.StructField(added[1], kind), T.StructField(added[2], T.StringType())]
    source = docs.withColumn(text, F.col(text).cast("string"))
    return source.mapInArrow(tidy(run), T.StructType([*source.schema, *fields]))
