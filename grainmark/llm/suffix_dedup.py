"""Repeated byte strings by merging sparse suffix orders of shards.

A string of ``length`` bytes that starts in two places is to be found, whatever
shards hold the places. Merging the full Burrows-Wheeler transforms of the shards
by interleave refinement takes one pass over all bytes for each byte of depth. Here
the suffixes are thinned first, and letters are strings of bytes:

* A window of ``length`` bytes belongs to the anchor with the smallest hash among
  its first ``SPREAD`` positions, which its own bytes decide. Neighbouring windows
  share anchors, so a shard has about two suffixes for each ``SPREAD`` bytes.
* First interleave: suffixes of all shards fall into blocks by their first letter,
  the bytes that every window of an anchor holds behind it. A block of one suffix
  is finished: nothing in it repeats.
* The transform's letter of a suffix, the context before and around it, splits its
  block. Suffixes with equal whole contexts repeat in all their windows.
* What is left are the borders of repeats. They are refined to the left, STEP bytes
  at a time, then byte by byte: a group of windows whose common bytes occur
  nowhere else is finished, one whose joint bytes occur elsewhere repeats.

Blocks are compared only by their smallest and largest member, so the largest
block costs one row per task. Copies of whole texts are one text. All hashes are of
64 bits over at most ``length + SPREAD`` bytes; matches never cross texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialise
from ..functions.ship import ship
from .names import free
from .textbytes import CODES, mix, ranges, text_slices, tidy

LENGTH = 400
SPREAD = 256
STEP = 16
SLICE = 1 << 20
_U = np.uint64
_BASE = 0x5851F42D4C957F2D
_BACK = pow(_BASE, -1, 2**64)
_TABLES: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    if len(_TABLES.get(name, ())) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        _TABLES[name] = np.multiply.accumulate(p)
    return _TABLES[name]


class SpanHash:
    """Hashes of any spans of one buffer in constant time each, by prefix sums."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[buf] * _power_table("up", _BASE, n + 1)[:n], out=self.sums[1:])
        self.back = _power_table("down", _BACK, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray, salt) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + np.asarray(salt).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, spread: int = SPREAD):
    """(text, anchor, first window, last window) of every anchor, places counted in the buffer.

    An anchor has the windows that start from the first to the last place.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = buf
    eight = np.ndarray((n,), "<u8", wide.data, strides=(1,))
    key = (mix(eight) & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // spread) + 1
    full = np.full(blocks * spread, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    grid = full.reshape(blocks, spread)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    size = np.diff(off)
    count = np.maximum(size - length + 1, 0)
    s = ranges(off[:-1], count)
    if not len(s):
        return none, none, none, none
    m = (np.minimum(behind[s], ahead[s + spread - 1]) & _U(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(size)), count)
    new = np.ones(len(s), bool)
    new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(s)) - 1
    return text[head], m[head], s[head], s[tail]


def _text_id(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b""))))


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """u, r (a number for text and first window), a, lo, hi (places in the text), x (block), full (context)."""
    ship(texts.sparkSession)
    right = length - SPREAD + 1

    def run(batches):
        for b in batches:
            ids = b.column(0)
            _, first = np.unique(np.array(ids.to_pylist(), object), return_index=True)
            if len(first) < b.num_rows:  # copies inside a batch say nothing new
                b = b.take(pa.array(np.sort(first)))
                ids = b.column(0)
            for lo, hi, buf, off in text_slices(b.column(1), SLICE):
                row, a, s, e = anchors(buf, off, length)
                if not len(row):
                    continue
                h = SpanHash(buf)
                x = h(a, a + right, 1)
                full = h(s, e + length, (a - s) * 4096 + (e - s) + 7)
                begin = off[row]
                raw = np.frombuffer(b"".join(ids.slice(lo, hi - lo).to_pylist()), "<u8").reshape(-1, 2)
                r = mix(raw[row, 0] ^ mix(raw[row, 1] + (s - begin).astype(np.uint64)))
                cols = [ids.slice(lo, hi - lo).take(pa.array(row)), r.view(np.int64)]
                cols += [(v - begin).astype(np.int32) for v in (a, s, e)] + [x.view(np.int64), full.view(np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["u", "r", "a", "lo", "hi", "x", "full"])

    return texts.mapInArrow(tidy(run), "u binary, r long, a int, lo int, hi int, x long, full long")


def _repeated(rows: DataFrame, key: str, member: str = "r") -> DataFrame:
    """Values of ``key`` with two different members; written, so that a join with them can split a hot value."""
    ends = rows.groupBy(key).agg(F.min(member).alias("_a"), F.max(member).alias("_z"))
    return materialise(ends.where("_a != _z").select(key))


def _small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def _border_text(texts: DataFrame, open_: DataFrame, owner: DataFrame, length: int, most: int) -> DataFrame:
    """r, u, a, lo, hi, sure, cut (the bytes of all windows of the anchor) of the open suffixes."""
    per = open_.groupBy("u").agg(F.collect_list(F.struct("r", "a", "lo", "hi", "sure")).alias("list"))
    per = materialise(per.join(owner, "u").withColumnsRenamed({"u": "pu", "key": "pk"}))
    # One number per open suffix, 21 bytes each, is broadcast up to ``most`` of them.
    side = F.broadcast(per) if _small(open_, most) else per
    rows = texts.join(side, (F.col("u") == F.col("pu")) & F.col("key").eqNullSafe(F.col("pk"))).select("u", "text", "list")

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(1), SLICE):
                lists = b.column(2).slice(lo, hi - lo)
                sizes = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(hi - lo), sizes)
                item = lists.flatten()
                fields = [item.field(i) for i in range(5)]
                s = off[row] + fields[2].to_numpy()
                n = fields[3].to_numpy() - fields[2].to_numpy() + length
                data = buf[ranges(s, n)]
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                cut = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                u = b.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([fields[0], u, *fields[1:], cut], names=["r", "u", "a", "lo", "hi", "sure", "cut"])

    got = rows.mapInArrow(tidy(run), "r long, u binary, a int, lo int, hi int, sure boolean, cut binary")
    return materialise(got.dropDuplicates(["r"]))


def _groups(borders: DataFrame, length: int) -> DataFrame:
    """r, g, inner, joint: for STEP windows at a time, hashes of their common and of their joint bytes (null if cut off)."""

    def run(batches):
        for b in batches:
            for p, q, buf, off in text_slices(b.column(4), SLICE):
                r, a, lo, hi = (b.column(i).slice(p, q - p).to_numpy() for i in range(4))
                first, last = (a - hi) // STEP, (a - lo) // STEP
                n = last - first + 1
                row = np.repeat(np.arange(q - p), n)
                g = ranges(first, n)
                h = SpanHash(buf)
                zero = off[row] - lo[row] + a[row]  # the anchor's place in the buffer
                inner = h(zero - g * STEP, zero - g * STEP - STEP + 1 + length, g * 2)
                whole = (zero - g * STEP - STEP + 1 >= off[row]) & (a[row] - g * STEP <= hi[row])
                at = np.flatnonzero(whole)
                joint = np.zeros(len(row), np.uint64)
                joint[at] = h(zero[at] - g[at] * STEP - STEP + 1, zero[at] - g[at] * STEP + length, g[at] * 2 + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r[row]), pa.array(g.astype(np.int32)), pa.array(inner.view(np.int64)), pa.array(joint.view(np.int64), mask=~whole)],
                    names=["r", "g", "inner", "joint"],
                )

    return borders.select("r", "a", "lo", "hi", "cut").mapInArrow(tidy(run), "r long, g int, inner long, joint long")


def _windows(borders: DataFrame, length: int) -> DataFrame:
    """w (hash of one window), m (a number for suffix and window), u, s, counts: for the asked groups of each suffix."""

    def run(batches):
        for b in batches:
            for p, q, buf, off in text_slices(b.column(5), SLICE):
                u, (r, a, lo, hi) = b.column(0).slice(p, q - p), (b.column(i).slice(p, q - p).to_numpy() for i in range(1, 5))
                lists = b.column(6).slice(p, q - p)
                row = np.repeat(np.arange(q - p), np.diff(lists.offsets.to_numpy()))
                item = lists.flatten()
                g, asks = item.field(0).to_numpy(), item.field(1).to_numpy(zero_copy_only=False).astype(bool)
                first = np.maximum(a[row] - g * STEP - STEP + 1, lo[row])
                last = np.minimum(a[row] - g * STEP, hi[row])
                n = np.maximum(last - first + 1, 0)
                each = np.repeat(np.arange(len(row)), n)
                s, row = ranges(first, n), row[each]
                at = off[row] + s - lo[row]
                h = SpanHash(buf)
                w = h(at, at + length, 3)
                m = mix(r[row].view(np.uint64) + s.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.view(np.int64)), pa.array(m.view(np.int64)), u.take(pa.array(row)), pa.array(s.astype(np.int32)), pa.array(asks[each])],
                    names=["w", "m", "u", "s", "asks"],
                )

    return borders.select("u", "r", "a", "lo", "hi", "cut", "list").mapInArrow(tidy(run), "w long, m long, u binary, s int, asks boolean")


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = 2_000_000) -> DataFrame:
    """u (MD5 of a text's bytes), n_removed, n_spans and keep (array of lo, n) of each distinct text that holds a repeat.

    Null texts are empty. ``most``: borders, or affected texts' ranges, that may be
    broadcast; more go through a shuffle.
    """
    if length < SPREAD + STEP:
        raise ValueError(f"length is at least {SPREAD + STEP}")
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).withColumn("u", _text_id("text"))
    long_ = texts.where(F.octet_length("text") >= length)
    owner_all = materialise(long_.groupBy("u").agg(F.min("key").alias("key"), F.count("*").alias("n"), F.first(F.octet_length("text")).alias("size")))
    owner = owner_all.select("u", "key")
    suffixes = materialise(_suffixes(long_.select("u", "text"), length))
    live = materialise(suffixes.join(_repeated(suffixes, "x"), "x"))
    member = F.struct("r", "u", "a", "lo", "hi")
    contexts = materialise(live.groupBy("x", "full").agg(F.min(member).alias("one"), F.max("r").alias("z")).withColumn("sure", F.col("one.r") != F.col("z")))
    whole = live.join(contexts.where("sure").select("x", "full"), ["x", "full"]).select("u", F.col("lo").alias("s"), F.col("hi").alias("e"))
    borders = contexts.groupBy("x").agg(F.min("full").alias("a"), F.max("full").alias("z"), F.min("sure").alias("all_sure")).where("a != z and not all_sure")
    open_ = materialise(contexts.join(borders.select("x"), "x").select("one.*", "sure"))
    cuts = _border_text(texts, open_, owner, length, most)

    groups = materialise(_groups(cuts, length).join(cuts.select("r", "sure"), "r"))
    inner = groups.join(_repeated(groups, "inner"), "inner")  # the rest is finished
    joint = _repeated(groups.where("joint is not null"), "joint").withColumnRenamed("joint", "jj")
    state = materialise(inner.join(joint, F.col("joint") == F.col("jj"), "left").withColumn("same", F.col("jj").isNotNull()).drop("jj"))
    spread = state.where("same and not sure").join(cuts.select("r", "u", "a"), "r")
    stepped = spread.select("u", (F.col("a") - F.col("g") * STEP - STEP + 1).alias("s"), (F.col("a") - F.col("g") * STEP).alias("e"))
    # Window by window where a group of an unsettled suffix has partners but none for all of it.
    asking = state.where("not same and not sure").select("r", "g", "inner")
    classes = asking.select("inner").distinct()
    partners = state.where("same or sure").join(classes, "inner").groupBy("inner", "g", F.coalesce("joint", "r")).agg(F.min("r").alias("r"))
    asked = asking.select("r", "g", F.lit(True).alias("asks")).unionByName(partners.select("r", "g", F.lit(False).alias("asks")))
    lists = asked.groupBy("r").agg(F.collect_list(F.struct("g", "asks")).alias("list"))
    windows = materialise(_windows(cuts.join(lists, "r"), length))
    single = windows.where("asks").join(_repeated(windows, "w", "m"), "w").select("u", "s", F.col("s").alias("e"))

    copies = owner_all.where("n > 1").select("u", F.lit(0).alias("s"), (F.col("size") - length).alias("e"))
    spans = whole.unionByName(stepped).unionByName(single).unionByName(copies)
    # Of one context or window several spans may come; a text's own spans are bounded by its length.
    per = spans.distinct().groupBy("u").agg(F.collect_list(F.struct("s", "e")).alias("spans")).join(owner_all.select("u", "size"), "u")

    def merge(batches):
        for b in batches:
            lists, size = b.column(1), b.column(2).to_numpy()
            ends = lists.offsets.to_numpy()
            item = lists.flatten()
            s, e = item.field(0).to_numpy(), item.field(1).to_numpy() + length
            removed, runs, keep = [], [], []
            for i in range(b.num_rows):
                x, y = s[ends[i] - ends[0] : ends[i + 1] - ends[0]], e[ends[i] - ends[0] : ends[i + 1] - ends[0]]
                order = np.argsort(x, kind="stable")
                x, y = x[order], np.maximum.accumulate(y[order])
                new = np.ones(len(x), bool)
                new[1:] = x[1:] > y[:-1]
                first = np.flatnonzero(new)
                x, y = x[first], y[np.append(first[1:], len(y)) - 1]
                removed.append(int((y - x).sum()))
                runs.append(len(x))
                lo, hi = np.append(0, y), np.append(x, size[i])
                keep.append([{"lo": int(p), "n": int(q - p)} for p, q in zip(lo, hi) if q > p])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(keep, pa.list_(pa.struct([("lo", pa.int32()), ("n", pa.int32())])))],
                names=["u", "n_removed", "n_spans", "keep"],
            )

    return materialise(per.select("u", "spans", "size").mapInArrow(tidy(merge), "u binary, n_removed long, n_spans long, keep array<struct<lo:int,n:int>>"))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = 2_000_000) -> DataFrame:
    """``docs`` with _n_bytes, _n_removed, _n_spans (long) and _kept (binary).

    Every byte covered by a ``length``-byte string that also starts anywhere else, in
    the same text or another, is left out of _kept; strings are judged on the input.
    Repeated rows and equal texts are copies of each other. Null texts are empty. An
    empty table stays empty. Where a table has a column of an added name, the added
    ones, always last, get one more leading underscore.
    """
    n_bytes, n_removed, n_spans, kept, u, keep = (free(c, docs.columns) for c in ("_n_bytes", "_n_removed", "_n_spans", "_kept", "_u", "_keep"))
    found = repeats(docs, key=key, text=text, length=length, most=most)
    small = found.agg(F.coalesce(F.sum(F.size("keep") + 4), F.lit(0))).first()[0] <= most
    found = found.withColumnsRenamed({"u": u, "n_removed": n_removed, "n_spans": n_spans, "keep": keep})
    out = docs.join(F.broadcast(found) if small else found, _text_id(text) == F.col(u), "left")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    cut = F.aggregate(keep, F.lit(b""), lambda acc, r: F.concat(acc, F.substring(raw, r["lo"] + 1, r["n"])))
    zero = F.lit(0).cast("long")
    return out.select(
        *docs.columns,
        F.octet_length(raw).cast("long").alias(n_bytes),
        F.coalesce(n_removed, zero).alias(n_removed),
        F.coalesce(n_spans, zero).alias(n_spans),
        F.when(F.col(u).isNull(), raw).otherwise(cut).alias(kept),
    )


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with the kept text in place of the text (a character cut in two is left out).

    Null texts stay null, and a document stays when all of its text goes.
    """
    done = remove_repeats(docs, key=key, text=text, **options)
    _, n_removed, _, kept = done.columns[-4:]
    new = F.when(F.col(n_removed) == 0, F.col(text)).otherwise(whole_characters(kept))
    return done.select(*(new.alias(c) if c == text else c for c in docs.columns))


def whole_characters(column: str):
    """Bytes as text, without what is no whole character."""
    return F.replace(F.make_valid_utf8(F.col(column).cast("string")), F.lit("\ufffd"), F.lit(""))
