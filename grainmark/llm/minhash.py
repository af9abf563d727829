"""Near duplicates by ProbMinHash over word shingles, with bands and verification.

A text is the set of its ``shingle`` -word shingles. Every shingle sends arrivals of
a Poisson process whose rate is its weight to random registers; a register keeps its
earliest arrival. Generation ends for a shingle as soon as its next arrival is later
than every register, so most shingles stop after a few. Two texts agree in a register
with the probability Jaccard similarity of their weights. A link is decided by the
plain Jaccard similarity, so for the registers every distinct shingle weighs 1 and
that probability is the plain similarity; the similarity by weights 1 + ln(count)
is an extra column of the links.

Texts with the same words are one text from the start. Equal bands of registers
make buckets; in a bucket every text is compared with one leader, the text that
shares its buckets with the most others. Copies of one text mostly share the leader
that is nearest to all of them, so a text meets few leaders in its many buckets. Pairs
whose registers agree often enough are verified on the whole texts. A further sweep
looks for new leaders in buckets that still hold several components. So large groups
become one component with a number of pairs linear in the number of texts.

What the sweeps leave is settled by shingles: the texts of buckets of three or more that
still hold several components are joined on their rarest shingles (``_rare_pairs``),
between components only. Every pair found is verified whose registers agree in a share
within five standard deviations of the threshold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialise, temporary
from ..functions.ship import ship
from .components import joined
from .names import free
from .packing import key_type
from .textbytes import ALNUM, CODES_LOWER, mix, powers, span_hashes, spans, text_slices, tidy, window_hashes

BANDS, ROWS = 30, 4
REGISTERS = BANDS * ROWS
SHINGLE = 5
_ROWS_AT_ONCE = 8192
_SLOTS, _CHUNK = 1 << 20, 1 << 12  # counters of shingle frequencies, and how many make a row
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LINK = "a binary, b binary, jaccard double, similarity double"


def _gold(k: int) -> np.uint64:
    return np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)


def weighted_shingles(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE):
    """(shingle hashes, their texts' rows, weights, two 64-bit hashes of each text's words, words per text).

    Shingles are distinct within a text and ascend by (row, hash). A text of fewer
    than ``k`` words is one shingle of them all.
    """
    n = len(off) - 1
    starts, ends, rows = spans(buf, off, ALNUM)
    words = span_hashes(buf, starts, ends, CODES_LOWER)
    count = np.bincount(rows, minlength=n).astype(np.int64)
    some = np.flatnonzero(count)
    first = (np.cumsum(count) - count)[some]
    ids = np.zeros((2, n), np.uint64)
    if len(words):
        place = np.arange(len(words)) - np.repeat(first, count[some])
        power = powers(int(count.max()))[place]
        for j in range(2):
            ids[j, some] = mix(np.add.reduceat(mix(words + _gold(j + 1)) * power, first) + count[some].astype(np.uint64))
    h, ok = window_hashes(words, rows, k)
    short = some[count[some] < k]
    h = np.concatenate((h[ok], ids[0, short]))
    r = np.concatenate((rows[ok], short))
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    return h[at], r[at], 1.0 + np.log(times), ids, count


def prob_minhash(h: np.ndarray, rows: np.ndarray, weights: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m winning shingles (0 for rows without any)."""
    earliest = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    slow = 1.0 / weights
    time = np.zeros(len(h))
    step = 0
    while len(h):
        for _ in range(int(np.clip(100_000 // len(h), 1, 64))):
            step += 1
            draw = mix(h + _gold(step))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * slow
            at = rows * m + (mix(draw ^ _GOLD) % np.uint64(m)).astype(np.int64)
            np.minimum.at(earliest, at, time)
            won = earliest[at] == time
            winner[at[won]] = h[won]
        # A shingle whose last arrival is after every register of its text is done.
        go = time < earliest.reshape(n, m).max(axis=1)[rows]
        h, rows, slow, time = h[go], rows[go], slow[go], time[go]
    return winner.reshape(n, m)


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets with ascending hashes."""
    common, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = wa[ia], wb[ib]
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    # For shared d: sum of max(a'/a, b'/b) over all d', split where a'/b' passes a/b.
    above = np.cumsum(a[::-1])[::-1] + (wa.sum() - a.sum())
    below = np.concatenate(([0.0], np.cumsum(b)[:-1])) + (wb.sum() - b.sum())
    return float((1.0 / (above / a + below / b)).sum())


def jaccard(ha: np.ndarray, hb: np.ndarray) -> float:
    """Plain Jaccard similarity of two sets of hashes."""
    common = len(np.intersect1d(ha, hb, assume_unique=True))
    return common / max(1, len(ha) + len(hb) - common)


def _pieces(column):
    for lo, hi, buf, off in text_slices(column):
        for s in range(0, hi - lo, _ROWS_AT_ONCE):
            z = min(s + _ROWS_AT_ONCE, hi - lo)
            yield lo + s, lo + z, buf[off[s] : off[z]], off[s : z + 1] - off[s]


def _fixed(values: np.ndarray, rows: int) -> pa.Array:
    width = values.nbytes // max(rows, 1)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.arange(rows + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _words_of(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    """16 bytes that stand for a text's words; null for texts without words."""
    raw = np.ascontiguousarray(ids.T).view(np.uint8).reshape(len(count), 16)
    return pa.array([r.tobytes() if c else None for r, c in zip(raw, count)], pa.binary())


def sign(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """key, u (16 bytes standing for the words; null without any), bands, registers (a byte each)."""
    kind = key_type(docs, key)
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in _pieces(b.column(1)):
                n = hi - lo
                h, r, w, ids, count = weighted_shingles(buf, off)
                winner = prob_minhash(h, r, np.ones(len(w)), n)
                band = np.zeros((n, BANDS), np.uint64)
                for j in range(ROWS):
                    band = mix(band * _GOLD + winner[:, j::ROWS])
                band = mix(band + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD)
                values = pa.array(band.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, n),
                        _words_of(ids, count),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), values),
                        _fixed((winner & np.uint64(255)).astype(np.uint8), n),
                    ],
                    names=["key", "u", "bands", "registers"],
                )

    schema = T.StructType(
        [T.StructField("key", kind), T.StructField("u", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("registers", T.BinaryType())]
    )
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), schema)


def with_words_id(docs: DataFrame, text: str, name: str = "_u") -> DataFrame:
    """``docs`` with the 16 bytes of ``sign`` in a new column."""
    ship(docs.sparkSession)
    names = docs.columns
    t = names.index(text)

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(t)):
                ids, count = weighted_ids(buf, off)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns), _words_of(ids, count)], names=[*names, name])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema, T.StructField(name, T.BinaryType())]))


def weighted_ids(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of ``weighted_shingles`` without its shingles."""
    n = len(off) - 1
    starts, ends, rows = spans(buf, off, ALNUM)
    words = span_hashes(buf, starts, ends, CODES_LOWER)
    count = np.bincount(rows, minlength=n).astype(np.int64)
    some = np.flatnonzero(count)
    ids = np.zeros((2, n), np.uint64)
    if len(words):
        first = (np.cumsum(count) - count)[some]
        power = powers(int(count.max()))[np.arange(len(words)) - np.repeat(first, count[some])]
        for j in range(2):
            ids[j, some] = mix(np.add.reduceat(mix(words + _gold(j + 1)) * power, first) + count[some].astype(np.uint64))
    return ids, count


def _estimate(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) whose registers agree in a share of at least ``least``, with that share."""
    regs = signed.select("u", "registers")
    rows = pairs.join(regs.withColumnsRenamed({"u": "a", "registers": "ra"}), "a").join(regs.withColumnsRenamed({"u": "b", "registers": "rb"}), "b")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            share = (x == y).mean(axis=1)
            keep = pa.array(share >= least)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share)], names=["a", "b", "share"])
            yield out.filter(keep)

    return rows.select("a", "b", "ra", "rb").mapInArrow(tidy(run), "a binary, b binary, share double")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard, similarity) of the pairs whose whole texts share at least ``threshold`` of their shingles.

    ``similarity`` is the one by weights 1 + ln(count).
    """
    rows = pairs.select("a", "b").join(texts.withColumnsRenamed({"u": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"u": "b", "text": "tb"}), "b")

    def run(batches):
        for b in batches:
            sides = []
            for i in (2, 3):
                side = []
                for _, _, buf, off in _pieces(b.column(i)):
                    h, r, w, _, _ = weighted_shingles(buf, off)
                    at = np.searchsorted(r, np.arange(len(off)))
                    side += [(h[s:e], w[s:e]) for s, e in zip(at[:-1], at[1:])]
                sides.append(side)
            plain = np.array([jaccard(x[0], y[0]) for x, y in zip(*sides)], np.float64)
            weighted = np.array([similarity(*x, *y) for x, y in zip(*sides)], np.float64)
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(plain), pa.array(weighted)], names=["a", "b", "jaccard", "similarity"])
            yield out.filter(pa.array(plain >= threshold))

    return rows.select("a", "b", "ta", "tb").mapInArrow(tidy(run), _LINK)


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How many of the texts hold a shingle, by the shingle's hash modulo _SLOTS, on a scale of 8 steps a doubling."""

    def run(batches):
        total = np.zeros(_SLOTS, np.int32)
        for b in batches:
            for _, _, buf, off in _pieces(b.column(0)):
                total += np.bincount((weighted_shingles(buf, off)[0] % np.uint64(_SLOTS)).astype(np.int64), minlength=_SLOTS).astype(np.int32)
        parts = total.reshape(-1, _CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[k].tobytes() for k in some], pa.binary())], names=["chunk", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for c in t.column("counts").to_pylist():
            total += np.frombuffer(c, np.int32)
        steps = np.round(8 * np.log2(total + 1)).astype(np.int16)
        return pa.table({"chunk": t.column("chunk")[:1], "counts": pa.array([steps.tobytes()], pa.binary())})

    rows = texts.select("text").mapInArrow(tidy(run), "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros((_SLOTS // _CHUNK, _CHUNK), np.int16)
    for chunk, counts in rows.collect():  # at most _SLOTS / _CHUNK rows
        out[chunk] = np.frombuffer(counts, np.int16)
    return out.reshape(-1)


def _rare_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b of ``texts`` (u, text, l), of different l, among them all with ``threshold`` or more of Jaccard similarity.

    A text's shingles are put in one order for all texts, rare ones first (by counters,
    so that any count gives right pairs). Texts of n <= m shingles that are similar
    enough share at least o = t / (1 + t) (n + m). Before the first shared one at
    places i and j neither has a shared one, so n - i >= o and m - j >= o, hence
    i <= n (1 - t) / (1 + t): such a place is early. Shingles that many texts share come
    late in all of them and meet no early place. Pairs inside the component with the
    most texts of a shingle are not made at all.
    """
    spark = texts.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(_frequencies(texts))
    t, slack = threshold, 1e-9

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in _pieces(b.column(1)):
                h, r, _, _, _ = weighted_shingles(buf, off)
                order = np.lexsort((h, ranks.value[(h % np.uint64(_SLOTS)).astype(np.int64)], r))
                h = h[order]
                size = np.bincount(r, minlength=hi - lo)
                n = size[r]
                i = np.arange(len(h)) - (np.cumsum(size) - size)[r]
                at = np.flatnonzero(n - i >= t * n - slack * n)
                row = pa.array(lo + r[at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[at].view(np.int64)), b.column(0).take(row), b.column(2).take(row), pa.array(n[at].astype(np.int64)), pa.array(i[at].astype(np.int64))],
                    names=["h", "u", "l", "n", "i"],
                )

    places = materialise(texts.select("u", "text", "l").mapInArrow(tidy(run), "h long, u binary, l binary, n long, i long"))
    early = (F.col("n") - F.col("i")) >= (2 * t / (1 + t) - slack) * F.col("n")
    by_label = places.groupBy("h", "l").agg(F.count("*").alias("k"), F.max(early).alias("early"))
    most = by_label.groupBy("h").agg(F.max(F.struct("k", "l")).alias("m"), F.count("*").alias("labels"), F.max("early").alias("early"))
    most = materialise(most.where("labels > 1 and early").select("h", F.col("m.l").alias("top")))
    rows = materialise(places.join(most, "h").select("h", "u", "l", "n", "i", (F.col("l") == F.col("top")).alias("top")))  # written, so that a join can split a hot one
    y = rows.withColumnsRenamed({c: f"y{c}" for c in ("u", "l", "n", "i")})
    x = rows.where(early).withColumn("top", F.explode(F.when(F.col("top"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    least = (t / (1 + t) - slack) * (F.col("n") + F.col("yn"))
    met = x.join(y, ["h", "top"]).where((F.col("l") != F.col("yl")) & ((F.col("n") < F.col("yn")) | ((F.col("n") == F.col("yn")) & (F.col("u") < F.col("yu")))))
    met = met.where((F.col("n") - F.col("i") >= least) & (F.col("yn") - F.col("yi") >= least))
    return met.select(F.least("u", "yu").alias("a"), F.greatest("u", "yu").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = 0.8, max_sweeps: int = 2) -> dict[str, DataFrame]:
    """``members`` (key, u, class) and ``links`` (a, b, jaccard, similarity; ends are texts' u).

    A link needs ``threshold`` or more of plain Jaccard similarity of the shingle sets;
    the registers that find the candidates estimate the same measure. After at most
    ``max_sweeps`` sweeps the rest is settled by rare shingles; fewer sweeps leave more of it.

    ``class`` is the u of the smallest text of the component; texts without words
    (null, empty, only punctuation) have no u and are in no class. Equal keys and
    repeated rows are members each. Other columns are ignored; an empty table gives
    empty results.
    """
    with temporary(docs.sparkSession) as kept:
        found = _near_duplicates(docs, key, text, threshold, max_sweeps)
        kept += found.values()
        return found


def _near_duplicates(docs: DataFrame, key: str, text: str, threshold: float, max_sweeps: int) -> dict[str, DataFrame]:
    spark = docs.sparkSession
    signed_rows = materialise(sign(docs, key=key, text=text))
    signed = materialise(
        signed_rows.where("u is not null").groupBy("u").agg(F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("registers").alias("registers"))
    )
    # Members of buckets with two texts or more.
    in_bucket = signed.select("u", F.explode("bands").alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("bucket", "n")
    shared = materialise(shared)  # a join with a written table can split a hot bucket
    members = materialise(in_bucket.join(shared, "bucket"))
    # Each candidate's text, read once per distinct text.
    wanted = members.select("u").distinct().join(signed.select("u", "key"), "u")
    rows = with_words_id(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "text", "u").where("u is not null")
    right = wanted.withColumnsRenamed({"u": "wu", "key": "wk"})
    texts = rows.join(right, (F.col("u") == F.col("wu")) & F.col("key").eqNullSafe(F.col("wk"))).select("u", "text").dropDuplicates(["u"])
    texts = materialise(texts)

    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    links, labels, tested = spark.createDataFrame([], _LINK), None, None

    def met(now: DataFrame) -> DataFrame:
        """Pairs a, b of each member with its bucket's leader, if their components differ."""
        met_by = materialise(now.groupBy("u").agg(F.sum("n").alias("d")))
        now = materialise(now.join(met_by, "u"))
        order = [(-F.col("d")).alias("d"), F.xxhash64("u").alias("o"), "u", "l"]
        lead = now.groupBy("bucket").agg(F.min(F.struct(*order)).alias("lead"))
        pairs = now.join(materialise(lead), "bucket").where(F.col("l") != F.col("lead.l"))
        return pairs.select(F.least("u", "lead.u").alias("a"), F.greatest("u", "lead.u").alias("b")).distinct()

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("l", F.col("u"))
        return members.join(labels.withColumnRenamed("v", "u"), "u", "left").withColumn("l", F.coalesce("l", "u"))

    def still_mixed(now: DataFrame, least: int = 2) -> DataFrame:
        """The members of buckets of at least so many texts that hold several components."""
        mixed = now.groupBy("bucket").agg(F.min("l").alias("lo"), F.max("l").alias("hi"), F.count("*").alias("n")).where(f"lo != hi and n >= {least}")
        return now.drop("n").join(mixed.select("bucket", "n"), "bucket")

    def settle(pairs: DataFrame) -> bool:
        """Verify ``pairs`` (a, b) that their registers call likely and take in the links; whether there are any."""
        nonlocal links, labels
        new = materialise(_verify(_estimate(pairs.select("a", "b"), signed, least), texts, threshold))
        if not new.limit(1).count():
            return False
        links = links.unionByName(new)
        labels = joined(labels, new.select("a", "b"))
        return True

    for _ in range(max_sweeps):
        pairs = met(labelled() if labels is None else still_mixed(labelled()))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        if not settle(pairs):
            break
    # Buckets of two are settled by their leader; of larger ones some texts may not have met.
    rest = materialise(still_mixed(labelled(), 3 if max_sweeps else 2).select("u", "l").distinct())
    if rest.limit(1).count():
        pairs = _rare_pairs(texts.join(rest, "u"), threshold)
        settle(materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")))
    out = signed_rows.select("key", "u")
    if labels is not None:
        out = out.join(labels.withColumnRenamed("v", "u"), "u", "left").select("key", "u", F.coalesce("l", "u").alias("class"))
    else:
        out = out.withColumn("class", F.col("u"))
    return {"members": materialise(out), "links": materialise(links)}


def classes(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """key, class_id (the smallest key of the class), class_size, kept (true for that one), one row per document."""
    m = near_duplicates(docs, key=key, **options)["members"]
    size = m.where("class is not null").groupBy("class").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    out = m.join(size, "class", "left").select(
        F.col("key").alias(key),
        F.when(F.col("class").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )
    return out.withColumn("kept", (F.col("class_size") == 1) | F.col(key).eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents of a class that has a smaller key; all columns stay.

    Of rows that share the smallest key one stays, the one whose words hash lowest.
    Documents without words all stay.
    """
    m = near_duplicates(docs, key=key, text=text, **options)["members"]
    lone = m.where("class is not null").groupBy("class").agg(F.min(F.struct("key", "u")).alias("k"), F.count("*").alias("n"))
    stay = materialise(lone.select("k.key", "k.u"))
    u, su, sk = (free(c, docs.columns) for c in ("_u", "_su", "_sk"))
    rows = with_words_id(docs, text, u)
    right = stay.select(F.col("key").alias(sk), F.col("u").alias(su))
    kept = rows.join(right, F.col(u).eqNullSafe(F.col(su)) & F.col(key).eqNullSafe(F.col(sk)), "left")
    kept = kept.where(F.col(u).isNull() | F.col(su).isNotNull())
    again = m.where("u is not null").groupBy("key", "u").count().where("count > 1").limit(1).count()
    if again:  # repeated rows: of equal key and words, one stays
        kept = kept.where(F.col(u).isNull()).unionByName(kept.where(F.col(u).isNotNull()).dropDuplicates([u]))
    return kept.select(*docs.columns)
