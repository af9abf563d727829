"""Nearest neighbours by largest inner product in a hash-prefix forest.

A tree is the table sorted by a string of 63 hash bits, signs of random projections. Vectors
of different lengths get one more component that brings all to the longest one's length, so
that the angle to a query, which gets 0 there, orders rows by inner product. A prefix of x
bits is a contiguous stretch of a tree. A query descends in every tree to its longest
prefix that any row has, then ascends in all trees at once, a bit at a time, until the
stretches together hold ``candidates`` rows: its prefix has the same length in all trees.

How many candidates are needed depends on the data, so it is measured: a bounded sample of
``probes`` queries is compared with all rows, and the smallest share of the table is taken by
which these find at least ``recall`` of their nearest. Data without any structure needs a
large share; clustered data a small one. Prefix lengths are found in a bounded
sample of the hash strings of each tree (all of them in tables up to ``sample`` rows).
Every row is in every tree, and all candidates of a query are scored, in double precision.

Trees are cut into pages of about ``page`` rows at sampled borders. Rows go once to each tree,
queries to the pages that their stretch meets; a task reads the rows of a page,
then its queries in Arrow batches, so memory is bounded by the page. Pages that one repeated
string fills are dealt out by hash. Equal vectors are one entry that carries its smallest keys,
k + 1 of them, and equal queries are asked once, so copies do not multiply.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialise
from ..functions.ship import ship
from .textbytes import mix, tidy

TREES, BITS = 3, 63
PAGE, SAMPLE, PROBES = 32_768, 200_000, 200
RECALL = 0.95
_MOST_PAGES = 16_384
_BLOCK = 1 << 22
_SEED = 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, as they are stored."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _digests(x: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row's numbers (-0.0 is 0.0)."""
    words = np.ascontiguousarray(x.astype(np.float64) + 0.0).view(np.uint64)
    out = np.empty((2, len(x)), np.uint64)
    for j in range(2):
        code = mix(np.arange(1, words.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * j))
        out[j] = mix((mix(words ^ code) * (code | np.uint64(1))).sum(axis=1, dtype=np.uint64))
    return out.view(np.int64)


def _planes(width: int, trees: int) -> np.ndarray:
    return np.random.default_rng(_SEED).standard_normal((width + 1, trees * BITS)).astype(np.float64)


def _strings(x: np.ndarray, longest: float | None, planes: np.ndarray, trees: int) -> np.ndarray:
    """trees x rows hash strings as numbers below 2^63; ``longest`` is None for queries."""
    x = x.astype(np.float64)
    signs = x @ planes[:-1]
    if longest is not None:
        rest = np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))
        signs += rest[:, None] * planes[-1]
    bit = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
    return ((signs > 0).reshape(len(x), trees, BITS) @ bit).T


def _fit(docs: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, v) of the rows that take part, and the length of their vectors, the commonest one (of ties the longest)."""
    spark = docs.sparkSession
    plain = docs.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("key is not null and v is not null and size(v) > 0")
    ok = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    plain = plain.where(ok)
    width = plain.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if width is None:
        return spark.createDataFrame([], plain.schema), 0
    return plain.where(F.size("v") == width["w"]), width["w"]


def _smallest_keys(lists: DataFrame, by: list, k: int) -> DataFrame:
    keys = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))), 1, k)
    return lists.groupBy(*by).agg(keys.alias("keys"), F.sum("n").alias("n"))


def _copies(rows: DataFrame, k: int) -> DataFrame:
    """(d1, d2, keys) of vectors that several rows have, with the ``k`` smallest keys, from small lists per batch."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.table({"key": b.column(0), "d1": b.column(1), "d2": b.column(2)}).sort_by([("d1", "ascending"), ("d2", "ascending"), ("key", "ascending")])
            d1, d2 = t["d1"].to_numpy(), t["d2"].to_numpy()
            first = np.flatnonzero(np.concatenate(([True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))))
            size = np.diff(np.append(first, len(d1)))
            short = np.minimum(size, k)
            at = np.repeat(first - (np.cumsum(short) - short), short) + np.arange(int(short.sum()))
            keys = t["key"].combine_chunks().take(pa.array(at))
            ptr = pa.array(np.concatenate(([0], np.cumsum(short))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(d1[first]), pa.array(d2[first]), pa.ListArray.from_arrays(ptr, keys), pa.array(size)], names=["d1", "d2", "keys", "n"])

    kind = rows.schema["key"].dataType
    schema = T.StructType(
        [T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("n", T.LongType())]
    )
    lists = rows.select("key", "d1", "d2").mapInArrow(tidy(run), schema)
    some = _smallest_keys(lists, ["d1", "d2", (F.rand(_SEED) * 64).cast("int").alias("salt")], k)
    return materialise(_smallest_keys(some, ["d1", "d2"], k).where("n > 1").select("d1", "d2", "keys"))


def _with_digests(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if b.num_rows:
                d = _digests(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d[0]), pa.array(d[1])], names=["key", "v", "d1", "d2"])

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema, T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]))


def _with_strings(rows: DataFrame, longest: float | None, width: int, trees: int) -> DataFrame:
    names = [*rows.columns, "h"]
    at = names.index("v")

    def run(batches):
        planes = _planes(width, trees)
        for b in batches:
            if b.num_rows:
                h = _strings(_matrix(b.column(at)), longest, planes, trees)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * trees), pa.array(np.ascontiguousarray(h.T).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns, lists], names=names)

    return rows.mapInArrow(tidy(run), T.StructType([*rows.schema, T.StructField("h", T.ArrayType(T.LongType()))]))


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the entries that are among their row's ``k`` largest, ties included, without -inf."""
    if score.shape[1] > k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
        return np.nonzero((score >= least) & (score > -np.inf))
    return np.nonzero(score > -np.inf)


def _probe_lengths(index: DataFrame, probes: DataFrame, trees: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a bounded number of queries: their hash strings, and for each of their true nearest the longest prefix they share."""
    got = [(r["key"], np.array(r["v"], np.float64), r["h"]) for r in probes.collect()]
    if not got:
        return np.zeros((0, trees), np.int64), np.zeros((0, 0), np.int64)
    q = np.stack([g[1] for g in got])
    h = np.array([g[2] for g in got], np.int64)
    own = pa.array([g[0] for g in got])

    def run(batches):
        for b in batches:
            n = b.num_rows
            for lo in range(0, n, max(1, _BLOCK // len(q))):
                part = b.slice(lo, max(1, _BLOCK // len(q)))
                score = q @ _matrix(part.column(1)).astype(np.float64).T
                keys = part.column(0)
                where = pa.compute.index_in(keys, own.cast(keys.type)).to_numpy(zero_copy_only=False)
                mine = np.flatnonzero(~np.isnan(where.astype(np.float64)))
                score[where[mine].astype(np.int64), mine] = -np.inf
                r, c = _best(score, k)
                hs = np.stack([np.array(x) for x in part.column(2).take(pa.array(c)).to_pylist()]) if len(c) else np.zeros((0, trees), np.int64)
                far = (hs ^ h[r]).min(axis=1) if len(c) else np.zeros(0, np.int64)
                shared = np.where(far > 0, BITS - 1 - np.floor(np.log2(np.maximum(far, 1).astype(np.longdouble))).astype(np.int64), BITS)
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(score[r, c]), pa.array(shared)], names=["q", "score", "shared"])

    near = index.select("key", "v", "h").mapInArrow(tidy(run), "q long, score double, shared long")
    near = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "shared")), asc=False), 1, k).alias("near"))
    out = np.full((len(got), k), -1, np.int64)
    for r in near.collect():
        s = [x["shared"] for x in r["near"]]
        out[r["q"], : len(s)] = s
    return h, out


class Forest:
    """Sorted samples of each tree's strings, page borders, and the number of candidates."""

    def __init__(self, samples: np.ndarray, rows: int, page: int):
        self.samples = np.sort(samples, axis=1)
        self.rows = rows
        n = self.samples.shape[1]
        pages = int(np.clip(rows // page, 1, min(_MOST_PAGES, max(1, n))))
        self.borders = self.samples[:, (np.arange(1, pages) * n) // pages]
        self.candidates = rows

    def stretch(self, h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last string with the prefixes of ``bits`` bits of ``h``."""
        gap = BITS - bits
        lo = (h >> gap) << gap
        return lo, lo + ((1 << gap) - 1)

    def held(self, h: np.ndarray, bits: int) -> np.ndarray:
        """About how many rows, over all trees, share the prefixes of queries' strings (queries x trees)."""
        lo, hi = self.stretch(h, bits)
        total = np.zeros(len(h))
        for t, s in enumerate(self.samples):
            total += np.searchsorted(s, hi[:, t], "right") - np.searchsorted(s, lo[:, t], "left")
        return total * (self.rows / max(1, self.samples.shape[1]))

    def lengths(self, h: np.ndarray, candidates: float) -> np.ndarray:
        """The prefix length of each query: down to the longest any tree has, then up in all trees until there are enough."""
        out = np.zeros(len(h), np.int64)
        lo = np.zeros(len(h), np.int64)
        hi = np.full(len(h), BITS)
        while (lo < hi).any():  # counts only grow on the way up, so the first that suffices is found by halving
            mid = (lo + hi + 1) // 2
            enough = np.zeros(len(h), bool)
            for bits in np.unique(mid):
                k = mid == bits
                enough[k] = self.held(h[k], int(bits)) >= min(candidates, self.rows * len(self.samples))
            lo, hi = np.where(enough, mid, lo), np.where(enough, hi, mid - 1)
        out[:] = lo
        return out

    def fit(self, h: np.ndarray, shared: np.ndarray, recall: float) -> None:
        """The smallest number of candidates, on steps of a quarter, by which probes find enough."""
        known = shared >= 0
        if not known.any():
            return
        m = 64.0
        while m < self.rows * len(self.samples):
            found = (shared >= self.lengths(h, m)[:, None]) & known
            if found.sum() >= recall * known.sum():
                break
            m *= 1.25
        self.candidates = m

    def page(self, tree: int, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.borders[tree], h, "right")


def search(
    rows: DataFrame,
    queries: DataFrame,
    *,
    key: str,
    vector: str,
    k: int = 20,
    trees: int = TREES,
    recall: float = RECALL,
    page: int = PAGE,
    sample: int = SAMPLE,
    probes: int = PROBES,
) -> DataFrame:
    """query_id, rank (from 1), the key's column, score: each query's ``k`` nearest rows found, ties to the smaller key.

    ``key`` and ``vector`` name columns of both tables. A row with the query's key is its own and
    never found. Keys or vectors that are null, and vectors that are empty, zero, hold a null or
    non-finite component, or are not of the commonest length take no part. A key of several rows is
    found once, by its best score, and asked once for each of its different vectors' nearest,
    merged. Empty tables give an empty result.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[key].dataType
    valid, width = _fit(rows, key, vector)
    out_schema = T.StructType(
        [T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField(key, kind), T.StructField("score", T.DoubleType())]
    )
    if not width:
        return spark.createDataFrame([], out_schema)
    asked = queries.select(F.col(key).alias("key"), F.col(vector).alias("v")).where("key is not null and v is not null").where(F.size("v") == width)
    ok = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    asked = _with_digests(asked.where(ok))
    seen = _with_digests(valid)
    copies = _copies(seen, k + 1).withColumnsRenamed({"d1": "c1", "d2": "c2"})
    index = seen.join(copies, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")), "left")
    index = index.where(F.col("keys").isNull() | (F.col("key") == F.col("keys")[0])).select("key", "v", "keys")
    again = rows.select(F.col(key).alias("key")).where("key is not null").groupBy("key").count().where("count > 1").limit(1).count()
    if again:  # rows of one key and vector: the entry must be one row
        index = index.dropDuplicates(["key", "v"])
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    longest = valid.agg(F.max(norm)).first()[0]
    index = _with_strings(index, longest, width, trees)
    classes = asked.groupBy("d1", "d2").agg(F.first("v").alias("v"), F.min("key").alias("key"))
    classes = materialise(_with_strings(classes, None, width, trees))

    total = index.count()
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    share = min(1 << 20, int(np.ceil((1 << 20) * sample / max(1, total))))
    some = index.where(draw < share).select("h").limit(2 * sample).toPandas()["h"]
    forest = Forest(np.array(some.tolist(), np.int64).reshape(-1, trees).T, total, page)
    n_probes = classes.count()
    chosen = classes.where(draw < min(1 << 20, int(np.ceil((1 << 20) * probes / max(1, n_probes))))).limit(2 * probes)
    forest.fit(*_probe_lengths(index, chosen, trees, k), recall)
    known = spark.sparkContext.broadcast(forest)  # trees x (samples + borders) numbers, a few MB

    # Rows once to every tree; queries to the pages of their stretches.
    def to_trees(batches):
        f = known.value
        for b in batches:
            if not b.num_rows:
                continue
            h = _matrix(b.column(3))
            for t in range(trees):
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int32)), pa.array(f.page(t, h[:, t]).astype(np.int32)), pa.array(h[:, t]), *b.columns[:3]],
                    names=["tree", "page", "h", "key", "v", "keys"],
                )

    tree_schema = T.StructType(
        [T.StructField("tree", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("h", T.LongType()), *index.schema.fields[:3]]
    )
    placed = index.mapInArrow(tidy(to_trees), tree_schema)
    size = {(r["tree"], r["page"]): r["count"] for r in placed.groupBy("tree", "page").count().collect()}  # at most trees x _MOST_PAGES
    parts = np.ones((trees, len(forest.borders[0]) + 1), np.int64)
    for (t, p), n in size.items():
        parts[t, p] = max(1, round(n / page))
    dealt = spark.sparkContext.broadcast(parts)

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = dealt.value[b.column(0).to_numpy(), b.column(1).to_numpy()]
            part = (mix(b.column(6).to_numpy().view(np.uint64)) % n.astype(np.uint64)).astype(np.int32)
            zero = np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(part), pa.array(zero.astype(np.int32)), b.column(2), b.column(2), b.column(4), b.column(3), b.column(5), pa.array(zero), pa.array(zero)],
                names=meet_names,
            )

    def ask(batches):
        f, n_parts = known.value, dealt.value
        for b in batches:
            if not b.num_rows:
                continue
            h = _matrix(b.column(3))
            bits = f.lengths(h, f.candidates)
            lo, hi = (np.empty_like(h) for _ in range(2))
            for x in np.unique(bits):
                of = bits == x
                lo[of], hi[of] = f.stretch(h[of], int(x))
            for t in range(trees):
                first, last = f.page(t, lo[:, t]), f.page(t, hi[:, t])
                whole = np.concatenate(([0], np.cumsum(n_parts[t])))
                start, count = whole[first], whole[last + 1] - whole[first]
                # A few of the copies at a time.
                cut = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()) + 8192, 8192))
                for s, e in zip(cut[:-1], cut[1:] if len(cut) > 1 else [len(h)]):
                    e = len(h) if e >= len(h) else e
                    if s >= e:
                        continue
                    who = np.repeat(np.arange(s, e), count[s:e])
                    step = np.repeat(start[s:e] - (np.cumsum(count[s:e]) - count[s:e]), count[s:e]) + np.arange(len(who))
                    pg = np.searchsorted(whole, step, "right") - 1
                    pick = pa.array(who)
                    none = pa.nulls(len(who), b.column(4).type)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(who), t, np.int32)),
                            pa.array(pg.astype(np.int32)),
                            pa.array((step - whole[pg]).astype(np.int32)),
                            pa.array(np.ones(len(who), np.int32)),
                            pa.array(lo[who, t]),
                            pa.array(hi[who, t]),
                            b.column(2).take(pick),
                            none,
                            pa.nulls(len(who), pa.list_(none.type)),
                            b.column(0).take(pick),
                            b.column(1).take(pick),
                        ],
                        names=meet_names,
                    )

    meet_names = ["tree", "page", "part", "side", "lo", "hi", "v", "key", "keys", "d1", "d2"]
    meet = T.StructType(
        [
            *(T.StructField(c, T.IntegerType()) for c in meet_names[:4]),
            *(T.StructField(c, T.LongType()) for c in meet_names[4:6]),
            T.StructField("v", index.schema["v"].dataType),
            T.StructField("key", kind),
            T.StructField("keys", T.ArrayType(kind)),
            *(T.StructField(c, T.LongType()) for c in meet_names[9:]),
        ]
    )
    left = placed.withColumn("x", F.xxhash64("key")).mapInArrow(tidy(deal), meet)
    right = classes.select("d1", "d2", "v", "h", "key").withColumn("v", F.col("v").cast(index.schema["v"].dataType)).mapInArrow(tidy(ask), meet)
    both = left.unionByName(right).repartition("tree", "page", "part").sortWithinPartitions("tree", "page", "part", "side")

    def score(batches):
        at, held, table = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            place = np.stack([b.column(i).to_numpy() for i in range(4)])
            edge = np.flatnonzero(np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(axis=0), [True])))
            for s, e in zip(edge[:-1], edge[1:]):
                piece, here, side = b.slice(s, e - s), tuple(place[:3, s]), place[3, s]
                if here != at:
                    at, held, table = here, [], None
                if side == 0:
                    held.append(piece)
                    continue
                if table is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    x = _matrix(t["v"]).astype(np.float64)
                    keys = t["keys"].combine_chunks()
                    table = (x, t["lo"].to_numpy(), t["key"].combine_chunks(), keys, keys.is_valid().to_numpy(zero_copy_only=False))
                    held = []
                if table is None:
                    continue
                x, h, names, keys, several = table
                step = max(1, _BLOCK // len(x))
                for i in range(0, len(piece), step):
                    q = piece.slice(i, step)
                    y = _matrix(q.column(6)).astype(np.float64)
                    got = y @ x.T
                    got[(h < q.column(4).to_numpy()[:, None]) | (h > q.column(5).to_numpy()[:, None])] = -np.inf
                    r, c = _best(got, k + 1)
                    value = np.einsum("ij,ij->i", y[r], x[c])  # one order of adding, whatever the block
                    out_keys = names.take(pa.array(c))
                    more = np.flatnonzero(several[c])
                    if len(more):  # every key of a vector that several rows have
                        lists = keys.take(pa.array(c[more]))
                        size = pa.compute.list_value_length(lists).to_numpy()
                        one = np.flatnonzero(~several[c])
                        out_keys = pa.concat_arrays([out_keys.take(pa.array(one)), lists.flatten()])
                        r, value = (np.concatenate((z[one], np.repeat(z[more], size))) for z in (r, value))
                    pick = pa.array(r)
                    yield pa.RecordBatch.from_arrays([q.column(9).take(pick), q.column(10).take(pick), out_keys, pa.array(value)], names=["d1", "d2", "key", "score"])

    found_schema = T.StructType([T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("key", kind), T.StructField("score", T.DoubleType())])
    found = both.mapInArrow(tidy(score), found_schema)
    near = F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "key")))
    tops = found.groupBy("d1", "d2", "key").agg(F.max("score").alias("score")).groupBy("d1", "d2").agg(F.slice(near, 1, k + 1).alias("near"))
    tops = materialise(tops.withColumnsRenamed({"d1": "c1", "d2": "c2"}))
    each = asked.select("key", "d1", "d2").distinct().join(tops, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")))
    each = each.groupBy("key").agg(F.flatten(F.collect_list("near")).alias("near")) if again else each
    mine = F.filter("near", lambda x: x.key != F.col("key"))
    if again:  # of a key found through several of the query's vectors the best score
        pairs = each.select("key", F.explode(mine).alias("x")).groupBy("key", F.col("x.key").alias("k")).agg(F.min("x.s").alias("s"))
        each = pairs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", F.col("k").alias("key")))).alias("near"))
    ranked = each.select(F.col("key").alias("query_id"), F.posexplode(F.slice(mine, 1, k)).alias("rank", "x"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.key").alias(key), (-F.col("x.s")).alias("score"))
