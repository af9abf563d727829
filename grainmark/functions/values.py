"""Value counts, exact quantiles, exact ranks and row positions.

All of these are built so that no single task ever holds a whole column:

* ``value_counts`` collapses equal cells map-side, so a hot value is one row
  after the first exchange;
* ``quantiles`` brackets each wanted order statistic with a bounded sketch and
  only ranks the cells inside the bracket;
* ``value_runs`` and ``with_position`` range-partition, number rows inside a
  partition and add the (few) partition offsets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, kind, one_row
from .scratch import materialise

# Up to this many rows one aggregation buffer may hold the distinct values of a
# column; beyond it the bracketed path is used.
EXACT_ROWS = 5_000_000
SKETCH = 10_000


def _cell(f: T.StructField) -> tuple[str, Column]:
    """Which of the three typed value slots a column uses, and its expression."""
    t, c = f.dataType, col(f.name)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "d", c.cast("double")
    if isinstance(t, T.DecimalType):
        return ("d", c.cast("double")) if t.precision <= 15 else ("s", c.cast("string"))
    if isinstance(t, (T.IntegralType, T.BooleanType)):
        return "i", c.cast("long")
    if isinstance(t, T.TimestampType):
        return "i", F.unix_micros(c)
    if isinstance(t, T.DateType):
        return "i", F.unix_date(c).cast("long")
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return "s", F.to_json(c)
    return "s", c.cast("string")


def slot(f: T.StructField) -> str:
    return _cell(f)[0]


def value_counts(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(column, i, d, s, n): how often every distinct cell value occurs.

    Exactly one of ``i`` (integral, boolean, time), ``d`` (floating) and ``s``
    (text, nested) is set; all three are null for the missing-value row.
    """
    fields = [df.schema[n] for n in (names or df.columns)]
    structs = []
    for k, f in enumerate(fields):
        slot, value = _cell(f)
        structs.append(
            F.struct(
                F.lit(k).alias("c"),  # a number goes through the exchange, not the name
                (value if slot == "i" else F.lit(None).cast("long")).alias("i"),
                (value if slot == "d" else F.lit(None).cast("double")).alias("d"),
                (value if slot == "s" else F.lit(None).cast("string")).alias("s"),
            )
        )
    return (
        df.select(F.inline(F.array(*structs)))
        .groupBy("c", "i", "d", "s")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.get(F.array(*[F.lit(f.name) for f in fields]), F.col("c")).alias("column"), "i", "d", "s", "n")
    )


def has_value() -> Column:
    return F.col("i").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()


def value_text(df: DataFrame, names: Sequence[str] | None = None, prefix: str = "") -> Column:
    """The counted value of a ``value_counts`` row as text of its own type."""
    i, d, s = (F.col(prefix + x) for x in "ids")
    out = F.coalesce(i.cast("string"), d.cast("string"), s)
    for n in names or df.columns:
        t = df.schema[n].dataType
        back = None
        if isinstance(t, T.BooleanType):
            back = i.cast("boolean").cast("string")
        elif isinstance(t, T.TimestampType):
            back = F.timestamp_micros(i).cast("string")
        elif isinstance(t, T.DateType):
            back = F.date_from_unix_date(i.cast("int")).cast("string")
        if back is not None:
            out = F.when(F.col("column") == n, back).otherwise(out)
    return out


LONG_TEXT = 32  # bytes; longer texts are counted by 128-bit digests
TIES_SENT = 100_000  # digests of 20 bytes that may be sent to all tasks


def _long_texts(df: DataFrame, names: Sequence[str]) -> set[str]:
    """Columns whose texts in the first thousand rows are long; decides how, not what, is counted."""
    loose = [f.name for f in df.schema.fields if f.name in set(names) and _cell(f)[0] == "s"]
    if not loose:
        return set()
    got = df.select(*[F.octet_length(_cell(df.schema[c])[1]).alias(f"x{k}") for k, c in enumerate(loose)]).limit(1000)
    size = got.agg(*[F.avg(f"x{k}").alias(f"x{k}") for k in range(len(loose))]).first()
    return {c for k, c in enumerate(loose) if (size[k] or 0) > LONG_TEXT}


def typed_counts(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """How often every distinct cell value occurs: (c, v, n) per kind of value, c being the column's number.

    Kinds are "i", "d", "s" as in ``value_counts`` and "t" for long texts, whose rows are
    (c, h, g, n) with a digest. So there are at most four narrow exchanges, whatever the number
    of columns, and no long text goes through one. Missing cells are one row with a null.
    """
    names = list(names or df.columns)
    long_ = _long_texts(df, names)
    cells: dict[str, list[Column]] = {}
    for k, name in enumerate(names):
        slot, v = _cell(df.schema[name])
        if name in long_:
            h, g = (F.when(v.isNotNull(), x) for x in (F.xxhash64(v), F.xxhash64(F.lit(7), v)))
            cells.setdefault("t", []).append(F.struct(F.lit(k).alias("c"), h.alias("h"), g.alias("g")))
        else:
            cells.setdefault(slot, []).append(F.struct(F.lit(k).alias("c"), v.alias("v")))
    return {
        slot: df.select(F.inline(F.array(*rows))).groupBy("c", *(["h", "g"] if slot == "t" else ["v"])).agg(F.count(F.lit(1)).alias("n"))
        for slot, rows in cells.items()
    }


def written_counts(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """``typed_counts`` written by one job, in which all kinds are counted side by side."""
    counts = typed_counts(df, names)
    types = {"i": "long", "d": "double", "s": "string", "h": "long", "g": "long"}
    parts = []
    for slot, c in counts.items():
        held = {"h": F.col("h"), "g": F.col("g")} if slot == "t" else {slot: F.col("v")}
        parts.append(c.select(F.lit(slot).alias("slot"), "c", *[held.get(x, F.lit(None)).cast(t).alias(x) for x, t in types.items()], "n"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = materialise(every)
    return {
        slot: every.where(F.col("slot") == slot).select("c", *(["h", "g"] if slot == "t" else [F.col(slot).alias("v")]), "n") for slot in counts
    }


def _commonest_texts(df: DataFrame, names: Sequence[str], counts: DataFrame) -> DataFrame:
    """(c, s): the smallest of the commonest texts of each column that was counted by digests."""
    tops = {r["c"]: r["n"] for r in counts.where("h IS NOT NULL").groupBy("c").agg(F.max("n").alias("n")).collect()}
    text = lambda c: _cell(df.schema[names[c]])[1]
    parts = []
    if single := [c for c, n in tops.items() if n == 1]:  # all texts are as common as each other
        one = df.agg(*[F.min(text(c)).alias(f"s{c}") for c in single])
        parts.append(one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"s{c}").alias("s")) for c in single]))))
    if several := [c for c, n in tops.items() if n > 1]:
        best = F.coalesce(*[F.when(F.col("c") == c, F.lit(tops[c])) for c in several])
        tied = materialise(counts.where(F.col("h").isNotNull() & (F.col("n") == best)).select("c", "h", "g"))
        rows = F.array(*[F.struct(F.lit(c).alias("c"), F.xxhash64(text(c)).alias("h"), F.xxhash64(F.lit(7), text(c)).alias("g"), text(c).alias("s")) for c in several])
        few = tied.count() <= TIES_SENT
        found = df.select(F.inline(rows)).where("s IS NOT NULL").join(F.broadcast(tied) if few else tied, ["c", "h", "g"], "left_semi")
        parts.append(found.groupBy("c").agg(F.min("s").alias("s")))
    if not parts:
        return df.sparkSession.createDataFrame([], "c int, s string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def value_summary(df: DataFrame, names: Sequence[str] | None = None, counts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per column: rows, missing, distinct, most and least frequent, entropy,
    and min, max, mean of the numeric ones.

    ``entropy`` is in bits over the non-missing values; ties for the most
    frequent value go to the smallest. ``counts`` are the ``typed_counts`` of the
    same columns, if they are at hand. Of long texts only the commonest is fetched, by a second pass.
    """
    names = list(names or df.columns)
    counts = counts or typed_counts(df, names)
    n = F.col("n")
    parts = []
    for slot, c in counts.items():
        if slot == "t":
            c = each = materialise(c)
        v = F.col("h" if slot == "t" else "v")
        ok = v.isNotNull()
        number_ = v.cast("double") if slot in ("i", "d") else F.lit(None).cast("double")
        lowest = F.min(v) if slot != "t" else F.lit(None)
        # first per number of copies, in primitive buffers; there are few such numbers
        c = c.groupBy("c", ok.alias("ok"), "n").agg(
            F.count(F.lit(1)).alias("k"), lowest.alias("v"), F.min(number_).alias("min"), F.max(number_).alias("max"), F.sum(number_).alias("sum")
        )
        ok, rows = F.col("ok"), n * F.col("k")
        top = F.min(F.when(ok, F.struct((-n).alias("neg"), "v")))["v"]
        per = c.groupBy("c").agg(
            F.sum(rows).alias("n_rows"),
            F.coalesce(F.sum(F.when(~ok, rows)), F.lit(0)).alias("n_missing"),
            F.coalesce(F.sum(F.when(ok, F.col("k"))), F.lit(0)).alias("n_distinct"),
            F.max(F.when(ok, n)).alias("top_n"),
            F.min(F.when(ok, n)).alias("least_n"),
            F.max("n").alias("top_n_any"),
            (top if slot == "i" else F.lit(None)).cast("long").alias("i"),
            (top if slot == "d" else F.lit(None)).cast("double").alias("d"),
            (top if slot == "s" else F.lit(None)).cast("string").alias("s"),
            F.sum(F.when(ok, rows * F.log2(n.cast("double")))).alias("nlogn"),
            F.sum(F.when(ok, rows)).alias("n_present"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            (F.sum(F.col("sum") * n) / F.sum(F.when(F.col("sum").isNotNull(), rows))).alias("mean"),
        )
        if slot == "t":
            per = per.drop("s").join(F.broadcast(_commonest_texts(df, names, each)), "c", "left")  # one row per column
        parts.append(per)
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    present = F.col("n_present").cast("double")
    return per.select(
        F.get(F.array(*[F.lit(x) for x in names]), F.col("c")).alias("column"),
        "n_rows",
        "n_missing",
        "n_distinct",
        "top_n",
        "least_n",
        "top_n_any",
        "i",
        "d",
        "s",
        F.when(present > 0, F.log2(present) - F.col("nlogn") / present).alias("entropy"),
        "min",
        "max",
        "mean",
    )


def count_quantiles(counts: DataFrame, probs: Sequence[float], small_rows: int = EXACT_ROWS) -> DataFrame:
    """(c, n, q): exact linear-interpolated quantiles per column from written (c, v, n) rows.

    Up to ``small_rows`` distinct values a column is sorted in one task; beyond, values are
    range-partitioned.
    """
    cells = counts.where(F.col("v").isNotNull()).select("c", F.col("v").cast("double").alias("value"), "n")
    if cells.count() <= small_rows:
        w = Window.partitionBy("c").orderBy("value")
        upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        runs = cells.select("c", "value", "n", (upto - F.col("n")).alias("below"), total.alias("total"))
    else:
        runs = value_runs(cells, ["c"])
    at = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    holds = lambda k: (F.col("below") <= k) & (F.col("below") + F.col("n") > k)
    ends = [F.max(F.when(holds(f(at(p))), F.col("value"))).alias(f"{e}{j}") for j, p in enumerate(probs) for e, f in (("a", F.floor), ("b", F.ceil))]
    per = runs.groupBy("c").agg(F.max("total").alias("total"), *ends)
    q = [F.col(f"a{j}") + (F.col(f"b{j}") - F.col(f"a{j}")) * (at(p) - F.floor(at(p))) for j, p in enumerate(probs)]
    return per.select("c", F.col("total").alias("n"), F.array(*q).alias("q"))


def value_runs(pairs: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values per key with their exact rank range.

    Input: non-null ``keys`` and ``value``; optional column ``n`` holds a
    pre-counted multiplicity. Output adds ``n`` (copies), ``below`` (how many
    rows of the key are smaller) and ``total`` (rows of the key). Average rank
    of a value is ``below + (n + 1) / 2``.
    """
    keys = list(keys)
    weight = F.sum("n") if "n" in pairs.columns else F.count(F.lit(1))
    counts = pairs.groupBy(*keys, value).agg(weight.alias("n"))
    cut = counts.repartitionByRange(*keys, value).withColumn("seg", F.spark_partition_id())
    cut = materialise(cut)
    per = cut.groupBy(*keys, "seg").agg(F.sum("n").alias("m"))
    mine = Window.partitionBy(*keys)
    offsets = per.select(
        *keys,
        "seg",
        (F.sum("m").over(mine.orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("start"),
        F.sum("m").over(mine).alias("total"),
    )
    inside = Window.partitionBy(*keys, "seg").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(offsets, [*keys, "seg"]).select(
        *keys,
        value,
        "n",
        (F.col("start") + F.sum("n").over(inside) - F.col("n")).alias("below"),
        "total",
    )


def long_values(df: DataFrame, exprs: Mapping[str, Column], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, value double) with missing cells removed."""
    rows = F.array(*[F.struct(F.lit(k).alias("column"), e.cast("double").alias("value")) for k, e in exprs.items()])
    return df.select(*[col(k) for k in keep], F.inline(rows)).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def quantiles(
    df: DataFrame,
    exprs: Mapping[str, Column],
    probs: Sequence[float],
    small_rows: int = EXACT_ROWS,
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of several expressions at once."""
    labels = list(exprs)
    if not labels:
        return {}
    clean = {k: F.when(~F.isnan(e.cast("double")), e.cast("double")) for k, e in exprs.items()}
    if df.count() <= small_rows:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        got = one_row(df, {k: F.percentile(clean[k], arr) for k in labels})
        return {k: list(v) if v is not None else [None] * len(probs) for k, v in got.items()}
    return _bracketed(df, clean, probs)


def _bracketed(df: DataFrame, exprs: Mapping[str, Column], probs: Sequence[float]) -> dict[str, list[float | None]]:
    labels = list(exprs)
    narrow = df.select(*[e.alias(f"x{i}") for i, e in enumerate(exprs.values())])
    slack = 3.0 / SKETCH
    asked = [min(1.0, max(0.0, q)) for p in probs for q in (p - slack, p + slack)]
    aggs: dict[str, Column] = {}
    for i in range(len(labels)):
        x = F.col(f"x{i}")
        aggs[f"n{i}"] = F.count(x)
        aggs[f"lo{i}"], aggs[f"hi{i}"] = F.min(x), F.max(x)
        aggs[f"s{i}"] = F.percentile_approx(x, asked, SKETCH)
    first = one_row(narrow, aggs)

    # (column index, prob index) -> bracket and the two wanted 0-based ranks
    targets: dict[tuple[int, int], tuple[float, float, int, int]] = {}
    for i in range(len(labels)):
        n = first[f"n{i}"]
        for j, p in enumerate(probs):
            if n:
                at = p * (n - 1)
                lo = first[f"s{i}"][2 * j] if p - slack > 0 else first[f"lo{i}"]
                hi = first[f"s{i}"][2 * j + 1] if p + slack < 1 else first[f"hi{i}"]
                targets[i, j] = (lo, hi, math.floor(at), math.ceil(at))
    if not targets:
        return {k: [None] * len(probs) for k in labels}
    sides: dict[str, Column] = {}
    for (i, j), (lo, hi, _, _) in targets.items():
        x = F.col(f"x{i}")
        sides[f"b{i}_{j}"] = F.count(F.when(x < lo, 1))
        sides[f"w{i}_{j}"] = F.count(F.when(x.between(lo, hi), 1))
    seen = one_row(narrow, sides)
    below: dict[tuple[int, int], int] = {}
    for (i, j), (lo, hi, k0, k1) in targets.items():
        b, w = seen[f"b{i}_{j}"], seen[f"w{i}_{j}"]
        if not (b <= k0 and k1 < b + w):  # sketch missed: rank the whole column
            targets[i, j] = (first[f"lo{i}"], first[f"hi{i}"], k0, k1)
            b = 0
        below[i, j] = b

    cells = F.array(
        *[
            F.struct(
                F.lit(f"{i}_{j}").alias("target"),
                F.when(F.col(f"x{i}").between(lo, hi), F.col(f"x{i}")).alias("value"),
            )
            for (i, j), (lo, hi, _, _) in targets.items()
        ]
    )
    inside = narrow.select(F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))
    runs = value_runs(inside, ["target"])
    wanted = F.lit(False)
    for (i, j), (_, _, k0, k1) in targets.items():
        for k in {k0, k1}:
            at = k - below[i, j]
            wanted = wanted | (
                (F.col("target") == f"{i}_{j}") & (F.col("below") <= at) & (F.col("below") + F.col("n") > at)
            )
    found: dict[str, list] = {}
    for r in runs.filter(wanted).collect():  # at most two rows per target
        found.setdefault(r["target"], []).append(r)
    out: dict[str, list[float | None]] = {k: [None] * len(probs) for k in labels}
    for (i, j), (_, _, k0, k1) in targets.items():
        rows = found[f"{i}_{j}"]

        def at_rank(k: int) -> float:
            k -= below[i, j]
            return next(r["value"] for r in rows if r["below"] <= k < r["below"] + r["n"])

        frac = probs[j] * (first[f"n{i}"] - 1) - k0
        lo, hi = at_rank(k0), at_rank(k1)
        out[labels[i]][j] = lo + (hi - lo) * frac
    return out


def with_position(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the exact 0-based global position of every row in ``order``.

    The order must be total (end it with a key column) for a repeatable answer.
    """
    sorted_ = (
        df.repartitionByRange(*[col(o) for o in order])
        .sortWithinPartitions(*[col(o) for o in order])
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    cut = materialise(sorted_)
    seg = F.shiftright("__mid", 33).alias("__seg")
    within = F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    per = cut.groupBy(seg).agg(F.count(F.lit(1)).alias("__m"))
    # one row per partition: a bounded, tiny global window
    upto = Window.orderBy("__seg").rowsBetween(Window.unboundedPreceding, 0)
    offsets = per.select("__seg", (F.sum("__m").over(upto) - F.col("__m")).alias("__start"))
    return (
        cut.withColumn("__seg", F.shiftright("__mid", 33))
        .join(F.broadcast(offsets), "__seg")
        .withColumn(name, F.col("__start") + within)
        .drop("__seg", "__start", "__mid")
    )


def blocks_with_halo(df: DataFrame, position: str, back: int, ahead: int = 0, rows: int = 1_000_000) -> DataFrame:
    """Cut positioned rows into equal blocks for windows that look a fixed way.

    Each block also receives copies of the ``back`` rows before it and the
    ``ahead`` rows after it; ``own`` tells a block's own rows from the copies.
    """
    size = max(rows, back, ahead, 1)
    block = F.floor(F.col(position) / size)
    off = F.col(position) - block * size
    copies = F.array_compact(
        F.array(
            block,
            F.when(off >= size - back, block + 1) if back else F.lit(None).cast("long"),
            F.when((off < ahead) & (block > 0), block - 1) if ahead else F.lit(None).cast("long"),
        )
    )
    return df.withColumn("block", F.explode(copies)).withColumn(
        "own", F.floor(F.col(position) / size) == F.col("block")
    )
