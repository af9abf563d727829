"""Missingness analysis and the non-model imputers."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special, values
from ..functions.columns import (
    col,
    corr,
    count_if,
    frame,
    nan_to_null,
    number,
    numeric_columns,
    one_row,
    ratio,
    report,
    union_all,
)
from ..functions.scratch import materialise
from ..functions.ship import ship
from . import clean

# ---- looking at what is missing ----


def analyze_missing(df: DataFrame) -> DataFrame:
    """One row: cells missing, complete rows, most missing cells in a row."""
    df = nan_to_null(df)
    p = len(df.columns)
    gaps = sum((col(c).isNull().cast("int") for c in df.columns[1:]), col(df.columns[0]).isNull().cast("int"))
    out = df.select(gaps.alias("g")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("g").cast("long").alias("n_missing"),
        count_if(F.col("g") == 0).alias("rows_complete"),
        count_if(F.col("g") > 0).alias("rows_with_missing"),
        F.max("g").cast("long").alias("max_missing_in_row"),
    )
    return out.withColumn("missing_rate", ratio(F.col("n_missing"), F.col("n_rows") * p))


def missing_by_column(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    num = set(numeric_columns(df))
    out = report(
        df,
        {
            c: {
                "n_missing": count_if(col(c).isNull()),
                "pct_missing": ratio(count_if(col(c).isNull()) * 100.0, F.count(F.lit(1))),
                "is_numeric": F.lit(c in num),
            }
            for c in df.columns
        },
    )
    return out


def missing_mask(df: DataFrame) -> DataFrame:
    """1 where a cell is missing, 0 elsewhere."""
    df = nan_to_null(df)
    return df.select(*[col(c).isNull().cast("int").alias(c) for c in df.columns])


def mask_correlation(df: DataFrame) -> DataFrame:
    """Pearson correlation between the missing masks of columns with nulls."""
    holes = list(clean.columns_with_nulls(nan_to_null(df)))
    if len(holes) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    mask = missing_mask(df.select(*[col(c) for c in holes]))
    metrics = {f"{i},{j}": {"r": corr(number(holes[i]), number(holes[j]))} for i, j in combinations(range(len(holes)), 2)}
    look, at = F.array(*[F.lit(h) for h in holes]), F.split("pair", ",")
    out = report(mask, metrics, label="pair")
    return out.select(look[at[0].cast("int")].alias("col_a"), look[at[1].cast("int")].alias("col_b"), "r")


def missing_mechanism(df: DataFrame) -> DataFrame:
    """(mechanism, confidence, mean_p, n_tests) from equal-variance t tests.

    For every column with nulls and every other numeric column, compare the
    other column between rows where the first is missing and where it is not.
    All group moments come from one aggregate.
    """
    df = nan_to_null(df)
    schema = "mechanism string, confidence double, mean_p double, n_tests int"
    holes = clean.columns_with_nulls(df)
    spark = df.sparkSession
    if not holes:
        return frame(spark, [("NONE", 1.0, None, 0)], schema)
    num = numeric_columns(df)
    if len(num) < 2:
        return frame(spark, [("MCAR", 0.5, None, 0)], schema)
    aggs: dict[str, Column] = {"n": F.count(F.lit(1))}
    pairs = [(m, o) for m in holes for o in num if o != m]
    for i, (m, o) in enumerate(pairs):
        gone, here = F.when(col(m).isNull(), number(o)), F.when(col(m).isNotNull(), number(o))
        for tag, x in (("a", gone), ("b", here)):
            aggs[f"{tag}n{i}"], aggs[f"{tag}m{i}"], aggs[f"{tag}v{i}"] = F.count(x), F.avg(x), F.var_samp(x)
    got = one_row(df, aggs)
    ps = []
    for i, (m, _) in enumerate(pairs):
        if holes[m] < 5 or got["n"] - holes[m] < 5:
            continue
        n1, n2 = got[f"an{i}"], got[f"bn{i}"]
        if n1 < 3 or n2 < 3:
            continue
        pooled = ((n1 - 1) * got[f"av{i}"] + (n2 - 1) * got[f"bv{i}"]) / (n1 + n2 - 2)
        if pooled > 0:
            t = (got[f"am{i}"] - got[f"bm{i}"]) / math.sqrt(pooled * (1 / n1 + 1 / n2))
            ps.append(special.t_sf2(t, n1 + n2 - 2))
    if not ps:
        return frame(spark, [("MCAR", 0.5, None, 0)], schema)
    mean = sum(ps) / len(ps)
    if mean > 0.2:
        row = ("MCAR", min(mean * 2, 0.95), mean, len(ps))
    else:
        row = ("MAR", 0.6 if mean > 0.05 else 0.75, mean, len(ps))
    return frame(spark, [row], schema)


# ---- one value per column ----


def impute_simple(
    df: DataFrame,
    strategy: str | Mapping[str, str] = "mean",
    constant: object = 0,
    indicators: bool = False,
) -> DataFrame:
    """mean, median, mode, min, max, zero or constant; text falls back to mode.

    ``strategy`` may name a different one per column; ``indicators`` adds a
    0/1 ``<column>_missing`` column for every column that had nulls.
    """
    df = nan_to_null(df)
    holes = list(clean.columns_with_nulls(df))
    num = set(numeric_columns(df))
    wanted: dict[str, list[str]] = {}
    for c in holes:
        s = strategy.get(c, "mean") if isinstance(strategy, Mapping) else strategy
        wanted.setdefault(s, []).append(c)
    repl: dict[str, object] = {}
    for s, names in wanted.items():
        if s == "zero":
            repl.update({c: (0 if c in num else "0") for c in names})
        elif s == "constant":
            repl.update({c: constant for c in names if c not in num or isinstance(constant, (int, float))})
        elif s == "mean":
            nums = [c for c in names if c in num]
            if nums:
                repl.update(one_row(df, {c: F.avg(number(c)) for c in nums}))
            repl.update(clean.modes(df, [c for c in names if c not in num]))
        else:
            repl.update(clean.fill_values(df, s, names))
    out = df
    if indicators:
        out = out.withColumns({f"{c}_missing": col(c).isNull().cast("int") for c in holes})
    return clean.fill(out, repl)


def impute_drop(df: DataFrame) -> DataFrame:
    return nan_to_null(df).na.drop("any")


def impute_constant(df: DataFrame, value: object) -> DataFrame:
    return impute_simple(df, "constant", value)


# ---- by order ----
# With a group column the window is partitioned by it. Without one, the table
# is cut into equal blocks by exact position; what a block needs from the
# others is one value per block and column.


def _bounded(c: Column, prev_pos: Column, pos: Column, limit: int | None) -> Column:
    return c if limit is None else F.when(F.abs(pos - prev_pos) <= limit, c)


def _neighbours(df: DataFrame, order: Sequence[str], names: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Add, per column, structs ``__prev_c`` and ``__next_c`` (position, value)
    of the nearest observed cell at or before / at or after each row."""
    keys = [col(g) for g in group]
    if group:
        # a hot group is still split: positions are global, blocks are fixed size
        out = values.with_position(df, [*group, *order], "__pos")
    else:
        out = values.with_position(df, order, "__pos")
    out = out.withColumn("__blk", F.floor(F.col("__pos") / 500_000))
    cell = {c: F.when(col(c).isNotNull(), F.struct(F.col("__pos").alias("p"), col(c).alias("v"))) for c in names}
    # both directions are running frames: looking ahead is looking back in
    # reverse order, which costs one pass instead of one pass per row
    running = (Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "__blk").orderBy("__pos").rowsBetween(*running)
    ahead = Window.partitionBy(*keys, "__blk").orderBy(F.desc("__pos")).rowsBetween(*running)
    out = out.withColumns(
        {
            **{f"__p_{c}": F.last(e, ignorenulls=True).over(back) for c, e in cell.items()},
            **{f"__n_{c}": F.last(e, ignorenulls=True).over(ahead) for c, e in cell.items()},
        }
    )
    out = materialise(out)
    ends = out.groupBy(*keys, "__blk").agg(
        *[F.max_by(f"__p_{c}", "__pos").alias(f"__last_{c}") for c in names],
        *[F.min_by(f"__n_{c}", "__pos").alias(f"__first_{c}") for c in names],
    )
    blocks = Window.partitionBy(*keys)
    before = blocks.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.orderBy(F.desc("__blk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "__blk",
        *[F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__cp_{c}") for c in names],
        *[F.last(f"__first_{c}", ignorenulls=True).over(after).alias(f"__cn_{c}") for c in names],
    )
    # null-safe on the group so that rows without a group keep their own series
    on = out["__blk"] == carried["__blk"]
    for g in group:
        on = on & out[g].eqNullSafe(carried[g])
    joined = out.join(carried, on).drop(carried["__blk"])
    for g in group:
        joined = joined.drop(carried[g])
    return joined.withColumns(
        {
            **{f"__prev_{c}": F.coalesce(f"__p_{c}", f"__cp_{c}") for c in names},
            **{f"__next_{c}": F.coalesce(f"__n_{c}", f"__cn_{c}") for c in names},
        }
    ).drop(*[f"{x}{c}" for c in names for x in ("__p_", "__n_", "__cp_", "__cn_")], "__blk")


def _ordered_fill(df, order, columns, group, pick, both: Mapping[str, Column] | None = None) -> DataFrame:
    df = nan_to_null(df)
    names = list(columns or clean.columns_with_nulls(df))
    if not names:
        return df
    out = _neighbours(df, order, names, group)
    out = out.withColumns({c: pick(c) for c in names})
    return out.select(*[col(c) for c in df.columns])


def impute_ffill(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str] | None = None,
    group: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Last observed value, then the next one for leading gaps (LOCF)."""

    def pick(c: str) -> Column:
        p, n = F.col(f"__prev_{c}"), F.col(f"__next_{c}")
        return F.coalesce(_bounded(p["v"], p["p"], F.col("__pos"), limit), F.when(p.isNull() | F.lit(limit is not None), n["v"]))

    return _ordered_fill(df, order, columns, group, pick)


def impute_bfill(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str] | None = None,
    group: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Next observed value, then the last one for trailing gaps (NOCB)."""

    def pick(c: str) -> Column:
        p, n = F.col(f"__prev_{c}"), F.col(f"__next_{c}")
        return F.coalesce(_bounded(n["v"], n["p"], F.col("__pos"), limit), F.when(n.isNull() | F.lit(limit is not None), p["v"]))

    return _ordered_fill(df, order, columns, group, pick)


def impute_interpolate(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str] | None = None,
    group: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Straight line by row position between the nearest observed cells.

    Before the first and after the last observed cell the nearest one is used.
    With ``limit`` only cells within that many rows of an observed one fill.
    """
    df = nan_to_null(df)
    names = [c for c in (columns or clean.columns_with_nulls(df)) if c in numeric_columns(df)]

    def pick(c: str) -> Column:
        p, n, at = F.col(f"__prev_{c}"), F.col(f"__next_{c}"), F.col("__pos")
        pv, nv = p["v"].cast("double"), n["v"].cast("double")
        line = pv + (nv - pv) * (at - p["p"]) / (n["p"] - p["p"])
        filled = F.coalesce(F.when(p["p"] == n["p"], pv).otherwise(line), pv, nv)
        if limit is None:
            return filled
        near = (F.coalesce(at - p["p"], F.lit(1 << 60)) <= limit) | (F.coalesce(n["p"] - at, F.lit(1 << 60)) <= limit)
        return F.when(near, filled)

    return _ordered_fill(df, order, names, group, pick)


def impute_timeseries(
    df: DataFrame,
    time: str,
    group: str | None = None,
    method: str = "linear",
    limit: int | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """linear, locf, nocb, cubic or spline along a time column; text is carried."""
    df = nan_to_null(df)
    order, keys = [time, *tie], [group] if group else []
    holes = list(clean.columns_with_nulls(df))
    num = [c for c in holes if c in numeric_columns(df) and c != time]
    text = [c for c in holes if c not in num and c not in (time, group)]
    step = {"linear": impute_interpolate, "locf": impute_ffill, "nocb": impute_bfill}
    out = df
    if num:
        if method in step:
            out = step[method](out, order, num, keys, limit)
        elif method in ("cubic", "spline"):
            out = impute_spline(out, order, num, keys, extrapolate=method == "spline")
        else:
            raise ValueError(f"unknown method: {method}")
    return impute_ffill(out, order, text) if text else out


HALO = 60  # a knot's influence fades by about 0.27 per knot: 60 knots are far below double precision


def _curvature(pdf: pd.DataFrame) -> pd.DataFrame:
    """Second derivatives of the interpolating cubics at a block's own knots; a block holds many series.

    A series begins where ``head`` is set. True series ends, own or in the halo, get the
    not-a-knot condition; ends that are only block borders lie ``HALO`` knots away from
    every own knot. The systems of all series are one, without links between them.
    """
    pdf = pdf.sort_values("p")
    x, y, own = pdf["p"].to_numpy(float), pdf["v"].to_numpy(float), pdf["own"].to_numpy(bool)
    begins = pdf["head"].to_numpy(bool).copy()
    begins[0] = True
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, len(x)))
    end = start + size - 1
    head, tail = pdf["head"].to_numpy(bool)[start], pdf["tail"].to_numpy(bool)[end]
    m = np.full(len(x), np.nan)
    long = size >= 4
    if long.any():
        first, last = start[long], end[long]
        inner = np.repeat(long, size)
        inner[first] = inner[last] = False
        h = np.append(np.diff(x), np.nan)
        slope = np.append(np.diff(y), np.nan) / h
        before = np.roll(h, 1)
        low, diag, up = before.copy(), 2 * (before + h), h.copy()
        rhs = 6 * (slope - np.roll(slope, 1))
        i = first[head[long]] + 1
        diag[i] += low[i] * (before[i] + h[i]) / h[i]
        up[i] -= low[i] * before[i] / h[i]
        i = last[tail[long]] - 1
        diag[i] += up[i] * (h[i] + before[i]) / before[i]
        low[i] -= up[i] * h[i] / before[i]
        low[first + 1] = up[last - 1] = 0.0
        m[inner] = _tridiagonal(*(c[inner].tolist() for c in (low, diag, up, rhs)))
        m[first] = np.where(head[long], ((h[first] + h[first + 1]) * m[first + 1] - h[first] * m[first + 2]) / h[first + 1], 0.0)
        m[last] = np.where(tail[long], ((h[last - 1] + h[last - 2]) * m[last - 1] - h[last - 1] * m[last - 2]) / h[last - 2], 0.0)
    # The next knot; the last one continues the last interval.
    to = np.arange(1, len(x) + 1)
    to[end] = end - 1
    known = np.ones(len(x), bool)
    known[end] = tail & (size > 1)
    to[~known] = 0
    nexts = {n: np.where(known, c[to], np.nan) for n, c in (("np_", x), ("nv", y), ("nm", m))}
    is_first, is_last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    is_first[start], is_last[end] = head, tail
    return pdf.assign(m=m, **nexts, is_first=is_first, is_last=is_last)[own]


def _tridiagonal(low: list[float], diag: list[float], up: list[float], rhs: list[float]) -> list[float]:
    for i in range(1, len(diag)):
        w = low[i] / diag[i - 1]
        diag[i] -= w * up[i - 1]
        rhs[i] -= w * rhs[i - 1]
    out = rhs
    out[-1] /= diag[-1]
    for i in range(len(diag) - 2, -1, -1):
        out[i] = (rhs[i] - up[i] * out[i + 1]) / diag[i]
    return out


def impute_spline(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str],
    group: Sequence[str] = (),
    extrapolate: bool = False,
    block_rows: int = 20_000,
) -> DataFrame:
    """Interpolating cubic spline by row position (not-a-knot ends).

    The observed cells are cut into blocks with a halo, each solved by a small
    banded elimination, so a series of any length spreads over many tasks.
    Outside the observed range cells stay missing unless ``extrapolate``; a
    series with fewer than four observed cells gets the straight line.
    """
    df = nan_to_null(df)
    out = values.with_position(df, [*group, *order], "__pos")
    names = [f"__g{i}" for i in range(len(group))]
    ship(df.sparkSession)
    for c in columns:
        seen = out.filter(col(c).isNotNull()).select(
            *[col(g).alias(n) for g, n in zip(group, names)], F.col("__pos").alias("p"), number(c).alias("v")
        )
        knots = values.with_position(seen, ["p"], "__k")
        ends = seen.groupBy(*names).agg(F.min("p").alias("__lo"), F.max("p").alias("__hi")).withColumnsRenamed({n: f"{n}e" for n in names})
        same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}e")) for n in names], F.lit(True))
        knots = knots.join(ends, same) if names else knots.crossJoin(F.broadcast(ends))  # one row without groups
        knots = knots.select(*[F.col(n) for n in seen.columns], "__k", (F.col("p") == F.col("__lo")).alias("head"), (F.col("p") == F.col("__hi")).alias("tail"))
        halo = values.blocks_with_halo(knots, "__k", HALO, HALO, rows=block_rows)
        schema = ", ".join(
            [f"{n} {seen.schema[n].dataType.simpleString()}" for n in names]
            + ["p long", "v double", "m double", "np_ double", "nv double", "nm double", "is_first boolean", "is_last boolean"]
        )
        cols = [*names, "p", "v", "m", "np_", "nv", "nm", "is_first", "is_last"]
        solved = halo.groupBy("block").applyInPandas(lambda pdf: _curvature(pdf)[cols], schema)
        solved = materialise(solved).toDF(*[f"__s_{n}" for n in cols])
        near = _neighbours(out, ["__pos"] if not group else order, [c], group)
        prev, nxt = F.col(f"__prev_{c}"), F.col(f"__next_{c}")
        near = near.withColumn("__at", F.coalesce(prev["p"], nxt["p"]))
        j = near.join(solved, F.col("__at") == F.col("__s_p"), "left")
        x = F.col("__pos").cast("double")
        p0, p1, v0, v1, m0, m1 = (F.col(f"__s_{n}") for n in ("p", "np_", "v", "nv", "m", "nm"))
        h, a, b = p1 - p0, p1 - x, x - p0
        cubic = (m0 * a * a * a + m1 * b * b * b) / (6 * h) + (v0 / h - m0 * h / 6) * a + (v1 / h - m1 * h / 6) * b
        inside = prev.isNotNull() & nxt.isNotNull()
        line = v0 + (v1 - v0) * b / h
        curve = F.coalesce(F.when(~F.isnan(m0), cubic), F.when(inside, line))
        fill = curve if extrapolate else F.when(inside, curve)
        out = j.withColumn(c, F.coalesce(number(c), fill)).select(*[col(n) for n in df.columns], "__pos")
    return out.drop("__pos")


# ---- by group ----


def impute_group(df: DataFrame, group: str, strategy: str = "median", columns: Sequence[str] | None = None) -> DataFrame:
    """Group statistic (text: group mode), then the global mean or mode.

    Statistics are aggregated per group and joined back; a group of any size is
    combined map-side, and medians and modes rank pre-counted values.
    """
    df = nan_to_null(df)
    num = set(numeric_columns(df))
    holes = [c for c in (columns or clean.columns_with_nulls(df)) if c != group]
    nums, texts = [c for c in holes if c in num], [c for c in holes if c not in num]
    g = col(group).alias("__g")
    stats: DataFrame | None = None
    how = strategy if strategy in ("mean", "median", "min", "max") else "mean"
    if nums and how != "median":
        f = {"mean": F.avg, "min": F.min, "max": F.max}[how]
        stats = df.filter(col(group).isNotNull()).groupBy(g).agg(*[f(number(c)).alias(f"__s_{c}") for c in nums])
    elif nums:
        stats = group_medians(df, group, nums).withColumnRenamed(group, "__g")
        stats = stats.select("__g", *[col(c).alias(f"__s_{c}") for c in nums])
    if texts:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in texts])
        n = (
            df.filter(col(group).isNotNull())
            .select(g, F.inline(cells))
            .filter("v is not null")
            .groupBy("__g", "column", "v")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        top = n.groupBy("__g").agg(
            *[F.min(F.when(F.col("column") == c, F.struct(-F.col("n"), "v")))["v"].alias(f"__s_{c}") for c in texts]
        )
        stats = top if stats is None else stats.join(top, "__g", "full")
    if stats is None:
        return df
    whole: dict[str, object] = dict(one_row(df, {c: F.avg(number(c)) for c in nums})) if nums else {}
    whole.update(clean.modes(df, texts))
    joined = df.join(stats, col(group) == F.col("__g"), "left")
    out = []
    for f in df.schema.fields:
        c = f.name
        if c in nums:
            out.append(F.coalesce(number(c), F.col(f"__s_{c}").cast("double"), F.lit(whole[c]).cast("double")).alias(c))
        elif c in texts:
            out.append(F.coalesce(col(c), F.col(f"__s_{c}").cast(f.dataType), F.lit(whole[c]).cast(f.dataType)).alias(c))
        else:
            out.append(col(c))
    return joined.select(*out)


def group_medians(df: DataFrame, group: str, columns: Sequence[str], small_rows: int = values.EXACT_ROWS) -> DataFrame:
    """(group, one median per column); exact for groups of any size."""
    df = nan_to_null(df).filter(col(group).isNotNull())
    if df.count() <= small_rows:
        return df.groupBy(col(group)).agg(*[F.median(number(c)).alias(c) for c in columns])
    rows = df.select(col(group).alias("__g"), *[number(c).alias(c) for c in columns])
    runs = values.value_runs(values.long_values(rows, {c: number(c) for c in columns}, ["__g"]), ["__g", "column"])
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    inside = lambda k: (F.col("below") <= k) & (F.col("below") + F.col("n") > k)
    mids = runs.groupBy("__g", "column").agg(
        ((F.max(F.when(inside(lo), F.col("value"))) + F.max(F.when(inside(hi), F.col("value")))) / 2).alias("m")
    )
    return mids.groupBy(F.col("__g").alias(group)).agg(
        *[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in columns]
    )


# ---- by chance, from text, audit ----


def impute_random(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int = 42) -> DataFrame:
    """Fill each gap with an observed value drawn by a hash of the row key.

    Observed cells are numbered by exact position and gaps join on a number, so
    every observed value is equally likely and nothing is collected.
    """
    df = nan_to_null(df)
    out = df
    keys = [col(k) for k in key]
    for c in columns:
        seen = values.with_position(out.filter(col(c).isNotNull()).select(*keys, col(c).alias("__v")), key, "__i")
        n = seen.count()
        if n == 0:
            continue
        h = F.pmod(F.xxhash64(F.lit(seed), F.lit(c), *keys), F.lit(n))
        gaps = out.filter(col(c).isNull()).withColumn("__i", h)
        filled = gaps.join(seen.select("__i", "__v"), "__i").withColumn(c, F.col("__v")).drop("__i", "__v")
        out = out.filter(col(c).isNotNull()).unionByName(filled.select(*[col(x) for x in out.columns]))
    return out


def extract_from_text(df: DataFrame, column: str, text: str, pattern: str | None, summary_chars: int = 300) -> DataFrame:
    """Fill a null cell from a pattern found in the row's text, else a short summary."""
    t = col(text)
    found = F.regexp_extract(t, pattern, 1) if pattern else F.lit("")
    summary = F.when(F.length(t) > summary_chars, F.substring(t, 1, summary_chars)).otherwise(t)
    filled = F.when(found != "", found).otherwise(summary)
    return df.withColumn(column, F.coalesce(col(column), filled))


def imputation_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, n_before, n_after, n_filled, pct_filled), one pass per side."""
    before, after = nan_to_null(before), nan_to_null(after)
    names = [c for c in before.columns if c in after.columns]
    b = report(before, {c: {"n_before": count_if(col(c).isNull()), "n": F.count(F.lit(1))} for c in names})
    a = report(after, {c: {"n_after": count_if(col(c).isNull())} for c in names})
    out = b.join(F.broadcast(a), "column").filter("n_before > 0")  # one row per column
    filled = F.col("n_before") - F.col("n_after")
    return out.select("column", "n_before", "n_after", filled.alias("n_filled"), (filled * 100.0 / F.col("n")).alias("pct_filled"))


def choose_imputer(df: DataFrame, prefer_speed: bool = False) -> str:
    """Method name by time column, mechanism and rate, whatever the size."""
    df = nan_to_null(df)
    if any("date" in c.lower() or "time" in c.lower() or c.lower() == "ts" for c in df.columns):
        return "timeseries"
    mech = missing_mechanism(df).first()["mechanism"]
    if mech == "NONE":
        return "mean"
    rate = analyze_missing(df).first()["missing_rate"]
    if prefer_speed:
        return "median" if rate < 0.05 else "knn"
    if mech == "MCAR":
        return "median" if rate < 0.05 else "knn" if rate < 0.20 else "missforest"
    return "mice"


def long_missing(df: DataFrame) -> DataFrame:
    """Missing profile: the overall row and the per-column rows together."""
    a = analyze_missing(df).select(F.lit("").alias("column"), "n_missing", (F.col("missing_rate") * 100).alias("pct_missing"))
    return union_all([a, missing_by_column(df).select("column", "n_missing", "pct_missing")])
