"""Descriptive statistics, normality, correlation and group tests.

All O(n) work is Spark; rank statistics read exact rank ranges of distinct
values (``values.value_runs``), so ties are handled without expanding them and
no column is ever sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special, values
from ..functions.columns import (
    col,
    corr,
    frame,
    nan_to_null,
    number,
    numeric_columns,
    one_row,
    report,
    union_all,
)
from ..functions.scratch import materialise
from ..functions.ship import ship
from . import clean, impute, outliers, relate

PERCENTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]
ALPHA = 0.05
RANKS_SENT = 200_000  # ranks of a column that a broadcast may hold, about 5 MB


def _numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns or numeric_columns(df))


# ---- description ----


def describe_extended(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    df = nan_to_null(df)
    names = _numeric(df, columns)
    fns = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max}
    got = one_row(df, {f"{k}|{c}": f(number(c)) for c in names for k, f in fns.items()})
    q = values.quantiles(df, {c: number(c) for c in names}, [0.25, 0.5, 0.75])
    mode = clean.modes(df, names)
    rows = []
    for c in names:
        v = {k: got[f"{k}|{c}"] for k in fns}
        if not v["n"]:
            continue
        std = v["std"]
        rows.append(
            (
                c,
                v["n"],
                v["mean"],
                q[c][1],
                float(mode[c]),
                std,
                v["var"],
                None if std is None else std / math.sqrt(v["n"]),
                None if std is None or not v["mean"] else 100 * std / v["mean"],
                v["min"],
                v["max"],
                v["max"] - v["min"],
                q[c][2] - q[c][0],
            )
        )
    names_ = "n long, mean double, median double, mode double, std double, var double, sem double, cv_pct double, min double, max double, range double, iqr double"
    return frame(df.sparkSession, rows, "column string, " + names_)


def percentiles(df: DataFrame, columns: Sequence[str] | None = None, percents: Sequence[float] = PERCENTS) -> DataFrame:
    df = nan_to_null(df)
    q = values.quantiles(df, {c: number(c) for c in _numeric(df, columns)}, [p / 100 for p in percents])
    rows = [(c, float(p), v) for c, vs in q.items() for p, v in zip(percents, vs)]
    return frame(df.sparkSession, rows, "column string, percent double, value double")


def runs_of(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, n, below, total) for the given numeric columns."""
    df = nan_to_null(df)
    names = _numeric(df, columns)
    return values.value_runs(values.long_values(df, {c: number(c) for c in names}), ["column"])


def trimmed_means(df: DataFrame, columns: Sequence[str] | None = None, trim: float = 0.1, winsor: float = 0.05) -> DataFrame:
    """(column, trimmed_mean, winsorised_mean) by exact rank, ties included."""
    runs = runs_of(df, columns)
    n, below, total, v = (F.col(x) for x in ("n", "below", "total", "value"))
    k, w = F.floor(total * trim), F.floor(total * winsor)
    kept = F.greatest(F.least(below + n, total - k) - F.greatest(below, k), F.lit(0))
    at = lambda r: (below <= r) & (below + n > r)
    ends = runs.groupBy("column").agg(
        F.max(F.when(at(w), v)).alias("lo"), F.max(F.when(at(total - w - 1), v)).alias("hi")
    )
    return (
        runs.join(F.broadcast(ends), "column")  # one row per column
        .groupBy("column")
        .agg(
            (F.sum(v * kept) / F.sum(kept)).alias("trimmed_mean"),
            (F.sum(F.least(F.greatest(v, F.col("lo")), F.col("hi")) * n) / F.sum(n)).alias("winsorised_mean"),
        )
    )


def mad(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    got = outliers.medians_and_mads(df, _numeric(df, columns))
    rows = [(c, m, d) for c, (m, d) in got.items()]
    return frame(df.sparkSession, rows, "column string, median double, mad double")


def mean_interval(df: DataFrame, columns: Sequence[str] | None = None, confidence: float = 0.95) -> DataFrame:
    df = nan_to_null(df)
    names = _numeric(df, columns)
    got = one_row(df, {f"{k}|{c}": f(number(c)) for c in names for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))})
    rows = []
    for c in names:
        n, m, s = (got[f"{k}|{c}"] for k in "nms")
        if n > 1:
            half = special.t_isf((1 - confidence) / 2, n - 1) * s / math.sqrt(n)
            rows.append((c, m, m - half, m + half))
    return frame(df.sparkSession, rows, "column string, mean double, low double, high double")


def gini(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Gini coefficient of columns without negative values."""
    n, below, v = F.col("n"), F.col("below"), F.col("value")
    rank_sum = n * below + n * (n + 1) / 2  # ranks of a run of equal values
    per = runs_of(df, columns).groupBy("column").agg(
        F.min(v).alias("lo"), F.sum(v * n).alias("s"), F.sum(v * rank_sum).alias("rs"), F.max("total").alias("N")
    )
    g = 2 * F.col("rs") / (F.col("N") * F.nullif(F.col("s"), F.lit(0.0))) - (F.col("N") + 1) / F.col("N")
    return per.filter("lo >= 0").select("column", g.alias("gini"))


def shape_classes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Uncorrected skewness and excess kurtosis with their class names."""
    df = nan_to_null(df)
    out = report(df, {c: {"skewness": F.skewness(number(c)), "kurtosis": F.kurtosis(number(c))} for c in _numeric(df, columns)})
    s, k = F.col("skewness"), F.col("kurtosis")
    return out.select(
        "column",
        "skewness",
        "kurtosis",
        F.when(s > 1, "highly_right")
        .when(s > 0.5, "moderately_right")
        .when(s < -1, "highly_left")
        .when(s < -0.5, "moderately_left")
        .otherwise("symmetric")
        .alias("skew_class"),
        F.when(k > 1, "leptokurtic").when(k < -1, "platykurtic").otherwise("mesokurtic").alias("kurtosis_class"),
    )


def skew_kurtosis_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Significance, bimodality coefficient, heavy tails and transform advice."""
    df = nan_to_null(df)
    names = _numeric(df, columns)
    first = one_row(df, {f"{k}|{c}": f(number(c)) for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))})
    live = [c for c in names if first[f"s|{c}"]]
    tails = {
        c: F.avg((F.abs(number(c) - first[f"m|{c}"]) > 3 * first[f"s|{c}"]).cast("double")) for c in live
    }
    out = report(
        df,
        {
            c: {
                "n": F.count(number(c)),
                "skewness": F.skewness(number(c)),
                "kurtosis": F.kurtosis(number(c)),
                "low": F.min(number(c)),
                "heavy_tail_ratio": tails[c],
            }
            for c in live
        },
    ).filter("n > 3")
    n, s, k = F.col("n"), F.col("skewness"), F.col("kurtosis")
    bc = (s * s + 1) / (k + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))
    advice = (
        F.when(F.abs(s) < 0.5, "none")
        .when((s > 0) & (F.col("low") > 0), F.when(s > 1, "log_or_box_cox").otherwise("sqrt"))
        .when(s > 0, "yeo_johnson")
        .otherwise("square_or_reflect")
    )
    return out.select(
        "column",
        "n",
        "skewness",
        "kurtosis",
        (s / F.sqrt(6 / n)).alias("skew_z"),
        (k / F.sqrt(24 / n)).alias("kurtosis_z"),
        bc.alias("bimodality"),
        (bc > 0.555).alias("maybe_bimodal"),
        "heavy_tail_ratio",
        ((F.abs(s) > 0.5) | (F.abs(k) > 2)).alias("needs_transform"),
        advice.alias("advice"),
    )


# ---- normality ----


def jarque_bera(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    df = nan_to_null(df)
    out = report(
        df,
        {c: {"n": F.count(number(c)), "s": F.skewness(number(c)), "k": F.kurtosis(number(c))} for c in _numeric(df, columns)},
    )
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    return out.select("column", jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))


def k_squared(n: int, g1: float, g2: float) -> tuple[float, float]:
    """D'Agostino's omnibus statistic from uncorrected moments."""
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (beta2 - 1))
    delta = 1 / math.sqrt(0.5 * math.log(w2))
    alpha = math.sqrt(2.0 / (w2 - 1))
    z1 = delta * math.asinh(y / alpha)
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / math.sqrt(var)
    sb = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + math.sqrt(1 + 4 / (sb * sb)))
    root = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - math.copysign(abs(root) ** (1 / 3), root)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return k2, math.exp(-k2 / 2)


def dagostino(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    df = nan_to_null(df)
    names = _numeric(df, columns)
    got = one_row(df, {f"{k}|{c}": f(number(c)) for c in names for k, f in (("n", F.count), ("s", F.skewness), ("k", F.kurtosis))})
    rows = []
    for c in names:
        if got[f"n|{c}"] >= 20 and got[f"s|{c}"] is not None and not math.isnan(got[f"s|{c}"]):
            rows.append((c, *k_squared(got[f"n|{c}"], got[f"s|{c}"], got[f"k|{c}"])))
    return frame(df.sparkSession, rows, "column string, statistic double, p_value double")


TAILS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("cdf", "log_cdf", "log_sf")])


@F.pandas_udf(TAILS)
def normal_tails(z: pd.Series) -> pd.DataFrame:
    """Φ(z), ln Φ(z) and ln(1 − Φ(z)), stable far into both tails."""
    x = z.to_numpy(float)
    def log_tail(t):
        p = 0.5 * special.erfc(np.minimum(t, 35.0) / math.sqrt(2))
        far = -0.5 * t * t - np.log(np.maximum(t, 1.0) * math.sqrt(2 * math.pi))
        return np.where(t > 35, far, np.log(p))

    return pd.DataFrame({"cdf": 0.5 * special.erfc(-x / math.sqrt(2)), "log_cdf": log_tail(-x), "log_sf": log_tail(x)})


def edf_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the distances between data and fitted normal: Kolmogorov
    (population and sample std) and Anderson–Darling, from rank runs."""
    df = nan_to_null(df)
    names = _numeric(df, columns)
    got = one_row(df, {f"{k}|{c}": f(number(c)) for c in names for k, f in (("m", F.avg), ("s", F.stddev_samp), ("p", F.stddev_pop))})
    live = [c for c in names if got[f"s|{c}"]]
    facts = frame(df.sparkSession, [(c, got[f"m|{c}"], got[f"s|{c}"], got[f"p|{c}"]) for c in live], "column string, m double, s double, p double")
    ship(df.sparkSession)
    r = runs_of(df, live).join(F.broadcast(facts), "column")  # one row per column
    r = r.withColumn("t", normal_tails((F.col("value") - F.col("m")) / F.col("s")))
    r = r.withColumn("c", normal_tails((F.col("value") - F.col("m")) / F.col("p"))["cdf"])
    n, below, total = F.col("n"), F.col("below"), F.col("total")
    gap = lambda c: F.greatest((below + n) / total - c, c - below / total)
    up = (below + n) * (below + n) - below * below
    down = (total - below) * (total - below) - (total - below - n) * (total - below - n)
    return r.groupBy("column").agg(
        F.max("total").alias("n"),
        F.max(gap(F.col("c"))).alias("ks"),
        F.max(gap(F.col("t.cdf"))).alias("lilliefors"),
        (-F.max("total") - F.sum(up * F.col("t.log_cdf") + down * F.col("t.log_sf")) / F.max("total")).alias("anderson"),
    )


def lilliefors_p(d: float, n: int) -> float:
    """Dallal–Wilkinson approximation."""
    if n > 100:
        d, n = d * (n / 100) ** 0.49, 100
    m = n + 2.78019
    return min(1.0, math.exp(-7.01256 * d * d * m + 2.99587 * d * math.sqrt(m) - 0.122119 + 0.974598 / math.sqrt(n) + 1.67997 / n))


def anderson_critical(n: int) -> float:
    return round(0.787 / (1 + 4 / n - 25 / (n * n)), 3)


def _shapiro(x: np.ndarray) -> tuple[float, float]:
    """Royston's W for a sorted sample of 3 to 5000 values."""
    n = len(x)
    m = np.array([special.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss = float(m @ m)
    u = 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[-1] = math.sqrt(0.5)
    else:
        a[-1] = m[-1] / math.sqrt(ss) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0], u)
        if n > 5:
            a[-2] = m[-2] / math.sqrt(ss) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1] = -a[-2]
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[0] = -a[-1]
    w = float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y, ln = math.log(max(1 - w, 1e-19)), math.log(n)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if y >= gamma:
            return w, 0.0
        y = -math.log(gamma - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return w, special.norm_sf((y - mu) / sd)


def shapiro(df: DataFrame, columns: Sequence[str] | None = None, most: int = 5000) -> DataFrame:
    """(column, statistic, p_value) of every column; null outside 3 to ``most`` values, the test's own range.

    A group never holds more than ``most`` values.
    """
    df = nan_to_null(df)
    names = _numeric(df, columns)
    got = one_row(df, {f"{k}|{c}": f(number(c)) for c in names for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))})
    ok = [c for c in names if 3 <= got[f"n|{c}"] <= most and got[f"lo|{c}"] < got[f"hi|{c}"]]
    schema = "column string, statistic double, p_value double"
    rest = frame(df.sparkSession, [(c, None, None) for c in names if c not in ok], schema)
    if not ok:
        return rest

    ship(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = _shapiro(np.sort(pdf["value"].to_numpy(float)))
        return pd.DataFrame({"column": [pdf["column"].iloc[0]], "statistic": [w], "p_value": [p]})

    return values.long_values(df, {c: number(c) for c in ok}).groupBy("column").applyInPandas(run, schema).unionByName(rest)


def normality_report(df: DataFrame, columns: Sequence[str] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(column, n, tests, passed, is_normal, confidence) by majority of the tests.

    The same tests vote at every size; Shapiro–Wilk, which ends at 5,000 values, is no voter.
    """
    df = nan_to_null(df)
    votes: dict[str, list[bool]] = {}

    def take(part: DataFrame) -> None:
        for r in part.collect():  # one row per column
            votes.setdefault(r["column"], []).append(r["p_value"] > alpha)

    take(dagostino(df, columns))
    take(jarque_bera(df, columns).filter("statistic is not null"))
    sizes = {}
    for r in edf_statistics(df, columns).collect():  # one row per column
        n = sizes[r["column"]] = r["n"]
        v = votes.setdefault(r["column"], [])
        v.append(r["anderson"] < anderson_critical(n))
        v.append(special.kolmogorov_sf(r["ks"], n) > alpha)
        v.append(lilliefors_p(r["lilliefors"], n) > alpha)
    rows = []
    for c, v in votes.items():
        if c not in sizes or sizes[c] < 8:
            continue
        share = sum(v) / len(v)
        rows.append((c, sizes[c], len(v), sum(v), share >= 0.5, "high" if share >= 0.8 else "medium" if share >= 0.5 else "low"))
    return frame(df.sparkSession, rows, "column string, n long, tests int, passed int, is_normal boolean, confidence string")


# ---- correlation ----


def effect(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a < 0.10, "negligible").when(a < 0.30, "small").when(a < 0.50, "medium").otherwise("large")


def r_p_value(r: float, n: int) -> float:
    if r is None or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return special.t_sf2(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def with_p(pairs: DataFrame) -> DataFrame:
    """Add the two-sided p-value of a correlation table (one row per pair)."""
    rows = [(r["col_a"], r["col_b"], r["r"], r["n"], r_p_value(r["r"], r["n"])) for r in pairs.collect()]
    out = frame(pairs.sparkSession, rows, "col_a string, col_b string, r double, n long, p_value double")
    return out.withColumn("effect", effect(F.col("r")))


def pearson(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return with_p(relate.pearson_pairs(df, columns).filter("n >= 5"))


def ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Average ranks in place of values.

    The distinct values of all columns are ranked in one range exchange. A column's
    ranks are sent to the tasks when counted below RANKS_SENT; more are joined by a shuffle.
    """
    out = df.select(*[number(c).alias(c) for c in columns])
    runs = values.value_runs(values.long_values(out, {c: col(c) for c in columns}), ["column"])
    runs = materialise(runs.select("column", F.col("value").alias("__v"), (F.col("below") + (F.col("n") + 1) / 2).alias("__r")))
    sizes = {r["column"]: r["count"] for r in runs.groupBy("column").count().collect()}  # one row per column
    for c in columns:
        rank = runs.where(F.col("column") == c).select("__v", "__r")
        rank = F.broadcast(rank) if sizes.get(c, 0) <= RANKS_SENT else rank
        out = out.join(rank, col(c) == F.col("__v")).withColumn(c, F.col("__r")).drop("__v", "__r")
    return out


def spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of average ranks over pairwise complete rows."""
    df = nan_to_null(df)
    names = _numeric(df, columns)
    holes = clean.columns_with_nulls(df.select(*[col(c) for c in names]))
    full = [c for c in names if c not in holes]
    parts = []
    if len(full) > 1:
        parts.append(relate.pearson_pairs(ranked(df, full), full))
    for a, b in combinations(names, 2):
        if a in holes or b in holes:
            both = df.select(col(a), col(b)).na.drop("any")
            parts.append(relate.pearson_pairs(ranked(both, [a, b]), [a, b]))
    return with_p(union_all(parts).filter("n >= 5"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exact τ-b of one pair, with its asymptotic p-value.

    Equal pairs are counted once and written; all else reads the counts. In (a, b) order
    the discordant pairs are the inversions of b's ranks, where b is the column with fewer
    values; two ranks first differ at one bit, so each bit level counts ones standing before zeros under the same higher bits. Every
    level is cut into blocks of positions with carried totals, so no prefix has
    to fit into one task.
    """
    df = nan_to_null(df)
    both = df.select(number(a).alias("x"), number(b).alias("y")).filter("x is not null and y is not null")
    cells = materialise(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    runs = {c: materialise(cells.groupBy(c).agg(F.sum("w").alias("t"))) for c in ("x", "y")}
    few, other = sorted(runs, key=lambda c: runs[c].count())
    code = values.with_position(runs[few].select(few), [few], "code")
    placed = values.with_position(cells.join(code, few), [other, few], "pos")
    tied = lambda c: runs[c].agg(
        F.sum(F.col("t").cast("double") * (F.col("t") - 1)).alias("p"),
        F.sum(F.col("t").cast("double") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("v"),
        F.sum(F.col("t").cast("double") * (F.col("t") - 1) * (F.col("t") - 2)).alias("q"),
        F.sum("t").alias("n"),
        F.count(F.lit(1)).alias("values"),
    ).first()
    tx, ty = tied("x"), tied("y")
    txy = cells.agg(F.sum(F.col("w").cast("double") * (F.col("w") - 1))).first()[0] or 0.0
    n = tx["n"] or 0
    schema = "col_a string, col_b string, tau double, n long, p_value double"
    if n < 2:
        return df.sparkSession.createDataFrame([], schema)
    bits = max(1, int(min(tx["values"], ty["values"]) - 1).bit_length())
    levels = F.sequence(F.lit(0), F.lit(bits - 1))
    long = placed.select("pos", "w", "code", F.explode(levels).alias("b"))
    long = long.select(
        "pos",
        "w",
        "b",
        F.expr("shiftright(code, b + 1)").alias("prefix"),
        F.expr("shiftright(code, b) & 1").alias("bit"),
        F.floor(F.col("pos") / 100_000).alias("blk"),
    )
    key = ["b", "prefix"]
    one = F.when(F.col("bit") == 1, F.col("w")).otherwise(0)
    zero = F.when(F.col("bit") == 0, F.col("w")).otherwise(0)
    w = Window.partitionBy(*key, "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = long.select(*key, "blk", zero.alias("z"), one.alias("o"), F.sum(one).over(w).alias("seen"))
    per = within.groupBy(*key, "blk").agg(
        F.sum(F.col("z").cast("double") * F.col("seen")).alias("inside"), F.sum("z").alias("z"), F.sum("o").alias("o")
    )
    before = Window.partitionBy(*key).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    crossing = F.coalesce(F.sum("o").over(before), F.lit(0)).cast("double") * F.col("z")
    disc = per.select((F.col("inside") + crossing).alias("d")).agg(F.sum("d")).first()[0] or 0.0
    n0 = n * (n - 1) / 2
    n1, n2, n3 = tx["p"] / 2, ty["p"] / 2, txy / 2
    s = n0 - n1 - n2 + n3 - 2 * disc
    down = math.sqrt((n0 - n1) * (n0 - n2))
    tau = s / down if down else float("nan")
    var = (n * (n - 1.0) * (2 * n + 5) - tx["v"] - ty["v"]) / 18 + 2 * n1 * n2 / (n * (n - 1.0))
    if n > 2:
        var += tx["q"] * ty["q"] / (9.0 * n * (n - 1) * (n - 2))
    p = 2 * special.norm_sf(abs(s) / math.sqrt(var)) if var > 0 else float("nan")
    return frame(df.sparkSession, [(a, b, tau, n, p)], schema)


def kendall_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return union_all([kendall(df, a, b) for a, b in combinations(_numeric(df, columns), 2)])


def adjust_p(tests: DataFrame, p: str = "p_value", method: str = "fdr_bh", alpha: float = ALPHA) -> DataFrame:
    """Bonferroni or Benjamini–Hochberg over a small table of tests."""
    everything = Window.partitionBy(F.lit(1))
    m = F.count(F.lit(1)).over(everything)
    x = F.coalesce(F.col(p), F.lit(1.0))
    if method == "bonferroni":
        out = tests.withColumn("p_adjusted", F.least(x * m, F.lit(1.0)))
    elif method == "fdr_bh":
        rank = F.row_number().over(everything.orderBy(x))
        step = tests.withColumn("__m", m).withColumn("__k", rank).withColumn("__q", x * F.col("__m") / F.col("__k"))
        tail = Window.partitionBy(F.lit(1)).orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
        out = step.withColumn("p_adjusted", F.least(F.min("__q").over(tail), F.lit(1.0))).drop("__m", "__k", "__q")
    else:
        raise ValueError(f"unknown correction: {method}")
    return out.withColumn("significant", F.col("p_adjusted") <= alpha)


def point_biserial(df: DataFrame, binary: str, numeric: str) -> DataFrame:
    """Pearson r of a number with a 0/1 column, and its p-value."""
    df = nan_to_null(df)
    top = df.agg(F.max(col(binary).cast("string"))).first()[0]
    flag = F.when(col(binary).isNotNull(), (col(binary).cast("string") == top).cast("double"))
    got = one_row(df, {"r": corr(flag, number(numeric)), "n": F.count(flag + number(numeric))})
    return frame(df.sparkSession, [(binary, numeric, got["r"], got["n"], r_p_value(got["r"], got["n"]))], "binary string, numeric string, r double, n long, p_value double")


def partial_correlation(df: DataFrame, a: str, b: str, control: str) -> DataFrame:
    """r of a and b given one control, in closed form from three correlations."""
    full = nan_to_null(df).select(col(a), col(b), col(control)).na.drop("any")
    x, y, z = number(a), number(b), number(control)
    got = one_row(full, {"xy": corr(x, y), "xz": corr(x, z), "yz": corr(y, z), "n": F.count(F.lit(1))})
    n, down = got["n"], math.sqrt((1 - got["xz"] ** 2) * (1 - got["yz"] ** 2))
    r = (got["xy"] - got["xz"] * got["yz"]) / down if down else float("nan")
    p = special.t_sf2(r * math.sqrt((n - 3) / (1 - r * r)), n - 3) if n > 3 and abs(r) < 1 else 0.0
    return frame(df.sparkSession, [(a, b, control, r, n, p)], "col_a string, col_b string, control string, r double, n long, p_value double")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Pairs after filling gaps with the median: (col_a, col_b, r, n, p_value, effect)."""
    df = nan_to_null(df)
    names = _numeric(df, columns)
    df = df.select(*[col(c) for c in names])
    holes = list(clean.columns_with_nulls(df))
    filled = clean.fill(df, clean.fill_values(df, "median", holes)) if holes else df
    return pearson(filled, names) if method == "pearson" else spearman(filled, names)


# ---- tables of counts ----


def chi_squared(df: DataFrame, a: str, b: str) -> DataFrame:
    """χ² with Yates for 2×2, or Fisher when a 2×2 expectation is below five."""
    df = nan_to_null(df).select(col(a).cast("string").alias(a), col(b).cast("string").alias(b))
    cells = relate.contingency(df, [a, b])
    x = relate.chi_square(cells).first()  # one pair
    schema = "test string, statistic double, dof long, p_value double, cramers_v double, n long"
    n, ka, kb = x["n"], x["n_a"], x["n_b"]
    if ka == 2 and kb == 2:
        got = {(r["a"], r["b"]): r["n"] for r in cells.collect()}  # four cells
        ra, rb = sorted({k[0] for k in got}), sorted({k[1] for k in got})
        t = [[got.get((i, j), 0) for j in rb] for i in ra]
        rows, cols = [sum(r) for r in t], [t[0][j] + t[1][j] for j in range(2)]
        exp = [[rows[i] * cols[j] / n for j in range(2)] for i in range(2)]
        if min(min(e) for e in exp) < 5:
            odds, p = fisher(t)
            return frame(df.sparkSession, [("fisher_exact", odds, None, p, None, n)], schema)
        chi2 = 0.0
        for i in range(2):
            for j in range(2):
                d = abs(t[i][j] - exp[i][j])
                chi2 += (d - min(0.5, d)) ** 2 / exp[i][j]
    else:
        chi2 = x["chi2"]
    dof = (ka - 1) * (kb - 1)
    v = math.sqrt(max(chi2, 0) / (n * (min(ka, kb) - 1))) if min(ka, kb) > 1 else 0.0
    return frame(df.sparkSession, [("chi_squared", chi2, dof, special.chi2_sf(chi2, dof) if dof else 1.0, v, n)], schema)


def fisher(t: Sequence[Sequence[int]]) -> tuple[float, float]:
    """Odds ratio and two-sided exact p of a 2×2 table."""
    (a, b), (c, d) = t
    r1, r2, c1 = a + b, c + d, a + c
    lg = math.lgamma
    const = lg(r1 + 1) + lg(r2 + 1) + lg(c1 + 1) + lg(r1 + r2 - c1 + 1) - lg(r1 + r2 + 1)

    def logp(k: int) -> float:
        return const - lg(k + 1) - lg(r1 - k + 1) - lg(c1 - k + 1) - lg(r2 - c1 + k + 1)

    seen = logp(a)
    lo, hi = max(0, c1 - r2), min(r1, c1)
    p = sum(math.exp(logp(k)) for k in range(lo, hi + 1) if logp(k) <= seen + 1e-7)
    odds = a * d / (b * c) if b * c else float("inf")
    return odds, min(1.0, p)


# ---- groups ----


def _groups(df: DataFrame, numeric: str, group: str) -> DataFrame:
    x = number(numeric)
    return (
        df.filter(col(group).isNotNull() & x.isNotNull())
        .groupBy(col(group).cast("string").alias("g"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(x).alias("m"),
            F.var_samp(x).alias("v"),
            F.skewness(x).alias("s"),
            F.kurtosis(x).alias("k"),
        )
        .filter("n >= 3")
    )


def anova(groups: DataFrame) -> dict:
    """F, its degrees of freedom and η² from (n, m, v) per group."""
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    t = groups.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum(n * m) / F.sum(n)).alias("gm"), F.sum((n - 1) * v).alias("w")).first()
    between = groups.agg(F.sum(n * (m - F.lit(t["gm"])) * (m - F.lit(t["gm"])))).first()[0]
    d1, d2 = t["k"] - 1, t["N"] - t["k"]
    f = (between / d1) / (t["w"] / d2) if t["w"] else float("inf")
    return {"f": f, "d1": d1, "d2": d2, "p": special.f_sf(f, d1, d2), "eta2": between / (between + t["w"]), "n": t["N"], "k": t["k"]}


def levene(df: DataFrame, numeric: str, group: str) -> dict:
    """Median-centred Levene: ANOVA of distances from the group median."""
    df = nan_to_null(df).select(col(group).cast("string").alias("g"), number(numeric).alias("x")).na.drop("any")
    med = impute.group_medians(df, "g", ["x"]).withColumnRenamed("x", "med")
    z = df.join(med, "g").select("g", F.abs(F.col("x") - F.col("med")).alias("z"))
    per = z.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("m"), F.var_samp("z").alias("v")).filter("n >= 3")
    return anova(per)


def bartlett(groups: DataFrame) -> dict:
    n, v = F.col("n"), F.col("v")
    t = groups.agg(
        F.sum(n - 1).alias("df"),
        F.count(F.lit(1)).alias("k"),
        F.sum((n - 1) * v).alias("s"),
        F.sum((n - 1) * F.ln(v)).alias("l"),
        F.sum(1 / (n - 1)).alias("i"),
    ).first()
    pooled = t["s"] / t["df"]
    top = t["df"] * math.log(pooled) - t["l"]
    stat = top / (1 + (t["i"] - 1 / t["df"]) / (3 * (t["k"] - 1)))
    return {"stat": stat, "p": special.chi2_sf(stat, t["k"] - 1)}


def variance_equality(df: DataFrame, numeric: str, group: str) -> DataFrame:
    df = nan_to_null(df)
    lev, bar = levene(df, numeric, group), bartlett(_groups(df, numeric, group))
    rows = [("levene", lev["f"], lev["p"], lev["p"] > ALPHA), ("bartlett", bar["stat"], bar["p"], bar["p"] > ALPHA)]
    return frame(df.sparkSession, rows, "test string, statistic double, p_value double, equal boolean")


def rank_sums(df: DataFrame, numeric: str, group: str) -> tuple[DataFrame, float, int]:
    """(g, n, rank_sum) per group, Σ(t³ − t) and N; ranks come from pre-counted values."""
    rows = nan_to_null(df).select(col(group).cast("string").alias("g"), number(numeric).alias("value")).na.drop("any")
    big = rows.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k >= 3").select("g")
    counts = rows.join(big, "g", "left_semi").groupBy("g", "value").agg(F.count(F.lit(1)).alias("c"))
    runs = values.value_runs(counts.select(F.lit("x").alias("column"), "value", F.col("c").alias("n")), ["column"])
    rank = runs.select("value", (F.col("below") + (F.col("n") + 1) / 2).alias("r"))
    per = counts.join(rank, "value").groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r")).alias("rank_sum"))
    t = runs.agg(F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("t"), F.max("total").alias("N")).first()
    return per, t["t"] or 0.0, t["N"] or 0


def kruskal(df: DataFrame, numeric: str, group: str) -> dict:
    per, ties, n = rank_sums(df, numeric, group)
    t = per.agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k")).first()
    h = 12 / (n * (n + 1)) * t["s"] - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    return {"h": h, "p": special.chi2_sf(h, t["k"] - 1), "k": t["k"]}


def mann_whitney(df: DataFrame, numeric: str, group: str) -> dict:
    per, ties, n = rank_sums(df, numeric, group)
    a, b = sorted(per.collect(), key=lambda r: r["g"])  # two groups
    u1 = a["rank_sum"] - a["n"] * (a["n"] + 1) / 2
    mean = a["n"] * b["n"] / 2
    sd = math.sqrt(a["n"] * b["n"] / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u1, 2 * mean - u1) - mean - 0.5) / sd
    return {"u": u1, "p": min(1.0, 2 * special.norm_sf(z))}


def compare_groups(df: DataFrame, numeric: str, group: str, alpha: float = ALPHA) -> DataFrame:
    """Pick and run the test for a number across groups.

    Group normality: the moment test for every group of eight values or more.
    """
    df = nan_to_null(df)
    per = _groups(df, numeric, group)
    k = per.count()
    schema = "test string, statistic double, p_value double, significant boolean, effect double, n_groups int, all_normal boolean, equal_variance boolean"
    if k < 2:
        return df.sparkSession.createDataFrame([], schema)
    lev = levene(df, numeric, group)
    equal = lev["p"] > alpha
    normal = _all_normal(per, alpha)
    if k == 2:
        a, b = sorted(per.collect(), key=lambda r: r["g"])
        n1, n2, v1, v2 = a["n"], b["n"], a["v"], b["v"]
        d = abs(a["m"] - b["m"]) / math.sqrt((v1 + v2) / 2)
        if normal and equal:
            pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)
            t = (a["m"] - b["m"]) / math.sqrt(pooled * (1 / n1 + 1 / n2))
            name, stat, p = "t_test", t, special.t_sf2(t, n1 + n2 - 2)
        elif normal:
            e1, e2 = v1 / n1, v2 / n2
            t = (a["m"] - b["m"]) / math.sqrt(e1 + e2)
            dof = (e1 + e2) ** 2 / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1))
            name, stat, p = "welch_t_test", t, special.t_sf2(t, dof)
        else:
            mw = mann_whitney(df, numeric, group)
            name, stat, p = "mann_whitney_u", mw["u"], mw["p"]
        eff = d
    elif normal and equal:
        an = anova(per)
        name, stat, p, eff = "one_way_anova", an["f"], an["p"], an["eta2"]
    else:
        kw = kruskal(df, numeric, group)
        name, stat, p, eff = "kruskal_wallis", kw["h"], kw["p"], None
    return frame(df.sparkSession, [(name, float(stat), p, p < alpha, eff, k, normal, equal)], schema)


def _all_normal(per: DataFrame, alpha: float) -> bool:
    """False as soon as one group of eight or more fails its normality test."""
    n, s, k = F.col("n"), F.col("s"), F.col("k")
    jb = n / 6 * (s * s + k * k / 4)
    return per.filter((n >= 8) & (F.col("v") > 0) & (F.exp(-jb / 2) <= alpha)).isEmpty()


def one_sample_t(df: DataFrame, column: str, popmean: float) -> DataFrame:
    x = number(column)
    got = one_row(nan_to_null(df), {"n": F.count(x), "m": F.avg(x), "s": F.stddev_samp(x)})
    t = (got["m"] - popmean) / (got["s"] / math.sqrt(got["n"]))
    return frame(df.sparkSession, [(column, got["m"], t, special.t_sf2(t, got["n"] - 1))], "column string, mean double, statistic double, p_value double")
