"""Statistical outlier detectors and the voting ensemble."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special, values
from ..functions.columns import col, count_if, frame, nan_to_null, number, numeric_columns, one_row, ratio
from . import profile

TINY = 1e-12
# Dixon's Q at the 5 % level for n = 3 … 10.
DIXON_Q = {3: 0.941, 4: 0.765, 5: 0.642, 6: 0.560, 7: 0.507, 8: 0.468, 9: 0.437, 10: 0.412}


@dataclass
class Detector:
    """A fitted detector: flag and score expressions per column.

    Fitting reads a few numbers from Spark; applying the expressions is a
    plain projection, so any number of detectors share one scan.
    """

    method: str
    flags: dict[str, Column]
    scores: dict[str, Column]


def fit_iqr(
    df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5, fences: dict[str, tuple[float, float, float]] | None = None
) -> Detector:
    """``fences`` are ``profile.fences`` of the same columns, if at hand."""
    flags, scores = {}, {}
    for c, (lo, hi, iqr) in (profile.fences(df, columns, k) if fences is None else fences).items():
        x = number(c)
        flags[c] = F.coalesce((x < lo) | (x > hi), F.lit(False))
        over = (x - hi) / (iqr + TINY)
        under = (lo - x) / (iqr + TINY)
        scores[c] = F.coalesce(F.when(x > hi, over).when(x < lo, under), F.lit(0.0))
    return Detector("iqr", flags, scores)


def fit_zscore(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> Detector:
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    got = one_row(
        df, {f"{m}{c}": f(number(c)) for c in names for m, f in (("m", F.avg), ("s", F.stddev_samp))}
    )
    flags, scores = {}, {}
    for c in names:
        m, s = got[f"m{c}"], got[f"s{c}"]
        if m is None or s is None or s < TINY:
            continue
        scores[c] = F.abs((number(c) - m) / s)
        flags[c] = F.coalesce(scores[c] > threshold, F.lit(False))
    return Detector("zscore", flags, scores)


def medians_and_mads(df: DataFrame, names: Sequence[str], med: dict[str, float | None] | None = None) -> dict[str, tuple[float, float]]:
    df = nan_to_null(df)
    if med is None:
        med = {c: q[0] for c, q in values.quantiles(df, {c: number(c) for c in names}, [0.5]).items()}
    have = [c for c in names if med[c] is not None]
    mad = values.quantiles(df, {c: F.abs(number(c) - F.lit(med[c])) for c in have}, [0.5])
    return {c: (med[c], mad[c][0]) for c in have}


def fit_modified_zscore(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.5, medians: dict[str, float | None] | None = None
) -> Detector:
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    mm = medians_and_mads(df, names, medians)
    flat = [c for c, (_, mad) in mm.items() if mad < TINY]
    mean = one_row(df, {c: F.avg(number(c)) for c in flat}) if flat else {}
    flags, scores = {}, {}
    for c, (med, mad) in mm.items():
        scale = mad if mad >= TINY else mean[c] * 0.6745 + TINY
        scores[c] = F.abs((number(c) - med) * 0.6745 / scale)
        flags[c] = F.coalesce(scores[c] > threshold, F.lit(False))
    return Detector("modified_zscore", flags, scores)


def apply(df: DataFrame, det: Detector) -> DataFrame:
    """Add ``<column>__<method>`` flags and ``<column>__<method>_score`` columns."""
    out = nan_to_null(df)
    added = {f"{c}__{det.method}": f for c, f in det.flags.items()}
    added.update({f"{c}__{det.method}_score": s for c, s in det.scores.items()})
    return out.withColumns(added)


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    return apply(df, fit_iqr(df, columns, k))


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    return apply(df, fit_zscore(df, columns, threshold))


def modified_zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.5) -> DataFrame:
    return apply(df, fit_modified_zscore(df, columns, threshold))


# ---- sequential tests: only the extreme few of each tail can be removed ----


def _tails(df: DataFrame, column: str, key: Sequence[str], k: int) -> list[tuple[float, tuple]]:
    """The k smallest and k largest cells with their row keys (2k rows at most)."""
    x = number(column)
    rows = df.select(x.alias("x"), *[col(c) for c in key]).filter("x is not null")
    low = rows.orderBy("x", *[col(c) for c in key]).limit(k).collect()
    high = rows.orderBy(F.desc("x"), *[col(c) for c in key]).limit(k).collect()
    # a short table may list a row in both tails; keys tell them apart
    cells = {tuple(r)[1:]: r["x"] for r in low + high}
    return sorted((x, key_) for key_, x in cells.items())


def _remove_in_turn(n: int, mean: float, m2: float, cells: list, k: int, critical, min_left: int) -> tuple[list, list]:
    """Take away the most deviating value while its test is significant."""
    left = list(cells)
    out, stats = [], []
    for _ in range(k):
        if n < min_left or not left or n < 3:
            break
        std = math.sqrt(max(m2, 0.0) / (n - 1))
        if std == 0:
            break
        worst = max((left[0], left[-1]), key=lambda c: abs(c[0] - mean))
        r = abs(worst[0] - mean) / std
        stats.append((r, critical(n)))
        if r <= critical(n):
            break
        out.append(worst)
        left.remove(worst)
        moved = (n * mean - worst[0]) / (n - 1)
        m2 -= (worst[0] - mean) * (worst[0] - moved)
        n, mean = n - 1, moved
    return out, stats


def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    t = special.t_isf(alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def _moments(df: DataFrame, column: str) -> tuple[int, float, float]:
    x = number(column)
    got = one_row(df, {"n": F.count(x), "m": F.avg(x), "v": F.var_pop(x)})
    return got["n"], got["m"] or 0.0, (got["v"] or 0.0) * got["n"]


def grubbs_outliers(
    df: DataFrame, column: str, key: Sequence[str], alpha: float = 0.05, max_iter: int = 10
) -> DataFrame:
    """Keys and values that repeated Grubbs tests remove, in removal order."""
    df = nan_to_null(df)
    n, mean, m2 = _moments(df, column)
    removed: list = []
    if n >= 6:
        k = min(max_iter, n // 2)
        removed, _ = _remove_in_turn(
            n, mean, m2, _tails(df, column, key, k), k, lambda m: grubbs_critical(m, alpha), 6
        )
    schema = df.select(*[col(c) for c in key]).schema.add("value", "double").add("step", "integer")
    return df.sparkSession.createDataFrame([(*c[1], c[0], i + 1) for i, c in enumerate(removed)], schema)


def flag_rows(df: DataFrame, found: DataFrame, key: Sequence[str], name: str = "is_outlier") -> DataFrame:
    """Mark the rows whose keys a sequential test removed (a few rows at most)."""
    marks = found.select(*[col(c) for c in key]).distinct().withColumn(name, F.lit(True))
    return df.join(F.broadcast(marks), list(key), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def grubbs_test(df: DataFrame, columns: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Single-outlier Grubbs test per column."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    first = one_row(
        df,
        {
            f"{m}{c}": f(number(c))
            for c in names
            for m, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))
        },
    )
    rows = []
    for c in names:
        n, m, s = first[f"n{c}"], first[f"m{c}"], first[f"s{c}"]
        if n < 6 or not s:
            continue
        # the farthest value from the mean is one of the two ends
        worst = max((first[f"lo{c}"], first[f"hi{c}"]), key=lambda v: abs(v - m))
        g, crit = abs(worst - m) / s, grubbs_critical(n, alpha)
        rows.append((c, g, crit, float(worst), g > crit))
    schema = "column string, statistic double, critical double, value double, is_outlier boolean"
    return frame(df.sparkSession, rows, schema)


def gesd_test(df: DataFrame, column: str, key: Sequence[str], alpha: float = 0.05, max_outliers: int = 10) -> DataFrame:
    """Generalised ESD: (step, statistic, critical, removed value or null)."""
    df = nan_to_null(df)
    n, mean, m2 = _moments(df, column)
    rows: list[tuple] = []
    if n >= 25:

        def critical(m: int) -> float:
            t = special.t_isf(alpha / (2 * m), m - 2)
            return (m - 1) * t / math.sqrt((m - 2 + t * t) * m)

        k = min(max_outliers, n // 3)
        removed, stats = _remove_in_turn(n, mean, m2, _tails(df, column, key, k), k, critical, 3)
        for i, (r, c) in enumerate(stats):
            rows.append((i + 1, r, c, float(removed[i][0]) if i < len(removed) else None))
    return frame(df.sparkSession, rows, "step int, statistic double, critical double, removed double")


def dixon(df: DataFrame, column: str, group: Sequence[str], beyond: float = 0.412) -> DataFrame:
    """Dixon's Q at both ends of every group of 3 to 30 values.

    Groups are sized first by a map-side combined count; only the two lowest
    and two highest values of a small group are ever needed, and they come from
    ranks limited to two per end.
    """
    df = nan_to_null(df)
    x = number(column)
    rows = df.select(*[col(g) for g in group], x.alias("x")).filter("x is not null")
    names = list(group)
    size = rows.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    small = size.filter(F.col("n").between(3, 30) & (F.col("hi") > F.col("lo")))
    kept = rows.join(small.select(*names), names, "left_semi")  # at most 30 rows per group
    two = kept.groupBy(*names).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    crit = F.lit(beyond)
    for n, q in DIXON_Q.items():
        crit = F.when(F.col("n") == n, q).otherwise(crit)
    xs, n = F.col("xs"), F.col("n")
    width = F.col("hi") - F.col("lo")
    out = two.join(small, names).select(
        *names,
        "n",
        ((xs[1] - xs[0]) / width).alias("q_low"),
        ((F.element_at(xs, -1) - F.element_at(xs, -2)) / width).alias("q_high"),
        crit.alias("q_critical"),
        F.col("lo").alias("low_value"),
        F.col("hi").alias("high_value"),
    )
    return out.withColumn("low_is_outlier", F.col("q_low") > F.col("q_critical")).withColumn(
        "high_is_outlier", F.col("q_high") > F.col("q_critical")
    )


# ---- combining ----


def scaled(df: DataFrame, scores: Mapping[str, Column]) -> dict[str, Column]:
    """Min-max scale score expressions to [0, 1] with one pass for the limits."""
    filled = {k: F.coalesce(s, F.lit(0.0)) for k, s in scores.items()}
    lim = one_row(df, {f"{e}{k}": f(s) for k, s in filled.items() for e, f in (("lo", F.min), ("hi", F.max))})
    out = {}
    for k, s in filled.items():
        lo, hi = lim[f"lo{k}"], lim[f"hi{k}"]
        out[k] = F.lit(0.0) if lo is None or hi - lo < TINY else (s - lo) / (hi - lo)
    return out


def statistical_union(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    methods: Sequence[str] = ("iqr", "zscore", "modified_zscore"),
    flag: str = "is_outlier",
    score: str = "outlier_score",
) -> DataFrame:
    """Row flag = any column flagged by any method; score = mean scaled score."""
    fits = {"iqr": fit_iqr, "zscore": fit_zscore, "modified_zscore": fit_modified_zscore}
    df = nan_to_null(df)
    dets = [fits[m](df, columns) for m in methods]
    any_flag = F.lit(False)
    all_scores: dict[str, Column] = {}
    for d in dets:
        for c, f in d.flags.items():
            any_flag = any_flag | f
            all_scores[f"{d.method}:{c}"] = d.scores[c]
    parts = list(scaled(df, all_scores).values())
    mean = sum(parts[1:], parts[0]) / len(parts) if parts else F.lit(0.0)
    return df.withColumns({flag: any_flag, score: mean})


def vote(df: DataFrame, flags: Sequence[str], scores: Mapping[str, str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Combine row-level methods that are already columns of ``df``."""
    n = len(flags)
    votes = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags[1:]), F.coalesce(F.col(flags[0]), F.lit(False)).cast("int"))
    share = votes / F.lit(float(n))
    out = df.withColumn("vote_share", share).withColumn("is_outlier", F.col("vote_share") >= threshold)
    if scores:
        parts = list(scaled(df, {f: F.col(s) for f, s in scores.items()}).values())
        out = out.withColumn("outlier_score", sum(parts[1:], parts[0]) / len(parts))
    return out


def agreement(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How many rows each method flags, and how many the vote flags."""
    cells = {f: count_if(F.col(f)) for f in [*flags, "is_outlier"]}
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *[a.alias(f"a{i}") for i, a in enumerate(cells.values())])
    rows = F.array(
        *[F.struct(F.lit(f).alias("method"), F.col(f"a{i}").alias("n_outliers")) for i, f in enumerate(cells)]
    )
    out = one.select("n_rows", F.inline(rows))
    return out.select("method", "n_outliers", ratio(F.col("n_outliers"), F.col("n_rows")).alias("rate"))


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(method, column, n_outliers, rate) of the three statistical detectors, one pass; quartiles and medians are found together."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    q = values.quantiles(df, {c: number(c) for c in names}, [0.25, 0.5, 0.75])
    lim = {c: (lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo), hi - lo) for c, (lo, _, hi) in q.items() if lo is not None}
    dets = [fit_iqr(df, names, fences=lim), fit_zscore(df, names), fit_modified_zscore(df, names, medians={c: v[1] for c, v in q.items()})]
    keys = [(d.method, c) for d in dets for c in d.flags]
    aggs = [count_if(d.flags[c]) for d in dets for c in d.flags]
    one = df.agg(F.count(F.lit(1)).alias("n"), *[a.alias(f"a{i}") for i, a in enumerate(aggs)])
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("method"), F.lit(c).alias("column"), F.col(f"a{i}").alias("n_outliers"))
            for i, (m, c) in enumerate(keys)
        ]
    )
    out = one.select("n", F.inline(rows))
    return out.select("method", "column", "n_outliers", ratio(F.col("n_outliers"), F.col("n")).alias("rate"))


def choose_method(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """Pick a detector from width, normality and skew, whatever the size."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    if len(names) == 1:
        x = number(names[0])
        got = one_row(df, {"n": F.count(x), "g1": F.skewness(x), "g2": F.kurtosis(x)})
        m, g1, g2 = got["n"], got["g1"] or 0.0, got["g2"] or 0.0
        normal = math.exp(-m / 6 * (g1 * g1 + g2 * g2 / 4) / 2) > 0.05 if m >= 8 else False
        skew = abs(g1) * math.sqrt(m * (m - 1)) / (m - 2) if m > 2 else 0.0
        if normal:
            return "zscore"
        return "modified_zscore" if skew > 1.0 else "iqr"
    return "isolation_forest"


def recommendations(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Advice lines from the vote rate, size, width and disagreement."""
    agree = {r["method"]: r for r in agreement(df, flags).collect()}  # one row per method
    n, p = df.count(), len(numeric_columns(df))
    rate = agree["is_outlier"]["rate"] if n else 0.0
    counts = [agree[f]["n_outliers"] for f in flags]
    out: list[tuple[str, str]] = []
    if rate == 0:
        return frame(df.sparkSession, [("clean", "no row is flagged by the vote")], "kind string, advice string")
    if rate < 0.01:
        out.append(("few", "cap or winsorise instead of removing"))
    elif rate < 0.05:
        out.append(("some", "look at each case, they may be genuine"))
    else:
        out.append(("many", "check data quality or the assumed share of outliers"))
    if p > 10:
        out.append(("wide", "prefer isolation forest or local density"))
    if n < 100:
        out.append(("small", "prefer Grubbs or modified z-scores"))
    if max(counts) - min(counts) > 0.2 * n:
        out.append(("disagree", "methods differ much; trust the vote"))
    return frame(df.sparkSession, out, "kind string, advice string")


def contaminated(df: DataFrame, score: str, share: float = 0.05, flag: str = "is_outlier") -> DataFrame:
    """Flag scores at or above the (1 − share) quantile."""
    cut = values.quantiles(df, {"s": F.col(score)}, [1 - share])["s"][0]
    return df.withColumn(flag, F.coalesce(F.col(score) >= F.lit(cut), F.lit(False)))


def top_scores(df: DataFrame, score: str, key: Sequence[str], k: int = 100) -> DataFrame:
    w = Window.orderBy(F.desc(score), *[col(c) for c in key])
    top = df.orderBy(F.desc(score), *[col(c) for c in key]).limit(k)
    return top.withColumn("place", F.row_number().over(w))
