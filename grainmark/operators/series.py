"""Ordered-series statistics, transforms and distribution fits."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special, values
from ..functions.columns import col, frame, nan_to_null, number, numeric_columns, one_row, union_all
from ..functions.ship import ship
from . import outliers, stats

# ---- lags: equal blocks of positions with a halo as long as the largest lag ----


def lagged(df: DataFrame, columns: Sequence[str], order: Sequence[str], lags: int) -> DataFrame:
    """(pos, x0…, x0_1 … x0_L, …): every value beside its ``lags`` predecessors."""
    rows = nan_to_null(df).select(*[col(o) for o in order], *[number(c).alias(f"x{i}") for i, c in enumerate(columns)])
    rows = rows.na.drop("any", subset=[f"x{i}" for i in range(len(columns))])
    placed = values.with_position(rows, order, "pos").select("pos", *[f"x{i}" for i in range(len(columns))])
    halo = values.blocks_with_halo(placed, "pos", lags)
    w = Window.partitionBy("block").orderBy("pos")
    cols = [F.lag(f"x{i}", k).over(w).alias(f"x{i}_{k}") for i in range(len(columns)) for k in range(1, lags + 1)]
    return halo.select("pos", "own", *[f"x{i}" for i in range(len(columns))], *cols).filter("own").drop("own")


def autocovariances(df: DataFrame, column: str, order: Sequence[str], lags: int) -> tuple[int, float, list[float]]:
    """n, mean and the raw sums Σ (x_t − m)(x_{t−k} − m) for k = 0 … lags."""
    x = number(column)
    head = one_row(nan_to_null(df), {"n": F.count(x), "m": F.avg(x)})
    m = head["m"]
    rows = lagged(df, [column], order, lags)
    d = F.col("x0") - F.lit(m)
    got = one_row(rows, {str(k): F.sum(d * (F.col(f"x0_{k}") - F.lit(m)) if k else d * d) for k in range(lags + 1)})
    return head["n"], m, [got[str(k)] or 0.0 for k in range(lags + 1)]


def autocorrelation(df: DataFrame, column: str, order: Sequence[str], max_lags: int = 20) -> DataFrame:
    """(lag, acf, pacf, significant): lags up to min(max_lags, n/3)."""
    n = nan_to_null(df).filter(col(column).isNotNull()).count()
    lags = min(max_lags, n // 3)
    n, _, c = autocovariances(df, column, order, lags)
    adjusted = [v / (n - k) for k, v in enumerate(c)]
    rho = [v / adjusted[0] for v in adjusted]
    phi, pacf = [], [1.0]
    for k in range(1, lags + 1):  # Durbin–Levinson on a few numbers
        num = rho[k] - sum(p * rho[k - 1 - j] for j, p in enumerate(phi))
        den = 1 - sum(p * rho[j + 1] for j, p in enumerate(phi))
        last = num / den
        phi = [p - last * phi[k - 2 - j] for j, p in enumerate(phi)] + [last]
        pacf.append(last)
    band = 1.96 / math.sqrt(n)
    rows = [(k, v / c[0], pacf[k], k > 0 and abs(v / c[0]) > band) for k, v in enumerate(c)]
    return frame(df.sparkSession, rows, "lag int, acf double, pacf double, significant boolean")


def gram(rows: DataFrame, cols: Sequence[Column]) -> np.ndarray:
    """Σ c_i c_j over complete rows: each task adds up its own small matrix,
    and only k² partial sums per task are exchanged."""
    k = len(cols)
    ship(rows.sparkSession)

    def add(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            x = pdf.to_numpy(float)
            total += x.T @ x
        i, j = np.indices((k, k))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    narrow = rows.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).na.drop("any")
    out = np.zeros((k, k))
    for r in narrow.mapInPandas(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
    return out


def _normal_equations(rows: DataFrame, y: Column, xs: Sequence[Column]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """XᵀX, Xᵀy, yᵀy and n (an intercept comes first)."""
    g = gram(rows, [F.lit(1.0), *xs, y])
    return g[:-1, :-1], g[:-1, -1], float(g[-1, -1]), int(round(g[0, 0]))


def _ols(a: np.ndarray, b: np.ndarray, yy: float, n: int, keep: Sequence[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, residual sum of squares and standard errors on a column subset."""
    k = list(keep)
    inv = np.linalg.pinv(a[np.ix_(k, k)])
    beta = inv @ b[k]
    rss = max(float(yy - beta @ b[k]), 0.0)
    return beta, rss, np.sqrt(np.maximum(np.diag(inv) * rss / max(n - len(k), 1), 0.0))


# MacKinnon's response surface and 5 % points (constant, one series).
ADF_SMALL, ADF_LARGE = [2.1659, 1.4412, 0.038269], [1.7339, 0.93202, -0.12745, -0.010368]
ADF_MIN, ADF_STAR, ADF_MAX = -18.83, -1.61, 2.74
KPSS_CRITICAL, KPSS_P = [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]


def adf_p(t: float) -> float:
    if t > ADF_MAX:
        return 1.0
    if t < ADF_MIN:
        return 0.0
    c = ADF_SMALL if t <= ADF_STAR else ADF_LARGE
    return special.norm_cdf(sum(v * t**i for i, v in enumerate(c)))


def adf(df: DataFrame, column: str, order: Sequence[str]) -> tuple[float, float, int]:
    """Augmented Dickey–Fuller with a constant; lag order by AIC on one sample."""
    n = nan_to_null(df).filter(col(column).isNotNull()).count()
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    rows = lagged(df, [column], order, most + 1)
    lag = lambda k: F.col("x0") if k == 0 else F.col(f"x0_{k}")
    dy = lag(0) - lag(1)
    diffs = [lag(k) - lag(k + 1) for k in range(1, most + 1)]
    same = rows.filter(F.col(f"x0_{most + 1}").isNotNull())
    a, b, yy, m = _normal_equations(same, dy, [lag(1), *diffs])

    def aic(p: int) -> float:
        keep = range(2 + p)
        rss = max(_ols(a, b, yy, m, keep)[1], 1e-300)
        return m * (math.log(2 * math.pi * rss / m) + 1) + 2 * (2 + p)

    p = min(range(most + 1), key=aic)
    final = rows.filter(F.col(f"x0_{p + 1}").isNotNull())
    a, b, yy, m = _normal_equations(final, dy, [lag(1), *diffs[:p]])
    beta, _, se = _ols(a, b, yy, m, range(2 + p))
    t = float(beta[1] / se[1])
    return t, adf_p(t), p


def kpss(df: DataFrame, column: str, order: Sequence[str]) -> tuple[float, float, int]:
    """KPSS around a constant with automatic bandwidth."""
    x = number(column)
    head = one_row(nan_to_null(df), {"n": F.count(x), "m": F.avg(x)})
    n, m = head["n"], head["m"]
    few = int(n ** (2 / 9))
    _, _, c = autocovariances(df, column, order, few)
    s0 = c[0] / n + sum(2 * v / n for v in c[1:])
    s1 = sum(2 * k * v / n for k, v in enumerate(c) if k)
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    if width > few:
        _, _, c = autocovariances(df, column, order, width)
    long_run = c[0] / n + 2 / n * sum((1 - k / (width + 1)) * c[k] for k in range(1, width + 1))
    # partial sums: inside fixed blocks, plus what the blocks before add up to
    rows = nan_to_null(df).filter(col(column).isNotNull()).select(*[col(o) for o in order], (x - F.lit(m)).alias("e"))
    placed = values.with_position(rows, order, "pos").withColumn("blk", F.floor(F.col("pos") / 1_000_000))
    w = Window.partitionBy("blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.select("blk", F.sum("e").over(w).alias("s"), "e")
    per = inner.groupBy("blk").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("s").alias("s"), F.sum("e").alias("e"), F.count(F.lit(1)).alias("k"))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per million
    carry = F.coalesce(F.sum("e").over(before), F.lit(0.0))
    eta = per.select((F.col("ss") + 2 * carry * F.col("s") + F.col("k") * carry * carry).alias("v")).agg(F.sum("v")).first()[0]
    stat = eta / (n * n) / long_run
    p = float(np.interp(stat, KPSS_CRITICAL, KPSS_P))
    return stat, p, width


def stationarity(df: DataFrame, column: str, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    (t, pa, la), (s, pk, lk) = adf(df, column, order), kpss(df, column, order)
    a_ok, k_ok = pa < alpha, pk > alpha
    verdict = "stationary" if a_ok and k_ok else "non_stationary" if not a_ok and not k_ok else "inconclusive"
    rows = [("adf", t, pa, la, a_ok, verdict), ("kpss", s, pk, lk, k_ok, verdict)]
    return frame(df.sparkSession, rows, "test string, statistic double, p_value double, lags int, is_stationary boolean, verdict string")


def granger(df: DataFrame, cause: str, effect: str, order: Sequence[str], max_lag: int = 5, alpha: float = 0.05) -> DataFrame:
    """(lag, f, p_value, significant): does the cause's past help predict the effect?"""
    rows_out = []
    wide = lagged(df, [effect, cause], order, max_lag)
    for k in range(1, max_lag + 1):
        rows = wide.filter(F.col(f"x0_{k}").isNotNull())
        xs = [F.col(f"x0_{j}") for j in range(1, k + 1)] + [F.col(f"x1_{j}") for j in range(1, k + 1)]
        a, b, yy, n = _normal_equations(rows, F.col("x0"), xs)
        rss_u = _ols(a, b, yy, n, range(1 + 2 * k))[1]
        rss_r = _ols(a, b, yy, n, range(1 + k))[1]
        dof = n - 2 * k - 1
        f = (rss_r - rss_u) / k / (rss_u / dof)
        p = special.f_sf(f, k, dof)
        rows_out.append((k, f, p, p < alpha))
    return frame(df.sparkSession, rows_out, "lag int, f double, p_value double, significant boolean")


# ---- transforms ----

TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "log1p": lambda x: F.when(x > -1, F.log1p(x)),
    "sqrt": lambda x: F.sqrt(F.abs(x)),
    "square": lambda x: x * x,
    "reciprocal": lambda x: 1 / F.nullif(x + 1e-9, F.lit(0.0)),
    "cbrt": lambda x: F.cbrt(x),
}


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    two = 2 - lam
    down = -F.log1p(-x) if abs(two) < 1e-12 else -(F.pow(1 - x, F.lit(two)) - 1) / two
    return F.when(x >= 0, up).otherwise(down)


def best_lambda(df: DataFrame, x: Column, power: Callable[[Column, float], Column], jac: Column) -> float:
    """Maximum-likelihood λ on a grid that is refined three times, one pass each."""
    lo, hi = -3.0, 3.0
    best = 1.0
    for _ in range(4):
        grid = [float(v) for v in np.linspace(lo, hi, 13)]
        aggs: dict[str, Column] = {"n": F.count(x), "j": F.sum(jac)}
        aggs.update({str(i): F.var_pop(power(x, g)) for i, g in enumerate(grid)})
        got = one_row(df, aggs)

        def fit(i: int) -> float:
            v = got[str(i)]
            return -math.inf if not v or v <= 0 else -got["n"] / 2 * math.log(v) + (grid[i] - 1) * got["j"]

        k = max(range(len(grid)), key=fit)
        best, step = grid[k], grid[1] - grid[0]
        lo, hi = best - step, best + step
    return best


def advise_transform(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, transform, lambda, skew_after, normality_p, improvement, is_best).

    The candidates' moments share one aggregate per column; normality is the
    omnibus moment test over all rows.
    """
    df = nan_to_null(df)
    rows: list[tuple] = []
    for c in list(columns or numeric_columns(df)):
        x = number(c)
        head = one_row(df, {"n": F.count(x), "lo": F.min(x)})
        if head["n"] < 20:
            continue
        tries: dict[str, tuple[Column, float | None]] = {k: (f(x), None) for k, f in TRANSFORMS.items()}
        if head["lo"] > 0:
            lam = best_lambda(df, x, box_cox, F.ln(x))
            tries["box_cox"] = (box_cox(x, lam), lam)
        lam = best_lambda(df, x, yeo_johnson, F.signum(x) * F.log1p(F.abs(x)))
        tries["yeo_johnson"] = (yeo_johnson(x, lam), lam)
        tries["none"] = (x, None)
        got = one_row(
            df, {f"{m}|{k}": f(e) for k, (e, _) in tries.items() for m, f in (("n", F.count), ("s", F.skewness), ("k", F.kurtosis))}
        )
        p: dict[str, float] = {}
        for k in tries:
            s = got[f"s|{k}"]
            if got[f"n|{k}"] == head["n"] and s is not None and math.isfinite(s):
                p[k] = stats.k_squared(head["n"], s, got[f"k|{k}"])[1]
        base = p.pop("none", 0.0)
        top = max(p, key=lambda k: (p[k], -abs(got[f"s|{k}"])), default=None)
        rows += [(c, k, tries[k][1], got[f"s|{k}"], v, v - base, k == top) for k, v in p.items()]
    return frame(
        df.sparkSession,
        rows,
        "column string, transform string, lambda double, skew_after double, normality_p double, improvement double, is_best boolean",
    )


# ---- distribution fits ----

LOG_2PI = math.log(2 * math.pi)


def _log_density(name: str, x: Column, p: Sequence[float]) -> Column:
    """Log density of one family at literal parameters."""
    ln = F.ln
    if name in ("norm", "lognorm"):
        y = ln(x) if name == "lognorm" else x
        z = (y - p[0]) / p[1]
        out = -z * z / 2 - math.log(p[1]) - LOG_2PI / 2
        return out - ln(x) if name == "lognorm" else out
    if name == "expon":
        return -(x - p[0]) / p[1] - math.log(p[1])
    if name == "uniform":
        return F.when(x.isNotNull(), F.lit(-math.log(p[1])))
    if name == "laplace":
        return -F.abs(x - p[0]) / p[1] - math.log(2 * p[1])
    if name == "rayleigh":
        return ln(x) - 2 * math.log(p[0]) - x * x / (2 * p[0] ** 2)
    if name == "pareto":
        return math.log(p[1]) + p[1] * math.log(p[0]) - (p[1] + 1) * ln(x)
    if name == "logistic":
        z = (x - p[0]) / p[1]
        return -z - math.log(p[1]) - 2 * F.log1p(F.exp(-z))
    if name == "cauchy":
        z = (x - p[0]) / p[1]
        return -math.log(math.pi * p[1]) - F.log1p(z * z)
    if name in ("gumbel_r", "gumbel_l"):
        z = (x - p[0]) / p[1] if name == "gumbel_r" else -(x - p[0]) / p[1]
        return -z - F.exp(-z) - math.log(p[1])
    if name in ("weibull_min", "weibull_max"):
        y = x if name == "weibull_min" else -x
        return math.log(p[0] / p[1]) + (p[0] - 1) * (ln(y) - math.log(p[1])) - F.pow(y / p[1], F.lit(p[0]))
    if name in ("gamma", "chi2"):
        a, scale = (p[0], p[1]) if name == "gamma" else (p[0] / 2, 2.0 * p[1])
        return (a - 1) * ln(x) - x / scale - a * math.log(scale) - math.lgamma(a)
    if name == "beta":
        a, b, lo, w = p
        u = (x - lo) / w
        return (a - 1) * ln(u) + (b - 1) * ln(1 - u) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)) - math.log(w)
    if name == "t":
        v, m, s = p
        z = (x - m) / s
        return math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(s) - (v + 1) / 2 * F.log1p(z * z / v)
    if name == "triang":
        lo, c, hi = p
        left = ln(F.nullif(2 * (x - lo) / ((hi - lo) * max(c - lo, 1e-300)), F.lit(0.0)))
        right = ln(F.nullif(2 * (hi - x) / ((hi - lo) * max(hi - c, 1e-300)), F.lit(0.0)))
        return F.when(x < c, left).otherwise(right)
    if name == "exponweib":
        a, c, s = p
        u = F.pow(x / s, F.lit(c))
        return math.log(a * c / s) + (a - 1) * ln(1 - F.exp(-u)) - u + (c - 1) * ln(x / s)
    if name == "burr":
        c, d, s = p
        y = x / s
        return math.log(c * d / s) - (c + 1) * ln(y) - (d + 1) * F.log1p(F.pow(y, F.lit(-c)))
    raise ValueError(name)


def _cdf(name: str, x: float, p: Sequence[float]) -> float:
    if name in ("norm", "lognorm"):
        return special.norm_cdf(((math.log(x) if name == "lognorm" else x) - p[0]) / p[1])
    if name == "expon":
        return -math.expm1(-(x - p[0]) / p[1])
    if name == "uniform":
        return (x - p[0]) / p[1]
    if name == "laplace":
        z = (x - p[0]) / p[1]
        return 0.5 * math.exp(z) if z < 0 else 1 - 0.5 * math.exp(-z)
    if name == "rayleigh":
        return -math.expm1(-x * x / (2 * p[0] ** 2))
    if name == "pareto":
        return 1 - (p[0] / x) ** p[1]
    if name == "logistic":
        return 1 / (1 + math.exp(-max(min((x - p[0]) / p[1], 700), -700)))
    if name == "cauchy":
        return 0.5 + math.atan((x - p[0]) / p[1]) / math.pi
    if name == "gumbel_r":
        return math.exp(-math.exp(min(-(x - p[0]) / p[1], 700)))
    if name == "gumbel_l":
        return -math.expm1(-math.exp(min((x - p[0]) / p[1], 700)))
    if name == "weibull_min":
        return -math.expm1(-((x / p[1]) ** p[0]))
    if name == "weibull_max":
        return math.exp(-((-x / p[1]) ** p[0]))
    if name == "gamma":
        return special.gamma_p(p[0], x / p[1])
    if name == "chi2":
        return special.gamma_p(p[0] / 2, x / (2 * p[1]))
    if name == "beta":
        return special.beta_i(p[0], p[1], (x - p[2]) / p[3])
    if name == "t":
        z = (x - p[1]) / p[2]
        half = 0.5 * special.t_sf2(abs(z), p[0])
        return half if z < 0 else 1 - half
    if name == "triang":
        lo, c, hi = p
        if x < c:
            return (x - lo) ** 2 / ((hi - lo) * (c - lo))
        return 1 - (hi - x) ** 2 / ((hi - lo) * max(hi - c, 1e-300))
    if name == "exponweib":
        return (-math.expm1(-((x / p[2]) ** p[1]))) ** p[0]
    if name == "burr":
        return (1 + (x / p[2]) ** -p[0]) ** -p[1]
    raise ValueError(name)


def _starts(f: dict, q: Sequence[float]) -> dict[str, tuple[list[float], list[bool], int]]:
    """Closed-form or moment starting points: parameters, which to refine, and their count."""
    m, s, lo, hi = f["m"], f["s"], f["lo"], f["hi"]
    med, iqr = q[1], max(q[2] - q[0], 1e-9)
    beta = s * math.sqrt(6) / math.pi
    out: dict[str, tuple[list[float], list[bool], int]] = {
        "norm": ([m, s], [False, False], 2),
        "expon": ([lo, max(m - lo, 1e-12)], [False, False], 2),
        "uniform": ([lo, hi - lo], [False, False], 2),
        "laplace": ([med, f["mad"]], [False, False], 2),
        "logistic": ([m, s * math.sqrt(3) / math.pi], [True, True], 2),
        "cauchy": ([med, iqr / 2], [True, True], 2),
        "gumbel_r": ([m - 0.5772156649 * beta, beta], [True, True], 2),
        "gumbel_l": ([m + 0.5772156649 * beta, beta], [True, True], 2),
        "t": ([6.0, m, s * math.sqrt(4 / 6)], [True, True, True], 3),
        "triang": ([lo - 1e-6 * s, min(max(3 * m - lo - hi, lo), hi), hi + 1e-6 * s], [False, True, False], 3),
    }
    w = (hi - lo) * 1.000001
    u, v = (m - lo) / w, (s / w) ** 2
    k = max(u * (1 - u) / v - 1, 0.05) if v else 1.0
    out["beta"] = ([max(u * k, 0.05), max((1 - u) * k, 0.05), lo - 5e-7 * (hi - lo), w], [True, True, False, False], 4)
    if lo > 0:
        shape = (m / s) ** 2
        cv = max(s / m, 1e-6)
        out["lognorm"] = ([f["lm"], f["ls"]], [False, False], 2)
        out["rayleigh"] = ([math.sqrt(f["m2"] / 2)], [False], 1)
        out["pareto"] = ([lo, 1 / max(f["lm"] - math.log(lo), 1e-12)], [False, False], 2)
        out["gamma"] = ([shape, m / shape], [True, True], 2)
        out["chi2"] = ([max(2 * shape, 0.1), s * s / (2 * m) / 1.0], [True, True], 2)
        wk = cv**-1.086
        out["weibull_min"] = ([wk, m / math.gamma(1 + 1 / wk)], [True, True], 2)
        out["exponweib"] = ([1.0, wk, m / math.gamma(1 + 1 / wk)], [True, True, True], 3)
        out["burr"] = ([max(math.pi / (math.sqrt(3) * max(f["ls"], 1e-6)), 0.2), 1.0, med], [True, True, True], 3)
    if hi < 0:
        wk = max(abs(s / m), 1e-6) ** -1.086
        out["weibull_max"] = ([wk, -m / math.gamma(1 + 1 / wk)], [True, True], 2)
    return out


LOCATION = {("logistic", 0), ("cauchy", 0), ("gumbel_r", 0), ("gumbel_l", 0), ("t", 1), ("triang", 1)}


def fit_distributions(df: DataFrame, column: str, rounds: int = 12, min_n: int = 20) -> DataFrame:
    """(distribution, log_likelihood, aic, bic, ks, ks_p, rank) ordered by AIC.

    Every round tries a step up and down for each free parameter of *all*
    families in the same few aggregates, so the number of passes over the data
    is the number of rounds, not families times steps. The distance to the
    fitted law comes from the rank runs of the column.
    """
    df = nan_to_null(df).filter(col(column).isNotNull()).select(number(column).alias("x"))
    x = F.col("x")
    schema = "distribution string, params array<double>, log_likelihood double, aic double, bic double, ks double, ks_p double, rank int"
    pos = F.when(x > 0, F.ln(x))
    f = one_row(
        df,
        {"n": F.count(x), "m": F.avg(x), "s": F.stddev_pop(x), "lo": F.min(x), "hi": F.max(x), "lm": F.avg(pos), "ls": F.stddev_pop(pos), "m2": F.avg(x * x)},
    )
    if f["n"] < min_n or not f["s"]:
        return df.sparkSession.createDataFrame([], schema)
    q = values.quantiles(df, {"x": x}, [0.25, 0.5, 0.75])["x"]
    f["mad"] = max(one_row(df, {"d": F.avg(F.abs(x - F.lit(q[1])))})["d"], 1e-12)
    fits = {k: (list(p), free, kk) for k, (p, free, kk) in _starts(f, q).items()}
    steps = {k: [0.25] * len(p) for k, (p, _, _) in fits.items()}
    score = {k: v for k, v in one_row(df, {k: F.sum(_log_density(k, x, p)) for k, (p, _, _) in fits.items()}).items()}

    def moved(k: str, i: int, up: int) -> list[float]:
        p = list(fits[k][0])
        if (k, i) in LOCATION:
            p[i] += up * steps[k][i] * f["s"]
            if k == "triang":
                p[i] = min(max(p[i], p[0]), p[2])
        else:
            p[i] *= math.exp(up * steps[k][i])
        return p

    for _ in range(rounds):
        tries = {
            (k, i, up): moved(k, i, up) for k, (p, free, _) in fits.items() for i in range(len(p)) if free[i] for up in (1, -1)
        }
        got = one_row(df, {f"{k}|{i}|{up}": F.sum(_log_density(k, x, p)) for (k, i, up), p in tries.items()})
        wanted: dict[str, list[float]] = {}
        for k, (p, free, kk) in fits.items():
            here = score[k] if score[k] is not None else -math.inf
            new = list(p)
            for i in range(len(p)):
                if not free[i]:
                    continue
                side = {up: got[f"{k}|{i}|{up}"] for up in (1, -1)}
                side = {up: (-math.inf if v is None or not math.isfinite(v) else v) for up, v in side.items()}
                up = max(side, key=side.get)
                if side[up] > here:
                    new[i] = tries[k, i, up][i]
                else:
                    steps[k][i] /= 2.5
            if new != p:
                wanted[k] = new
        # Moves of several parameters at once are tried together, in one more pass.
        several = {k: new for k, new in wanted.items() if sum(a != b for a, b in zip(new, fits[k][0])) > 1}
        joint = one_row(df, {k: F.sum(_log_density(k, x, new)) for k, new in several.items()}) if several else {}
        for k, new in wanted.items():
            p, free, kk = fits[k]
            here = score[k] if score[k] is not None else -math.inf
            both = joint.get(k)
            if both is not None and math.isfinite(both) and both > here:
                fits[k], score[k] = (new, free, kk), both
            else:  # keep only the best single move
                cand = [(got[f"{k}|{i}|{up}"], tries[k, i, up]) for i in range(len(p)) if free[i] for up in (1, -1)]
                cand = [c for c in cand if c[0] is not None and math.isfinite(c[0])]
                v, pp = max(cand, key=lambda c: c[0])
                if v > here:
                    fits[k], score[k] = (pp, free, kk), v
    good = {k: v for k, v in score.items() if v is not None and math.isfinite(v)}
    names = sorted(good, key=lambda k: 2 * fits[k][2] - 2 * good[k])
    params = {k: [float(v) for v in fits[k][0]] for k in names}

    ship(df.sparkSession)

    @F.pandas_udf("array<double>")
    def cdfs(x: pd.Series) -> pd.Series:
        return x.map(lambda v: [_cdf(k, v, params[k]) for k in names])

    runs = values.value_runs(df.select(F.lit("x").alias("column"), x.alias("value")), ["column"]).withColumn("c", cdfs("value"))
    n, below, total = F.col("n"), F.col("below"), F.col("total")
    gap = lambda c: F.greatest((below + n) / total - c, c - below / total)
    ks = runs.agg(*[F.max(gap(F.col("c")[i])).alias(f"k{i}") for i in range(len(names))]).first()
    rows = []
    for i, k in enumerate(names):
        p = fits[k][2]
        rows.append(
            (k, params[k], good[k], 2 * p - 2 * good[k], p * math.log(f["n"]) - 2 * good[k], ks[f"k{i}"], special.kolmogorov_sf(ks[f"k{i}"], f["n"]), i + 1)
        )
    return frame(df.sparkSession, rows, schema)


# ---- everything ----


def full_stats_report(df: DataFrame, columns: Sequence[str] | None = None, groups: Sequence[str] = ()) -> DataFrame:
    """(section, column, metric, value): description, shape, normality, correlation, outlier and group tests."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))

    def long(part: DataFrame, section: str, key: Column, metrics: Sequence[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return part.select(F.lit(section).alias("section"), key.alias("column"), F.inline(cells))

    c = F.col("column")
    parts = [
        long(stats.describe_extended(df, names), "describe", c, ["n", "mean", "median", "std", "min", "max", "iqr"]),
        long(stats.shape_classes(df, names), "shape", c, ["skewness", "kurtosis"]),
        long(stats.normality_report(df, names), "normality", c, ["tests", "passed"]),
        long(stats.pearson(df, names), "pearson", F.concat_ws("~", "col_a", "col_b"), ["r", "p_value"]),
        long(outliers.grubbs_test(df, names), "grubbs", c, ["statistic", "critical"]),
    ]
    for g in groups:
        for x in names:
            part = stats.compare_groups(df, x, g).withColumn("column", F.lit(f"{x} by {g}"))
            parts.append(long(part, "groups", c, ["statistic", "p_value"]))
    return reduce(lambda a, b: union_all([a, b]), parts)
