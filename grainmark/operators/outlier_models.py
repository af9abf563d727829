"""Multivariate outlier detectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scratch, special, values
from ..functions.columns import col, nan_to_null, number, numeric_columns, one_row
from ..functions.ship import ship
from . import outliers
from .neighbours import knn

CONTAMINATION = 0.05


def _complete(df: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str], Column]:
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    ok = number(names[0]).isNotNull()
    for c in names[1:]:
        ok = ok & number(c).isNotNull()
    return df, names, ok


# ---- robust covariance ----

# A bounded sample proposes where the core of the data lies; the fit itself takes all rows.
SAMPLE_GROUPS, GROUP_ROWS = 5, 300
STARTS, CARRIED = 100, 10


def _quadratic(names: Sequence[str], center: np.ndarray, inverse: np.ndarray) -> Column:
    """Squared Mahalanobis distance as one expression of literals (no UDF)."""
    d = [number(c) - float(m) for c, m in zip(names, center)]
    total = None
    for i in range(len(d)):
        for j in range(i, len(d)):
            term = d[i] * d[j] * float(inverse[i, j] * (1 if i == j else 2))
            total = term if total is None else total + term
    return total


def _inverse(cov: np.ndarray) -> np.ndarray:
    """Pseudo-inverse that does not depend on the columns' units."""
    unit = np.sqrt(np.diag(cov))
    unit[unit == 0] = 1.0
    return np.linalg.pinv(cov / np.outer(unit, unit), hermitian=True) / np.outer(unit, unit)


def _volume(cov: np.ndarray, unit: np.ndarray) -> tuple[int, float]:
    """Rank and log determinant on that rank, in the given units; the smaller the tighter."""
    own = np.linalg.eigvalsh(cov / np.outer(unit, unit))
    own = own[own > 1e-12]
    return len(own), float(np.log(own).sum())


def _squared(x: np.ndarray, center: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    d = x - center
    return np.einsum("ij,ij->i", d @ inverse, d)


def _concentrate(x: np.ndarray, center: np.ndarray, cov: np.ndarray, support: float) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter of the closest ``support`` share of a few rows."""
    h = math.ceil(support * len(x))
    near = x[np.argpartition(_squared(x, center, _inverse(cov)), h - 1)[:h]]
    return near.mean(axis=0), np.atleast_2d(np.cov(near.T, bias=True))


def _proposals(x: np.ndarray, support: float, seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and scatters to carry to all rows: from medians and MADs, and the best of many
    small draws, each concentrated in its group of the sample and then in the whole sample."""
    rng = np.random.default_rng(seed)
    p = x.shape[1]
    unit = x.std(axis=0)
    unit[unit == 0] = 1.0
    middle = np.median(x, axis=0)
    mad = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), 1e-9 * unit)
    found = [(middle, np.diag(mad**2))]
    order = rng.permutation(len(x))
    groups = np.array_split(order, max(1, min(SAMPLE_GROUPS, len(x) // GROUP_ROWS)))
    for g in groups:
        tried = []
        for _ in range(STARTS // len(groups)):
            draw = x[rng.permutation(g)]
            k = p + 1  # a flat draw takes more rows until it has the group's dimensions
            while k < len(draw) and np.linalg.matrix_rank((draw[:k] - draw[:k].mean(axis=0)) / unit) < p:
                k = min(len(draw), 2 * k)
            fit = draw[:k].mean(axis=0), np.atleast_2d(np.cov(draw[:k].T, bias=True))
            for _ in range(2):
                fit = _concentrate(x[g], *fit, support)
            tried.append(fit)
        found += sorted(tried, key=lambda f: _volume(f[1], unit))[:CARRIED]
    for _ in range(2):
        found = [_concentrate(x, *f, support) for f in found]
    best: list[tuple[np.ndarray, np.ndarray]] = []
    for f in sorted(found, key=lambda f: _volume(f[1], unit)):  # several draws often end in the same core
        if not any(np.allclose(f[0] / unit, o[0] / unit, atol=1e-6) for o in best):
            best.append(f)
    return best[:CARRIED]


def _moments(rows: DataFrame, fits: Sequence[tuple[np.ndarray, np.ndarray]], cuts: Sequence[float], origin: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows, centre and scatter of the rows within each fit's cut, for all fits in one scan.

    A task adds up counts, sums and products about ``origin`` and sends one small state.
    """
    k, p = len(fits), len(origin)
    known = [(c - origin, _inverse(s)) for c, s in fits]

    def add(batches):
        state = np.zeros((k, 1 + p + p * p))
        for pdf in batches:
            x = pdf.to_numpy(float) - origin
            for f, (center, inverse) in enumerate(known):
                near = x[_squared(x, center, inverse) <= cuts[f] * (1 + 1e-12)]
                state[f] += np.concatenate([[len(near)], near.sum(axis=0), (near.T @ near).ravel()])
        f, at = np.indices(state.shape)
        yield pd.DataFrame({"f": f.ravel(), "at": at.ravel(), "v": state.ravel()})

    got = rows.mapInPandas(add, "f int, at int, v double").groupBy("f", "at").agg(F.sum("v").alias("v")).collect()
    state = np.zeros((k, 1 + p + p * p))
    for r in got:  # fits x (1 + p + p²) numbers
        state[r["f"], r["at"]] = r["v"]
    out = []
    for s in state:
        n = max(s[0], 1.0)
        m = s[1 : p + 1] / n
        out.append((int(s[0]), m + origin, s[p + 1 :].reshape(p, p) / n - np.outer(m, m)))
    return out


def fit_mcd(df: DataFrame, columns: Sequence[str] | None = None, support: float = 0.75, steps: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Robust centre and scatter: those of the ``support`` share of rows with the smallest scatter.

    Many starts compete on a bounded sample; the best are carried to all rows together, each
    step at two scans of a written table of these columns: one for the distance that encloses
    the share, one for the moments inside. Then the best goes on, ``steps`` times at most, is
    corrected to the normal distribution and reweighted. Twelve scans in all by default; beyond
    five million rows an exact distance takes three scans instead of one, so 22. A table without
    a complete row gives zeros.
    """
    df, names, ok = _complete(df, columns)
    p = len(names)
    ship(df.sparkSession)
    with scratch.temporary(df.sparkSession):
        rows = scratch.materialise(df.filter(ok).select(*[number(c).alias(c) for c in names]))
        n = rows.count()
        if not n:
            return names, np.zeros(p), np.zeros((p, p))
        wanted = SAMPLE_GROUPS * GROUP_ROWS
        few = rows if n <= wanted else rows.where(F.rand(42) < wanted / n)
        x = few.toPandas().to_numpy(float)  # about 1500 rows
        fits = _proposals(x if len(x) else np.zeros((1, p)), support)
        origin, unit = np.median(x, axis=0) if len(x) else np.zeros(p), x.std(axis=0) if len(x) else np.ones(p)
        unit[unit == 0] = 1.0

        def cuts(share: float) -> list[float]:
            found = values.quantiles(rows, {str(i): _quadratic(names, c, _inverse(s)) for i, (c, s) in enumerate(fits)}, [share])
            return [found[str(i)][0] for i in range(len(fits))]

        best = None
        for _ in range(1 + steps):
            stepped = [(c, s) for _, c, s in _moments(rows, fits, cuts(support), origin)]
            stepped.sort(key=lambda f: _volume(f[1], unit))
            size = _volume(stepped[0][1], unit)
            fits = stepped[:1]
            if best is not None and (size[0], size[1]) >= (best[0], best[1] - 1e-9):
                break
            best = size
        center, cov = fits[0]
        fits = [(center, cov * (cuts(0.5)[0] / special.chi2_ppf(0.5, p)))]
        _, center, cov = _moments(rows, fits, [special.chi2_ppf(0.975, p)], origin)[0]
    return names, center, cov


def _distance(names: Sequence[str], center: np.ndarray, cov: np.ndarray) -> Column:
    return F.sqrt(F.greatest(_quadratic(names, center, _inverse(cov)), F.lit(0.0)))


def robust_mahalanobis(df: DataFrame, columns: Sequence[str] | None = None, flag: str = "is_outlier", score: str = "distance", fit: tuple[list[str], np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Robust distance beyond √χ²(0.975, p); ``fit`` is what ``fit_mcd`` gave, if it is known."""
    names, center, cov = fit or fit_mcd(df, columns)
    limit = math.sqrt(special.chi2_ppf(0.975, len(names)))
    out = nan_to_null(df).withColumn(score, _distance(names, center, cov))
    return out.withColumn(flag, F.coalesce(F.col(score) > limit, F.lit(False)))


def elliptic_envelope(df: DataFrame, columns: Sequence[str] | None = None, contamination: float = CONTAMINATION, fit: tuple[list[str], np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The ``contamination`` share of rows with the largest robust distance."""
    out = robust_mahalanobis(df, columns, fit=fit).drop("is_outlier")
    cut = values.quantiles(out, {"d": F.col("distance")}, [1 - contamination])["d"][0]
    return out.withColumn("is_outlier", F.coalesce(F.col("distance") > F.lit(cut), F.lit(False)))


# ---- isolation forest ----


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    nodes: list = []

    def cut(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(x.shape[1])
        open_ = np.nonzero(spread > 0)[0]
        if depth >= limit or len(rows) <= 1 or not len(open_):
            nodes[me] = (-1, 0.0, 0, 0, depth + _path(len(rows)))
            return me
        d = int(rng.choice(open_))
        at = float(rng.uniform(rows[:, d].min(), rows[:, d].max()))
        a, b = cut(rows[rows[:, d] < at], depth + 1), cut(rows[rows[:, d] >= at], depth + 1)
        nodes[me] = (d, at, a, b, 0.0)
        return me

    cut(x, 0)
    return nodes


def isolation_forest(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    trees: int = 100,
    sample: int = 256,
    contamination: float = CONTAMINATION,
    seed: int = 42,
) -> DataFrame:
    """Add ``score`` (0.5 and more is unusual) and ``is_outlier``.

    A tree needs 256 rows only: the sample of all trees is a fixed number of
    rows, trees grow one per task, and scoring is one pass over the table.
    """
    df, names, ok = _complete(df, columns)
    spark = df.sparkSession
    ship(spark)
    rows = df.filter(ok).select(*[number(c).alias(f"x{i}") for i, c in enumerate(names)])
    # A hash of the row's place draws rows, so equal rows are drawn each for itself.
    rows = values.with_position(rows, [f"x{i}" for i in range(len(names))], "p")
    rows = scratch.materialise(rows.withColumn("h", F.xxhash64(F.lit(seed), "p")).drop("p"))
    want = trees * sample
    share = min(1.0, 1.2 * want / max(1, rows.count()) + 1e-4)  # a little more than wanted goes to the sort
    near = rows.where(F.col("h") / F.lit(float(2**64)) + 0.5 < F.lit(share)) if share < 1 else rows
    picked = near.orderBy("h").limit(want)
    # the same rows serve every tree when the table is small: a tree draws its own share
    bag = scratch.materialise(picked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "u", F.xxhash64(F.lit(seed), "tree", "h")
    ))
    xs = [f"x{i}" for i in range(len(names))]

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("u")[xs].to_numpy(float)[:sample]
        nodes = _grow(x, np.random.default_rng(seed + t), math.ceil(math.log2(max(len(x), 2))))
        return pd.DataFrame([(t, i, *n, len(x)) for i, n in enumerate(nodes)], columns=["t", "i", "d", "at", "a", "b", "len", "n"])

    schema = "t int, i int, d int, at double, a int, b int, len double, n int"
    forest = bag.groupBy("tree").applyInPandas(plant, schema).collect()  # trees × 511 nodes at most
    n_used = forest[0]["n"] if forest else 1
    plan = []
    for t in range(trees):
        nodes = sorted((r for r in forest if r["t"] == t), key=lambda r: r["i"])
        if nodes:
            plan.append(tuple(np.array([r[k] for r in nodes]) for k in ("d", "at", "a", "b", "len")))
    shared = spark.sparkContext.broadcast(plan)
    norm = _path(n_used)

    @F.pandas_udf("double")
    def score_of(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        total = np.zeros(len(x))
        r = np.arange(len(x))
        for d, at, a, b, length in shared.value:
            here = np.zeros(len(x), int)
            while True:
                live = d[here] >= 0
                if not live.any():
                    break
                right = x[r, np.maximum(d[here], 0)] >= at[here]
                here = np.where(live, np.where(right, b[here], a[here]), here)
            total += length[here]
        return pd.Series(2.0 ** (-(total / len(shared.value)) / norm))

    v = F.array(*[F.coalesce(number(c), F.lit(0.0)) for c in names])
    out = scratch.materialise(df.withColumn("score", F.when(ok, score_of(v))))
    cut = values.quantiles(out, {"s": F.col("score")}, [1 - contamination])["s"][0]
    return out.withColumn("is_outlier", F.coalesce(F.col("score") > F.lit(cut), F.lit(False)))


# ---- neighbours ----


def local_outlier_factor(df: DataFrame, key: str, columns: Sequence[str] | None = None, k: int = 20, contamination: float = CONTAMINATION) -> DataFrame:
    """(key, lof, is_outlier): density of a row against its neighbours' densities."""
    df = nan_to_null(df)
    names = [c for c in (columns or numeric_columns(df)) if c != key]
    rows = df.na.drop("any", subset=names)
    k = min(k, max(rows.count() - 1, 1))
    nn = scratch.materialise(knn(rows, None, key, names, k).select("lid", "rid", "dist"))
    far = nn.groupBy(F.col("lid").alias("rid")).agg(F.max("dist").alias("kd"))
    reach = nn.join(far, "rid").groupBy("lid").agg(F.avg(F.greatest("dist", "kd")).alias("r"))
    lrd = scratch.materialise(reach.select("lid", (1 / (F.col("r") + 1e-10)).alias("lrd")))
    around = nn.join(lrd.select(F.col("lid").alias("rid"), F.col("lrd").alias("near")), "rid").groupBy("lid").agg(F.avg("near").alias("near"))
    out = scratch.materialise(around.join(lrd, "lid").select(F.col("lid").alias(key), (F.col("near") / F.col("lrd")).alias("lof")))
    cut = values.quantiles(out, {"s": F.col("lof")}, [1 - contamination])["s"][0]
    return out.withColumn("is_outlier", F.col("lof") > F.lit(cut))


def scaled_columns(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    got = one_row(df, {f"{m}{c}": f(number(c)) for c in names for m, f in (("m", F.avg), ("s", F.stddev_pop))})
    return {c: (number(c) - got[f"m{c}"]) / (got[f"s{c}"] or 1.0) for c in names}


def dbscan_noise(df: DataFrame, key: str, columns: Sequence[str] | None = None, min_samples: int = 5, eps: float | None = None) -> DataFrame:
    """(key, is_core, is_outlier): noise of density clustering on scaled columns.

    A row is core when its (min_samples − 1)-th neighbour lies within eps. A
    row that is not core has fewer neighbours than that within eps, so its list
    already holds every core row that could claim it: no pair table is needed.
    """
    df = nan_to_null(df)
    names = [c for c in (columns or numeric_columns(df)) if c != key]
    rows = df.na.drop("any", subset=names)
    z = scaled_columns(rows, names)
    near = min_samples - 1
    nn = scratch.materialise(knn(rows, None, key, list(z.values()), near).select("lid", "rid", "dist", "place"))
    kth = nn.filter(F.col("place") == near).select("lid", F.col("dist").alias("kd"))
    if eps is None:
        eps = values.quantiles(kth, {"d": F.col("kd")}, [0.9])["d"][0]
    core = scratch.materialise(
        rows.select(col(key).cast("long").alias("lid")).join(kth, "lid", "left").select(
            "lid", F.coalesce(F.col("kd") <= F.lit(eps), F.lit(False)).alias("is_core")
        )
    )
    claimed = (
        nn.filter(F.col("dist") <= F.lit(eps))
        .join(core.filter("is_core").select(F.col("lid").alias("rid")), "rid", "left_semi")
        .select("lid")
        .distinct()
        .withColumn("claimed", F.lit(True))
    )
    out = core.join(claimed, "lid", "left")
    return out.select(F.col("lid").alias(key), "is_core", (~F.col("is_core") & F.col("claimed").isNull()).alias("is_outlier"))


# ---- one-class boundary ----


def one_class_svm(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    nu: float = CONTAMINATION,
    features: int = 100,
    rounds: int = 15,
    seed: int = 42,
) -> DataFrame:
    """Add ``score`` (above zero is outside) and ``is_outlier``.

    The radial kernel is replaced by random Fourier features; each round adds
    up one gradient of ``features`` numbers per task.
    """
    df, names, ok = _complete(df, columns)
    ship(df.sparkSession)
    z = scaled_columns(df.filter(ok), names)
    rng = np.random.default_rng(seed)
    w0 = rng.normal(0, math.sqrt(2.0 / len(names)), (len(names), features))  # gamma = 1 / p
    b0 = rng.uniform(0, 2 * math.pi, features)
    v = F.array(*z.values())
    rows = scratch.materialise(df.filter(ok).select(v.alias("v")))
    n = rows.count()

    def lift(x: np.ndarray) -> np.ndarray:
        return math.sqrt(2.0 / features) * np.cos(x @ w0 + b0)

    def mean_of(weights: np.ndarray | None, rho: float) -> np.ndarray:
        """Average feature vector of the rows inside the margin (all when no weights yet)."""

        def add(batches):
            total = np.zeros(features)
            for pdf in batches:
                if len(pdf):
                    f = lift(np.stack(pdf["v"].to_numpy()))
                    total += f.sum(axis=0) if weights is None else f[f @ weights < rho].sum(axis=0)
            yield pd.DataFrame({"i": np.arange(features), "t": total})

        got = rows.mapInPandas(add, "i int, t double").groupBy("i").agg(F.sum("t").alias("t")).collect()
        out = np.zeros(features)
        for r in got:
            out[r["i"]] = r["t"]
        return out / max(n, 1)

    def scorer(weights: np.ndarray):
        @F.pandas_udf("double")
        def f(v: pd.Series) -> pd.Series:
            return pd.Series(lift(np.stack(v.to_numpy()).astype(float)) @ weights)

        return f

    w = mean_of(None, 0.0)
    rho = values.quantiles(rows.select(scorer(w)("v").alias("s")), {"s": F.col("s")}, [nu])["s"][0]
    for t in range(1, rounds + 1):
        step = 1.0 / (t + 1)
        w = (1 - step) * w + step * mean_of(w, rho) / nu
        rho = values.quantiles(rows.select(scorer(w)("v").alias("s")), {"s": F.col("s")}, [nu])["s"][0]
    safe = F.array(*[F.coalesce(e, F.lit(0.0)) for e in z.values()])
    out = df.withColumn("score", F.when(ok, F.lit(rho) - scorer(w)(safe)))
    return out.withColumn("is_outlier", F.coalesce(F.col("score") > 0, F.lit(False)))


# ---- all methods together ----


def ensemble(df: DataFrame, key: str, columns: Sequence[str] | None = None, methods: Sequence[str] = ("statistical", "isolation_forest", "mcd", "elliptic_envelope"), threshold: float = 0.5) -> DataFrame:
    """Vote of row-level methods: flags, vote share, mean scaled score."""
    df = nan_to_null(df)
    names = [c for c in (columns or numeric_columns(df)) if c != key]
    out = df
    flags, scores = [], {}
    fit = fit_mcd(df, names) if {"mcd", "elliptic_envelope"} & set(methods) else None  # both judge by one fit
    for m in methods:
        if m == "statistical":
            part = outliers.statistical_union(df, names, flag="f", score="s").select(col(key), "f", "s")
        elif m == "isolation_forest":
            part = isolation_forest(df, names).select(col(key), F.col("is_outlier").alias("f"), F.col("score").alias("s"))
        elif m == "mcd":
            part = robust_mahalanobis(df, names, fit=fit).select(col(key), F.col("is_outlier").alias("f"), F.col("distance").alias("s"))
        elif m == "elliptic_envelope":
            part = elliptic_envelope(df, names, fit=fit).select(col(key), F.col("is_outlier").alias("f"), F.col("distance").alias("s"))
        elif m == "lof":
            part = local_outlier_factor(df, key, names).select(col(key), F.col("is_outlier").alias("f"), F.col("lof").alias("s"))
        elif m == "dbscan":
            part = dbscan_noise(df, key, names).select(col(key), F.col("is_outlier").alias("f"), F.col("is_outlier").cast("double").alias("s"))
        elif m == "one_class_svm":
            part = one_class_svm(df, names).select(col(key), F.col("is_outlier").alias("f"), F.col("score").alias("s"))
        else:
            raise ValueError(f"unknown method: {m}")
        out = out.join(part.withColumnsRenamed({"f": f"{m}_flag", "s": f"{m}_score"}), key, "left")
        flags.append(f"{m}_flag")
        scores[f"{m}_flag"] = f"{m}_score"
    return outliers.vote(scratch.materialise(out), flags, scores, threshold)


def smart_outliers(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Run the method that ``outliers.choose_method`` picks; adds ``is_outlier`` and ``method``."""
    df = nan_to_null(df)
    names = [c for c in (columns or numeric_columns(df)) if c != key]
    m = outliers.choose_method(df, names)
    if m in ("iqr", "zscore", "modified_zscore"):
        out = outliers.statistical_union(df, names, [m]).drop("outlier_score")
    elif m == "grubbs":
        out = outliers.flag_rows(df, outliers.grubbs_outliers(df, names[0], [key]), [key])
    elif m == "mcd":
        out = robust_mahalanobis(df, names).drop("distance")
    elif m == "lof":
        out = df.join(local_outlier_factor(df, key, names).select(key, "is_outlier"), key, "left")
    else:
        out = isolation_forest(df, names).drop("score")
    return out.withColumn("method", F.lit(m))


def benchmark_outliers(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(method, n_outliers, rate) of the row-level methods."""
    voted = ensemble(df, key, columns)
    return outliers.agreement(voted, [c for c in voted.columns if c.endswith("_flag")])
