"""Distributed algorithms against brute force on small tables with hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmark.functions import special, values
from grainmark.operators import impute, outlier_models, outliers, resample, series, stats
from grainmark.operators.neighbours import knn


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    rng = np.random.default_rng(1)
    x = np.where(rng.random(3000) < 0.34, 7.0, np.round(rng.lognormal(1, 1, 3000), 3))
    y = np.round(rng.normal(size=3000) + 0.2 * x, 2)
    pdf = pd.DataFrame({"id": np.arange(3000), "x": x, "y": y, "g": rng.integers(0, 5, 3000)})
    return spark.createDataFrame(pdf), pdf


def test_quantiles_both_ways(skewed):
    df, pdf = skewed
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = {c: np.quantile(pdf[c], ps) for c in "xy"}
    for rows in (0, 10_000):
        got = values.quantiles(df, {c: F.col(c) for c in "xy"}, ps, small_rows=rows)
        for c in "xy":
            assert np.allclose(got[c], want[c], rtol=0, atol=1e-12)


def test_quantiles_of_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    for rows in (0, 10):
        assert values.quantiles(df, {"x": F.col("x")}, [0.5], small_rows=rows) == {"x": [None]}


def test_runs_give_exact_ranks(skewed):
    df, pdf = skewed
    got = values.value_runs(df.select(F.lit("x").alias("column"), F.col("x").alias("value")), ["column"]).toPandas()
    counts = pdf["x"].value_counts().sort_index()
    got = got.sort_values("value")
    assert (got["n"].to_numpy() == counts.to_numpy()).all()
    assert (got["below"].to_numpy() == counts.cumsum().shift(fill_value=0).to_numpy()).all()
    assert (got["total"] == 3000).all()


def test_positions(skewed):
    df, pdf = skewed
    got = values.with_position(df, ["x", "id"]).toPandas().sort_values("position")
    want = pdf.sort_values(["x", "id"])
    assert got["position"].tolist() == list(range(3000)) and got["id"].tolist() == want["id"].tolist()


def test_halo_blocks(spark):
    df = spark.range(100).withColumnRenamed("id", "position")
    got = values.blocks_with_halo(df, "position", 3, 2, rows=10).toPandas()
    for b, part in got.groupby("block"):
        assert sorted(part["position"]) == list(range(max(0, 10 * b - 3), min(100, 10 * b + 12)))[: len(part)] or b == 10
        assert sorted(part.loc[part["own"], "position"]) == [p for p in range(100) if p // 10 == b]


def test_group_medians_both_ways(skewed):
    df, pdf = skewed
    want = pdf.groupby("g")["x"].median()
    for rows in (0, 10_000):
        got = impute.group_medians(df, "g", ["x"], small_rows=rows).toPandas().set_index("g")["x"]
        assert np.allclose(got.sort_index(), want.sort_index())


def test_rank_statistics(skewed):
    df, pdf = skewed
    a, b = pdf["x"].rank(), pdf["y"].rank()
    got = stats.spearman(df, ["x", "y"]).first()
    assert got["r"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-10)
    xs = np.sort(pdf["x"])
    n = len(xs)
    g = 2 * (np.arange(1, n + 1) * xs).sum() / (n * xs.sum()) - (n + 1) / n
    assert stats.gini(df, ["x"]).first()["gini"] == pytest.approx(g, abs=1e-12)
    tm = stats.trimmed_means(df, ["x"]).first()
    assert tm["trimmed_mean"] == pytest.approx(xs[300:-300].mean(), abs=1e-10)
    w = np.clip(xs, xs[150], xs[-151])
    assert tm["winsorised_mean"] == pytest.approx(w.mean(), abs=1e-10)


def test_kendall(skewed):
    df, pdf = skewed
    part = pdf.head(400)
    sx = np.sign(part["x"].to_numpy()[:, None] - part["x"].to_numpy())
    sy = np.sign(part["y"].to_numpy()[:, None] - part["y"].to_numpy())
    want = (sx * sy).sum() / np.sqrt((sx * sx).sum() * (sy * sy).sum())
    got = stats.kendall(df.filter("id < 400"), "x", "y").first()
    assert got["tau"] == pytest.approx(want, abs=1e-12)


def _not_a_knot(x, y, at):
    """Dense solve for the interpolating cubic spline."""
    n = len(x)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = [h[i - 1], 2 * (h[i - 1] + h[i]), h[i]]
        r[i] = 6 * (s[i] - s[i - 1])
    a[0, :3] = [h[1], -(h[0] + h[1]), h[0]]
    a[-1, -3:] = [h[-1], -(h[-1] + h[-2]), h[-2]]
    m = np.linalg.solve(a, r)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, u = x[i + 1] - at, at - x[i]
    return (m[i] * t**3 + m[i + 1] * u**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * t + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * u


def test_spline_matches_dense_solve(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.cumsum(rng.normal(size=600))
    hole = rng.random(600) < 0.3
    hole[[0, 599]] = False
    pdf = pd.DataFrame({"t": np.arange(600), "v": np.where(hole, np.nan, v)})
    orig = values.blocks_with_halo
    monkeypatch.setattr(values, "blocks_with_halo", lambda *a, rows, **k: orig(*a, rows=100, **k))
    got = impute.impute_spline(spark.createDataFrame(pdf), ["t"], ["v"]).toPandas().sort_values("t")["v"].to_numpy()
    x = np.flatnonzero(~hole).astype(float)
    want = _not_a_knot(x, v[~hole], np.flatnonzero(hole).astype(float))
    assert np.allclose(got[hole], want, atol=1e-9)


def test_ordered_fills_across_blocks(skewed, monkeypatch):
    df, pdf = skewed
    gaps = df.withColumn("z", F.when(F.col("id") % 50 == 3, F.col("y")))
    want = pdf["y"].where(pdf["id"] % 50 == 3)
    got = impute.impute_ffill(gaps, ["id"], ["z"]).toPandas().sort_values("id")["z"]
    assert np.allclose(got, want.ffill().bfill())
    got = impute.impute_interpolate(gaps, ["id"], ["z"]).toPandas().sort_values("id")["z"]
    assert np.allclose(got, want.interpolate(limit_direction="both"))


@pytest.mark.parametrize("hot", [False, True])
def test_knn_is_exact(spark, hot):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3))
    if hot:
        x[:300] = x[0]
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=np.arange(900))
    got = knn(spark.createDataFrame(pdf), None, "id", ["a", "b", "c"], 6, cell_rows=60).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :6]
    have = got.sort_values(["lid", "place"])["dist"].to_numpy().reshape(900, 6)
    assert np.allclose(have, want, atol=1e-12)
    assert (got["lid"] != got["rid"]).all()


def test_sequential_outlier_tests(spark):
    rng = np.random.default_rng(7)
    x = np.append(rng.normal(size=200), [9.0, 8.0, -9.5])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(203), "x": x}))
    removed = [r["value"] for r in outliers.grubbs_outliers(df, "x", ["id"]).collect()]
    assert removed[:3] == [-9.5, 9.0, 8.0]
    steps = outliers.gesd_test(df, "x", ["id"]).collect()
    work = x.copy()
    for s in steps[:3]:
        dev = np.abs(work - work.mean()) / work.std(ddof=1)
        assert s["statistic"] == pytest.approx(dev.max(), rel=1e-10)
        work = np.delete(work, dev.argmax())


def test_special_functions():
    assert special.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert special.t_sf2(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-10)
    assert special.t_isf(0.025, 10) == pytest.approx(2.228138851964939, abs=1e-8)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert special.chi2_ppf(0.975, 3) == pytest.approx(9.348403604496145, abs=1e-8)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)


def test_shapiro_reference_value():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float)
    w, p = stats._shapiro(x)
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.00670, abs=0.0005)


def test_fisher():
    odds, p = stats.fisher([[8, 2], [1, 5]])
    assert odds == pytest.approx(20.0) and p == pytest.approx(0.03496503496503495, abs=1e-10)


def test_robust_distance_finds_planted_rows(spark):
    rng = np.random.default_rng(11)
    x = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 500)
    x[:10] = [4, -4]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=np.arange(500)))
    for out in (outlier_models.robust_mahalanobis(df, ["a", "b"]), outlier_models.isolation_forest(df, ["a", "b"], trees=25)):
        flagged = {r["id"] for r in out.filter("is_outlier").collect()}
        assert set(range(10)) <= flagged


def test_smote_balances(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"id": np.arange(120), "a": rng.normal(size=120), "b": rng.normal(size=120), "y": [1] * 20 + [0] * 100})
    out = resample.smote(spark.createDataFrame(pdf), "y", "id", ["a", "b"]).toPandas()
    assert out["y"].value_counts().to_dict() == {0: 100, 1: 100}
    made = out[out["synthetic"]]
    low, high = pdf[pdf["y"] == 1][["a", "b"]].min(), pdf[pdf["y"] == 1][["a", "b"]].max()
    assert (made[["a", "b"]] >= low - 1e-9).all().all() and (made[["a", "b"]] <= high + 1e-9).all().all()


def test_fit_finds_the_family(spark):
    rng = np.random.default_rng(17)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.exponential(3.0, 2000)}))
    top = [r["distribution"] for r in series.fit_distributions(df, "x", rounds=5).orderBy("rank").limit(6).collect()]
    assert {"expon", "weibull_min", "gamma", "exponweib"} & set(top[:4])


def test_random_walk_is_not_stationary(spark):
    rng = np.random.default_rng(19)
    walk = spark.createDataFrame(pd.DataFrame({"t": np.arange(400), "x": np.cumsum(rng.normal(size=400))}))
    noise = spark.createDataFrame(pd.DataFrame({"t": np.arange(400), "x": rng.normal(size=400)}))
    assert series.stationarity(walk, "x", ["t"]).first()["verdict"] != "stationary"
    assert series.stationarity(noise, "x", ["t"]).first()["verdict"] == "stationary"
