"""Neighbours of hot, gappy and high-dimensional rows, and what is built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from grainmark.operators import automl, impute_models, neighbours
from grainmark.operators.knn_models import KNeighbors
from grainmark.operators.neighbours import knn, nearest


def distances(pdf, names, got, k, n):
    x = pdf[names].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :k]
    have = got.sort_values(["lid", "place"])["dist"].to_numpy().reshape(n, k)
    assert np.allclose(have, want, atol=1e-9)


@pytest.mark.parametrize("width", [2, 14])
def test_nineteen_twentieths_in_one_cell(spark, width, monkeypatch):
    """A bounded sample that misses a dense spot: its cell is sampled again; tasks stay small."""
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    rng = np.random.default_rng(1)
    n = 3_000
    x = rng.normal(size=(n, width)) * 100
    dense = rng.random(n) < 0.95
    x[dense] = rng.normal(size=(dense.sum(), width)) * 0.01
    x[:300] = x[0]  # and rows that nothing can cut
    names = [f"f{j}" for j in range(width)]
    pdf = pd.DataFrame(x, columns=names).assign(id=np.arange(n))
    seen = []
    keep = neighbours._indexed
    monkeypatch.setattr(neighbours, "_indexed", lambda *a: seen.append(keep(*a)) or seen[-1])
    got = knn(spark.createDataFrame(pdf), None, "id", names, 4, cell_rows=50, part_rows=100).toPandas()
    distances(pdf, names, got, 4, n)
    placed, cells = seen[0]
    assert cells.rows.sum() == n and (np.ceil(cells.rows / cells.parts) <= 100).all()
    assert len(cells.rows) > 20 and (cells.centre is not None) == (width > 10)
    part = placed.join(spark.createDataFrame(list(enumerate(cells.parts.tolist())), "cell int, p int"), "cell")
    load = part.groupBy("cell", F.pmod(F.xxhash64("rid"), "p")).count().agg(F.max("count")).first()[0]
    assert load <= 250  # 100 rows a part as planned, up to chance


def partial(q, x, text, scale):
    w = np.where(text, q != x, (q - x) / scale) * 1.0
    w[np.isnan(q) | np.isnan(x)] = np.nan
    common = (~np.isnan(w)).sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, np.sqrt(np.nansum(w * w, axis=-1) * (len(text) / np.maximum(common, 1))), np.inf)


def test_gaps_in_every_row(spark):
    rng = np.random.default_rng(2)
    n, text = 700, np.array([False, False, False, True, True])
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n) * 50, rng.exponential(size=n), rng.integers(0, 4, n), rng.integers(0, 40, n)]).astype(float)
    x[rng.random((n, 5)) < 0.25] = np.nan
    x[np.arange(n), rng.integers(0, 5, n)] = np.nan
    scale = np.array([[1.0, 50.0, 2.0, 1.0, 1.0]] * 5) * np.array([1.0, 1.5, 1.0, 1.0, 1.0])
    rows = [(i, [None if np.isnan(c) else float(c) for c in r]) for i, r in enumerate(x)]
    have = spark.createDataFrame(rows, "rid long, v array<double>")
    ask = have.select(F.col("rid").alias("lid"), "v", F.explode(F.array(F.lit(0), F.lit(3))).alias("target")).where("v[target] is null and exists(v, c -> c is not null)")
    got = nearest(ask, have, 3, True, text.tolist(), scale, cell_rows=20).toPandas()
    want = 0
    for t in (0, 3):
        for i in np.flatnonzero(np.isnan(x[:, t]) & ~np.isnan(x).all(axis=1)):
            d = partial(x[i], x, text, scale[t])
            d[np.isnan(x[:, t])] = np.inf
            d[i] = np.inf
            best = np.sort(d)[:3]
            best = best[np.isfinite(best)]
            mine = got[(got["lid"] == i) & (got["target"] == t)].sort_values("place")
            assert np.allclose(mine["dist"], best, atol=1e-9)
            assert (mine["value"].to_numpy() == x[mine["rid"], t]).all()
            want += len(best)
    assert len(got) == want


def test_imputing_rows_that_all_have_gaps(spark):
    rng = np.random.default_rng(3)
    n = 240
    a = rng.normal(size=n)
    g = np.where(a > 0, "up", "down")
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": 3 * a + rng.normal(size=n) * 0.01, "c": -a + rng.normal(size=n) * 0.01, "g": g})
    for k, c in enumerate(["a", "b", "c", "g"]):
        pdf[c] = pdf[c].astype(object).where(pdf["id"] % 4 != k, None)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), "id long, a double, b double, c double, g string")
    done = impute_models.impute_knn(df, "id").toPandas().sort_values("id")
    assert done.notna().all().all()
    x = np.column_stack([pdf[["a", "b", "c"]].astype(float), pdf["g"].map({"up": 1.0, "down": 2.0})])
    for t, c in enumerate(["a", "b", "c"]):
        donors = ~np.isnan(x[:, t])
        scale = np.append(np.nanstd(x[donors, :3], axis=0), 1.0)
        for i in np.flatnonzero(~donors):
            d = partial(x[i], x, np.array([False, False, False, True]), scale)
            d[~donors] = np.inf
            best = np.argsort(d)[:5]
            assert done[c].iloc[i] == pytest.approx((x[best, t] / d[best]).sum() / (1 / d[best]).sum())
    clear = np.abs(a) > 0.2
    assert (done["g"].to_numpy() == g)[clear].all()


def test_neighbour_models(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] > 0).astype(float) + (x[:, 1] > 1)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(label=y, id=np.arange(400))
    df = spark.createDataFrame(pdf).withColumn("features", array_to_vector(F.array("a", "b", "c")))
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    t, q = pdf["id"] % 4 != 0, pdf["id"] % 4 == 0
    d = np.sqrt(((x[q][:, None] - x[t][None]) ** 2).sum(-1))
    order = np.argsort(d, axis=1)[:, :7]
    near, far = y[t][order], np.take_along_axis(d, order, axis=1)
    mean = KNeighbors("regression", k=7).fit(train).transform(test).orderBy("id").toPandas()["prediction"]
    assert np.allclose(mean, near.mean(axis=1))
    mean = KNeighbors("regression", k=7, weights="distance").fit(train).transform(test).orderBy("id").toPandas()["prediction"]
    assert np.allclose(mean, (near / far).sum(axis=1) / (1 / far).sum(axis=1))
    told = KNeighbors("classification", k=7).fit(train).transform(test).orderBy("id")
    votes = np.stack([(near == c).mean(axis=1) for c in range(3)], axis=1)
    assert np.allclose(np.stack([r["probability"].toArray() for r in told.collect()]), votes)
    assert (told.toPandas()["prediction"].to_numpy() == votes.argmax(axis=1)).all()
    own = KNeighbors("classification", k=7, weights="distance").fit(train).transform(train).where("prediction <> label")
    assert own.isEmpty()  # a row at distance 0 outweighs all others


def test_neighbours_in_catalog_and_pipeline(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": np.arange(200), "a": rng.normal(size=200), "g": ["x", "y"] * 100}).assign(t=lambda p: p["a"] * 2)
    df = spark.createDataFrame(pdf)
    model = automl.build_pipeline(df.drop("id"), "t", "knn").fit(df)
    out = model.transform(df)
    assert out.count() == 200 and out.where("prediction is null").isEmpty()
    assert out.stat.corr("prediction", "t") > 0.95
    prep = automl.prepare(df, "t", ["a"], keep=["id"])
    cv = automl.cross_validate(prep, "knn", ["id"], 2, params={"k": 3})
    assert cv.count() == 2 and cv.where("score < 0.9").isEmpty()
    assert {"regression", "classification"} == {r["task"] for r in automl.catalog(spark).where("model = 'knn'").collect()}
