"""impute_gbt on large tables: rows of the same bins are counted once and learnt from as one weighted row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from grainmark.operators import impute_models


@pytest.fixture
def fitted(monkeypatch):
    """Rows that each fit of a tree learner was given."""
    seen = []
    for kind in (GBTRegressor, RandomForestClassifier):
        keep = kind._fit
        monkeypatch.setattr(kind, "_fit", lambda self, data, keep=keep: seen.append(data.count()) or keep(self, data))
    return seen


def frame(n, seed=3):
    rng = np.random.default_rng(seed)
    a, b, t = rng.integers(0, 9, n) * 1.5, rng.integers(0, 5, n), rng.choice(["p", "q", "r"], n)
    return pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "t": t, "y": a * 3 + (t == "q") * 10 - b + rng.normal(size=n)})


def test_numbers_are_filled_as_from_all_rows(spark, monkeypatch, fitted):
    pdf = frame(4_000)
    pdf["y"] = pdf["y"].mask(pdf["id"] % 7 == 0)
    df = spark.createDataFrame(pdf).select("id", "a", "b", "t", F.expr("CASE WHEN NOT isnan(y) THEN y END").alias("y"))
    fill = lambda: impute_models.impute_gbt(df, ["a", "b", "t", "y"], trees=5).orderBy("id").toPandas()["y"].to_numpy()
    whole = fill()
    assert fitted == [3_428]
    monkeypatch.setattr(impute_models, "CELLS_FROM", 10, raising=False)
    got = fill()
    assert fitted[1:] == [9 * 5 * 3]
    assert np.allclose(got, whole, rtol=0, atol=1e-9)


def test_text_and_wide_numbers(spark, monkeypatch, fitted):
    monkeypatch.setattr(impute_models, "CELLS_FROM", 10, raising=False)
    pdf = frame(12_000).drop(columns=["a", "b"])
    truth = pdf["t"].copy()
    rng = np.random.default_rng(1)
    pdf["x"] = np.select([truth == "p", truth == "q"], [0.0, 50.0], 100.0) + rng.random(len(pdf)) * 40  # a value for every row
    pdf["s"] = rng.choice(["u", "v"], len(pdf))
    gone = pdf["id"] % 5 == 0
    pdf["t"] = truth.mask(gone, None)
    df = spark.createDataFrame(pdf, "id long, t string, y double, x double, s string").drop("y")
    got = impute_models.impute_gbt(df, ["t", "x", "s"], trees=3).orderBy("id").toPandas()
    assert (got["t"][~gone] == truth[~gone]).all() and (got["t"][gone] == truth[gone]).mean() > 0.98
    assert len(fitted) == 3 and max(fitted) <= 128 * 2 * 3 and (got["x"] == pdf["x"]).all()


def test_many_cells_are_learnt_from_as_rows(spark, monkeypatch, fitted):
    monkeypatch.setattr(impute_models, "CELLS_FROM", 10, raising=False)
    rng = np.random.default_rng(2)
    x = rng.random((2_000, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["y"] = np.where(np.arange(2_000) % 4 == 0, np.nan, x.sum(axis=1))
    got = impute_models.impute_gbt(spark.createDataFrame(pdf), trees=5).toPandas()
    assert fitted == [1_500] and got.notna().all().all()
    assert np.abs(got["y"] - got[["a", "b", "c"]].sum(axis=1)).mean() < 0.3


def test_bins_of_columns(spark):
    df = spark.createDataFrame([(float(i % 3), float(i), None) for i in range(1_000)], "a double, b double, c double")
    cuts = impute_models._cuts(df, ["a", "b", "c"])
    assert cuts["a"] == [0.5, 1.5] and 120 <= len(cuts["b"]) < 128 and "c" not in cuts
    n = impute_models._binned(df, {"b": cuts["b"]}).groupBy("__b_b").count().toPandas()["count"]
    assert n.sum() == 1_000 and n.max() <= 12
