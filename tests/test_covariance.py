"""Robust covariance: several starts on a sample, states of all rows merged in one scan."""

from __future__ import annotations

import numpy as np
import pytest

from grainmark.operators import outlier_models


def _frame(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))


def test_a_planted_cluster_of_thirty_per_cent_is_found(spark):
    """The cluster is tight and lies off the main direction, so medians and MADs alone are drawn to it."""
    rng = np.random.default_rng(1)
    main = rng.multivariate_normal([0, 0, 0], [[4, 3.8, 0], [3.8, 4, 0], [0, 0, 1]], 2800)
    planted = rng.normal(0, 0.2, (1200, 3)) + [4, -4, 5]
    df = _frame(spark, np.vstack([main, planted]))
    names, center, cov = outlier_models.fit_mcd(df, ["x0", "x1", "x2"], support=0.6)
    assert np.abs(center).max() < 0.2 and cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]) > 0.9
    out = outlier_models.robust_mahalanobis(df, fit=(names, center, cov))
    got = {bool(r["is_outlier"]) for r in out.where("id >= 2800").collect()}
    assert got == {True}
    assert out.where("id < 2800 AND is_outlier").count() < 0.06 * 2800


def test_states_equal_one_table(spark):
    """Merged moments of every fit equal numpy's over all rows within its cut."""
    x = np.random.default_rng(2).normal(1e6, [1, 1e-3], (500, 2))
    rows = _frame(spark, x).select("x0", "x1").repartition(7)
    fits = [(x.mean(axis=0), np.cov(x.T)), (x[0], np.diag([4.0, 1e-6]))]
    for (n, center, cov), fit, cut in zip(outlier_models._moments(rows, fits, [1.5, 2.0], np.median(x, axis=0)), fits, [1.5, 2.0]):
        near = x[outlier_models._squared(x, fit[0], np.linalg.inv(fit[1])) <= cut]
        assert n == len(near)
        assert center == pytest.approx(near.mean(axis=0), rel=1e-12)
        assert cov == pytest.approx(np.cov(near.T, bias=True), rel=1e-6)


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(1.0, 2.0)] * 9, [(1.0, None), (None, 2.0)], [(float(i), 5.0) for i in range(40)]])
def test_few_equal_and_missing_rows(spark, rows):
    """No complete row, one row, equal rows, a constant column: finite results, nothing far from itself."""
    df = spark.createDataFrame(rows, "x0 double, x1 double")
    _, center, cov = outlier_models.fit_mcd(df)
    assert np.isfinite(center).all() and np.isfinite(cov).all()
    assert outlier_models.robust_mahalanobis(df).count() == len(rows)


def test_the_distance_does_not_depend_on_units(spark):
    x = np.random.default_rng(3).normal(size=(400, 2))
    far = [outlier_models.robust_mahalanobis(_frame(spark, x * unit), ["x0", "x1"]).orderBy("id").toPandas()["distance"] for unit in (1.0, [1e9, 1e-9])]
    assert far[0].to_numpy() == pytest.approx(far[1].to_numpy(), rel=1e-6)
