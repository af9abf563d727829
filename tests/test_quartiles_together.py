"""Quartiles and medians of the outlier report come from one search."""

from grainmark.operators import outliers


def test_two_searches_for_three_detectors(spark, monkeypatch):
    seen = []
    search = outliers.values.quantiles
    monkeypatch.setattr(outliers.values, "quantiles", lambda df, e, probs, *rest: seen.append(list(probs)) or search(df, e, probs, *rest))
    df = spark.range(300).selectExpr("CASE WHEN id % 60 = 0 THEN 1e4 ELSE CAST(id % 11 AS DOUBLE) END AS a", "CAST(NULL AS DOUBLE) AS b", "5.0D AS c")
    got = {(r["method"], r["column"]): r["n_outliers"] for r in outliers.outlier_report(df).collect()}
    assert seen == [[0.25, 0.5, 0.75], [0.5]]
    seen.clear()
    one = [outliers.fit_iqr(df), outliers.fit_zscore(df), outliers.fit_modified_zscore(df)]
    want = {(d.method, c): df.where(f).count() for d in one for c, f in d.flags.items()}
    assert got == want and got["iqr", "a"] == 5
