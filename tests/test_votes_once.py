"""Models are fitted on written rows, and equal rows are voted on once."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from grainmark.operators import automl, knn_models


def test_equal_rows_are_searched_once(spark, monkeypatch):
    asked = []
    search = knn_models.nearest
    monkeypatch.setattr(knn_models, "nearest", lambda ask, *rest: asked.append(ask.count()) or search(ask, *rest))
    df = spark.range(60).select("id", array_to_vector(F.array((F.col("id") % 4).cast("double"))).alias("features"), (F.col("id") % 4).cast("double").alias("label"))
    model = knn_models.KNeighbors("classification", k=3).fit(df)
    got = model.transform(df)
    assert got.columns == ["id", "features", "label", "prediction", "probability"]
    assert {r["id"]: r["prediction"] for r in got.collect()} == {i: float(i % 4) for i in range(60)}
    assert asked == [4]


def test_prepared_rows_are_written(spark):
    df = spark.range(40).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id * 1.5 AS DOUBLE) AS y")
    prep = automl.prepare(df, "y", ["a"], keep=["id"])
    assert hasattr(prep.df, "_grainmark_path") and prep.df.count() == 40
