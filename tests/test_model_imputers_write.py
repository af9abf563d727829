from pyspark.sql import functions as F

from grainmark.functions import scratch
from grainmark.operators import impute_models


def test_each_filled_column_is_written(spark, monkeypatch):
    """The fits of a column read the columns filled before it, not the models that filled them."""
    df = spark.range(400).select(
        "id",
        F.when(F.col("id") % 5 != 0, F.col("id") * 2.0).alias("a"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 3.0).alias("b"),
        F.when(F.col("id") % 3 != 0, F.col("id") * 5.0).alias("c"),
    )
    seen = []
    real = scratch.materialise
    monkeypatch.setattr(scratch, "materialise", lambda d: seen.append(d) or real(d))
    out = impute_models.impute_mice(df, ["a", "b", "c"], rounds=1)
    assert len(seen) == 1 + 3  # the start, and one for each column
    assert out.filter("a is null or b is null or c is null").count() == 0 and out.count() == 400
