"""SMOTE writes the rows it works on once; the classes, neighbours and new rows are read off that."""

from pyspark.sql import functions as F

from grainmark.operators import resample


def test_no_part_of_the_result_reads_the_source_again(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(60).select("id", (F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") % 5 == 0).cast("int").alias("y")).write.parquet(source)
    out = resample.smote(spark.read.parquet(source), "y", "id")
    assert not [f for f in out.inputFiles() if source in f]
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 48, 1: 48}
