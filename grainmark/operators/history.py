"""Snapshots of table checks over time, kept as an append-only Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scratch
from ..functions.columns import union_all
from . import advise, profile

MEASURES = ["n_rows", "n_columns", "n_missing", "n_duplicates", "ml_score", "outlier_columns"]
SCHEMA = (
    "file_hash string, file_path string, file_name string, taken_at timestamp, n_rows long, n_columns long, "
    "n_missing long, n_duplicates long, ml_score long, outlier_columns long, detail string"
)


def snapshot(df: DataFrame, path: str, taken_at: str | None = None) -> DataFrame:
    """One row that describes the table now."""
    stats = profile.dataset_stats(df)
    ready = advise.readiness_grade(advise.ml_readiness(df)).select(F.col("score").alias("ml_score"), "grade")
    out = profile.iqr_outlier_report(df).agg(F.count(F.lit(1)).alias("outlier_columns"))
    one = stats.crossJoin(ready).crossJoin(out)  # three one-row results
    when = F.lit(taken_at).cast("timestamp") if taken_at else F.current_timestamp()
    return one.select(
        F.md5(F.lit(path)).alias("file_hash"),
        F.lit(path).alias("file_path"),
        F.lit(path.replace("\\", "/").rsplit("/", 1)[-1]).alias("file_name"),
        when.alias("taken_at"),
        "n_rows",
        "n_columns",
        F.col("null_cells").alias("n_missing"),
        "n_duplicates",
        F.col("ml_score").cast("long").alias("ml_score"),
        "outlier_columns",
        F.to_json(F.struct("grade", "null_rate", "numeric_columns", "text_columns")).alias("detail"),
    )


def save_snapshot(df: DataFrame, path: str, store: str, taken_at: str | None = None) -> None:
    snapshot(df, path, taken_at).write.mode("append").parquet(store)


def load(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(store)


def history(snaps: DataFrame, path: str, limit: int = 10) -> DataFrame:
    """The latest snapshots of one file, newest first."""
    return snaps.filter(F.col("file_hash") == F.md5(F.lit(path))).orderBy(F.desc("taken_at")).limit(limit)


def compare_last_two(snaps: DataFrame, path: str | None = None) -> DataFrame:
    """(file_name, measure, old, new, delta, improved) for the newest pair of every file."""
    if path is not None:
        snaps = snaps.filter(F.col("file_hash") == F.md5(F.lit(path)))
    w = Window.partitionBy("file_hash").orderBy(F.desc("taken_at"))
    cols = [F.lead(m).over(w).alias(f"old_{m}") for m in MEASURES]
    last = snaps.select("*", F.row_number().over(w).alias("place"), *cols).filter("place = 1 and old_n_rows is not null")
    cells = [
        F.struct(
            F.lit(m).alias("measure"),
            F.col(f"old_{m}").alias("old"),
            F.col(m).alias("new"),
            (F.col(m) - F.col(f"old_{m}")).alias("delta"),
            (F.col(m) > F.col(f"old_{m}") if m == "ml_score" else F.col(m) < F.col(f"old_{m}")).alias("improved"),
        )
        for m in MEASURES
    ]
    return last.select("file_name", F.inline(F.array(*cells)))


def all_files(snaps: DataFrame) -> DataFrame:
    return snaps.groupBy("file_hash").agg(
        F.max_by("file_name", "taken_at").alias("file_name"),
        F.count(F.lit(1)).alias("n_inspections"),
        F.max("taken_at").alias("last_seen"),
        F.max("ml_score").alias("best_score"),
    )


def clear_history(spark: SparkSession, store: str, path: str | None = None) -> int:
    """Remove one file's snapshots, or all; returns how many went."""
    snaps = load(spark, store)
    keep = snaps.filter(F.col("file_hash") != F.md5(F.lit(path))) if path else snaps.filter(F.lit(False))
    before = snaps.count()
    kept = scratch.materialise(keep)
    left = kept.count()
    scratch.swap_in(kept, store)
    return before - left


def merge(stores: list[DataFrame]) -> DataFrame:
    return union_all(stores)
