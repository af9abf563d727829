"""Structured questions over one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, corr, nan_to_null, number, numeric_columns
from . import profile

AGGREGATES = {
    "mean": F.avg,
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "count": F.count,
    "std": F.stddev_samp,
}


@dataclass
class Question:
    intent: str  # filter, aggregate, sort, describe or compare
    columns: Sequence[str] = ()
    conditions: Sequence[tuple[str, str, object]] = field(default_factory=tuple)
    aggregation: str | None = None
    group_by: str | None = None
    order_by: str | None = None
    ascending: bool = True
    limit: int = 10
    tie: Sequence[str] = ()


def where(df: DataFrame, conditions: Sequence[tuple[str, str, object]]) -> DataFrame:
    """All conditions must hold: > and < compare as numbers, == as text."""
    for name, op, value in conditions:
        if op in (">", "<"):
            x = number(name) if name in numeric_columns(df) else col(name).try_cast("double")
            df = df.filter(x > float(value) if op == ">" else x < float(value))
        elif op == "==":
            if isinstance(value, (int, float)) and name in numeric_columns(df):
                df = df.filter(col(name) == value)  # pushed down to the scan
            else:
                df = df.filter(F.lower(col(name).cast("string")) == str(value).lower())
        else:
            raise ValueError(f"unknown comparison: {op}")
    return df


def aggregate(df: DataFrame, column: str, how: str, conditions=()) -> DataFrame:
    out = where(nan_to_null(df), conditions)
    x = number(column) if how != "count" else col(column)
    return out.agg(AGGREGATES[how](x).alias("value"))


def group_aggregate(df: DataFrame, group_by: str, column: str, how: str, conditions=(), limit: int = 5) -> DataFrame:
    out = where(nan_to_null(df), conditions).filter(col(group_by).isNotNull())
    x = number(column) if how != "count" else col(column)
    return (
        out.groupBy(col(group_by).alias("group"))
        .agg(F.round(AGGREGATES[how](x), 4).alias("value"))
        .orderBy(F.desc("value"), "group")
        .limit(limit)
    )


def sort(df: DataFrame, by: str, ascending: bool = True, limit: int = 10, tie: Sequence[str] = (), conditions=()) -> DataFrame:
    key = col(by).asc_nulls_last() if ascending else col(by).desc_nulls_last()
    return where(df, conditions).orderBy(key, *[col(t) for t in tie]).limit(limit)


def describe(df: DataFrame, column: str) -> DataFrame:
    """Numeric: mean, std, min, max, median. Text: five commonest values."""
    df = nan_to_null(df)
    if column in numeric_columns(df):
        from ..functions import values

        mid = values.quantiles(df, {"m": number(column)}, [0.5])["m"][0]
        x = number(column)
        return df.agg(
            F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
        ).withColumn("median", F.lit(mid).cast("double"))
    return profile.value_counts(df, column, 5)


def compare(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson r of two numeric columns with a strength word, sign and both means."""
    df = nan_to_null(df)
    out = df.agg(
        corr(number(a), number(b)).alias("r"), F.avg(number(a)).alias("mean_a"), F.avg(number(b)).alias("mean_b")
    )
    r = F.col("r")
    return out.select(
        "r",
        F.when(F.abs(r) > 0.7, "strong").when(F.abs(r) > 0.4, "moderate").otherwise("weak").alias("strength"),
        F.when(r > 0, "positive").otherwise("negative").alias("direction"),
        "mean_a",
        "mean_b",
    )


def missing(df: DataFrame) -> DataFrame:
    return profile.missing_values(df).filter("n_missing > 0")


def unique(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return df.select(col(column).alias("value")).filter("value is not null").distinct().orderBy("value").limit(limit)


def overview(df: DataFrame) -> DataFrame:
    return profile.dataset_stats(df).select("n_rows", "n_columns", "null_cells")


def answer(df: DataFrame, q: Question) -> DataFrame:
    if q.intent == "filter":
        return where(df, q.conditions).limit(q.limit)
    if q.intent == "aggregate":
        if q.group_by:
            return group_aggregate(df, q.group_by, q.columns[0], q.aggregation or "mean", q.conditions)
        return aggregate(df, q.columns[0], q.aggregation or "mean", q.conditions)
    if q.intent == "sort":
        return sort(df, q.order_by or q.columns[0], q.ascending, q.limit, q.tie, q.conditions)
    if q.intent == "describe":
        return describe(df, q.columns[0]) if q.columns else overview(df)
    if q.intent == "compare":
        return compare(df, q.columns[0], q.columns[1])
    raise ValueError(f"unknown intent: {q.intent}")
