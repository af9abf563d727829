"""Differences between a baseline table and a current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.columns import col, count_if, frame, nan_to_null, number, numeric_columns, ratio, report, text_columns, union_all

ISSUE = "column string, issue string, before string, after string"


def _side(df: DataFrame, names: list[str], nums: set[str]) -> DataFrame:
    none = F.lit(None).cast("double")
    return report(
        df,
        {
            c: {
                "null_rate": ratio(count_if(col(c).isNull()), F.count(F.lit(1))),
                **{
                    m: f(number(c)) if c in nums else f(none)
                    for m, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
                },
            }
            for c in names
        },
    )


def _issue(kind: str, before: Column, after: Column, when: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("issue"), before.cast("double").alias("before"), after.cast("double").alias("after")
        ),
    )


def numeric_drift(
    baseline: DataFrame, current: DataFrame, mean_threshold: float = 0.1, missing_threshold: float = 0.05
) -> DataFrame:
    """(column, issue, before, after) for null rates of all shared columns and
    mean, spread and range of the numeric ones; one pass per side."""
    baseline, current = nan_to_null(baseline), nan_to_null(current)
    names = [c for c in baseline.columns if c in current.columns]
    nums = set(numeric_columns(baseline)) & set(numeric_columns(current))
    b = _side(baseline, names, nums)
    c = _side(current, names, nums)
    both = b.alias("b").join(F.broadcast(c).alias("c"), "column")  # one row per column
    pick = lambda m: (F.col(f"b.{m}"), F.col(f"c.{m}"))
    b0, c0 = pick("null_rate")
    bm, cm = pick("mean")
    bs, cs = pick("std")
    bl, cl = pick("min")
    bh, ch = pick("max")
    issues = F.array_compact(
        F.array(
            _issue("missing_rate", b0, c0, F.abs(c0 - b0) >= missing_threshold),
            _issue("mean_shift", bm, cm, ratio(F.abs(cm - bm), F.abs(bm)) >= mean_threshold),
            _issue("std_shift", bs, cs, ratio(F.abs(cs - bs), F.abs(bs)) >= 0.25),
            _issue("new_minimum", bl, cl, cl < bl),
            _issue("new_maximum", bh, ch, ch > bh),
        )
    )
    return both.select("column", F.inline(issues))


def categories(df: DataFrame, names: list[str]) -> DataFrame:
    return (
        values.value_counts(df, names)
        .filter(values.has_value())
        .select("column", values.value_text(df, names).alias("value"), "n")
    )


def categorical_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(column, issue, value): new and missing categories and a changed top value.

    Only counts per category travel; a full outer join on (column, value)
    answers both directions at once.
    """
    baseline, current = nan_to_null(baseline), nan_to_null(current)
    names = [c for c in text_columns(baseline) if c in text_columns(current)]
    if not names:
        return baseline.sparkSession.createDataFrame([], "column string, issue string, value string")
    b = categories(baseline, names).withColumnRenamed("n", "nb")
    c = categories(current, names).withColumnRenamed("n", "nc")
    both = b.join(c, ["column", "value"], "full")
    moved = both.filter("nb is null or nc is null").select(
        "column",
        F.when(F.col("nb").isNull(), "new_category").otherwise("missing_category").alias("issue"),
        "value",
    )
    tops = both.groupBy("column").agg(
        F.min(F.when(F.col("nb").isNotNull(), F.struct(-F.col("nb"), "value")))["value"].alias("tb"),
        F.min(F.when(F.col("nc").isNotNull(), F.struct(-F.col("nc"), "value")))["value"].alias("tc"),
    )
    changed = tops.filter(F.col("tb") != F.col("tc")).select(
        "column", F.lit("top_category").alias("issue"), F.col("tc").alias("value")
    )
    return moved.unionByName(changed)


def schema_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    b, c = baseline.columns, current.columns
    rows = [(x, "column_added") for x in c if x not in b] + [(x, "column_removed") for x in b if x not in c]
    return frame(baseline.sparkSession, rows, "column string, issue string")


def detect_drift(
    baseline: DataFrame, current: DataFrame, mean_threshold: float = 0.1, missing_threshold: float = 0.05
) -> DataFrame:
    """(column, n_issues, severity) of every drifted column; schema changes are one entry each way."""
    num = numeric_drift(baseline, current, mean_threshold, missing_threshold).select("column", "issue")
    # many new categories are one issue of their column
    cat = categorical_drift(baseline, current).select("column", "issue").distinct()
    per = num.unionByName(cat).groupBy("column").agg(F.count(F.lit(1)).alias("n_issues"))
    n = F.col("n_issues")
    per = per.withColumn("severity", F.when(n >= 3, "high").when(n == 2, "medium").otherwise("low"))
    changed = schema_drift(baseline, current).select(F.col("issue").alias("kind")).distinct()
    extra = changed.select(
        F.concat(F.lit("schema:"), "kind").alias("column"), F.lit(1).cast("long").alias("n_issues"), F.lit("high").alias("severity")
    )
    return union_all([per, extra])


def drift_verdict(drifted: DataFrame, n_shared: int) -> DataFrame:
    """One row: drifted columns and overall severity."""
    agg = drifted.agg(
        F.count(F.lit(1)).alias("n_drifted"), count_if(F.col("severity") == "high").alias("n_high")
    )
    n, h = F.col("n_drifted"), F.col("n_high")
    severity = (
        F.when(n == 0, "none")
        .when((h >= 2) | (n >= n_shared * 0.5), "high")
        .when((h == 1) | (n >= 2), "medium")
        .otherwise("low")
    )
    return agg.withColumn("severity", severity)
