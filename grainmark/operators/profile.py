"""Profiling: shapes, missing cells, duplicates, statistics, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digests, values
from ..functions.columns import (
    col,
    corr,
    count_if,
    kinds,
    nan_to_null,
    number,
    numeric_columns,
    of_kind,
    one_row,
    ratio,
    report,
    union_all,
)


def row_key(df: DataFrame) -> list[Column]:
    """Every column in a form that can be grouped (maps become JSON text)."""
    return [
        F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, T.MapType) else col(f.name)
        for f in df.schema.fields
    ]


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def missing_values(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    return report(df, {c: {"n_missing": count_if(col(c).isNull())} for c in df.columns})


def null_rates(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    out = report(
        df,
        {c: {"n_missing": count_if(col(c).isNull()), "n_rows": F.count(F.lit(1))} for c in df.columns},
    )
    rate = ratio(F.col("n_missing"), F.col("n_rows"))
    return out.select("column", rate.alias("null_rate")).orderBy(F.desc("null_rate"), "column")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies beyond the first; digests of equal rows meet map-side before the exchange."""
    return digests.repeated(nan_to_null(df)).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def list_duplicates(df: DataFrame) -> DataFrame:
    """Each row that occurs several times with its number of copies; other rows, unless narrow, are not exchanged."""
    df = nan_to_null(df)
    rows = df
    if not digests.narrow(df):
        marked = digests.may_repeat(df)
        rows = df.limit(0) if marked is None else marked.where("__may").select(*[col(c) for c in df.columns])
    return rows.groupBy(*row_key(df)).agg(F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")


def basic_stats(df: DataFrame) -> DataFrame:
    """Per column: distinct, present, range and mean, or the commonest text.

    Every figure is read off the value counts.
    """
    df = nan_to_null(df)
    return _stats(df, values.value_summary(df))


def _stats(df: DataFrame, s: DataFrame) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for c, k in kinds(df).items() for x in (c, k)])
    is_num = F.col("kind") == "numeric"
    empty = F.col("n_distinct") == 0
    s = s.withColumn("kind", F.element_at(kind, F.col("column")))
    return s.select(
        "column",
        F.when(empty, "unknown").when(is_num, "numeric").otherwise("text").alias("kind"),
        "n_distinct",
        (F.col("n_rows") - F.col("n_missing")).alias("n_present"),
        F.when(is_num, F.col("min")).alias("min"),
        F.when(is_num, F.col("max")).alias("max"),
        F.when(is_num, F.col("mean")).alias("mean"),
        F.when(~is_num & ~empty, values.value_text(df)).alias("most_common"),
    )


def fences(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> dict[str, tuple[float, float, float]]:
    """Lower fence, upper fence and IQR per numeric column with data."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    q = values.quantiles(df, {c: number(c) for c in names}, [0.25, 0.75])
    return {
        c: (lo - k * (hi - lo), hi + k * (hi - lo), hi - lo) for c, (lo, hi) in q.items() if lo is not None
    }


def iqr_outlier_report(df: DataFrame, k: float = 1.5) -> DataFrame:
    """Columns that hold values outside their IQR fences."""
    lim = fences(df, k=k)
    out = report(
        df,
        {
            c: {
                "n_outliers": count_if((number(c) < lo) | (number(c) > hi)),
                "lower": F.lit(lo).cast("double"),
                "upper": F.lit(hi).cast("double"),
            }
            for c, (lo, hi, _) in lim.items()
        }
        or {"": {"n_outliers": F.lit(0).cast("long"), "lower": F.lit(0.0), "upper": F.lit(0.0)}},
    )
    return out.filter("n_outliers > 0")


def example_outliers(df: DataFrame, order: Sequence[str], limit: int = 100, k: float = 1.5) -> DataFrame:
    """The first ``limit`` outlying values of each column in the given order."""
    lim = fences(df, k=k)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.when((number(c) < lo) | (number(c) > hi), number(c)).alias("value"),
            )
            for c, (lo, hi, _) in lim.items()
        ]
    )
    keyed = df.select(*[col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.inline(cells)).filter(
        F.col("value").isNotNull()
    )
    w = Window.partitionBy("column").orderBy(*[f"__o{i}" for i in range(len(order))])
    return (
        keyed.withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= limit)
        .select("column", F.col("place").cast("long"), "value")
    )


def column_summary(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Type, null percentage, distinct count and commonest value of every column (of the first ``limit``)."""
    df = nan_to_null(df)
    names = df.columns[:limit]
    dtype = F.create_map(*[F.lit(x) for c in names for x in (c, df.schema[c].dataType.simpleString())])
    s = values.value_summary(df, names)
    return s.select(
        "column",
        F.element_at(dtype, F.col("column")).alias("dtype"),
        (F.col("n_missing") * 100.0 / F.col("n_rows")).alias("null_pct"),
        "n_distinct",
        values.value_text(df, names).alias("most_common"),
        F.col("top_n").alias("most_common_n"),
    )


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    out = (
        nan_to_null(df)
        .filter(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )
    return out if limit is None else out.limit(limit)


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max; the last bin is closed."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    edge = one_row(
        df, {f"{e}{i}": f(number(c)) for i, c in enumerate(names) for e, f in (("lo", F.min), ("hi", F.max))}
    )
    cells = []
    for i, c in enumerate(names):
        lo, hi = edge[f"lo{i}"], edge[f"hi{i}"]
        if lo is None:
            continue
        if lo == hi:  # numpy widens a single point by half a unit each way
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        b = F.least(F.floor((number(c) - lo) / width), F.lit(bins - 1)).cast("int")
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                b.alias("bin"),
                (F.lit(lo) + b * width).alias("bin_from"),
                (F.lit(lo) + (b + 1) * width).alias("bin_to"),
            )
        )
    return (
        df.select(F.inline(F.array(*cells)))
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin", "bin_from", "bin_to")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    p = len(df.columns)
    nulls = sum((F.col("n_missing_" + str(i)) for i in range(1, p)), F.col("n_missing_0"))
    cells = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[count_if(col(c).isNull()).alias(f"n_missing_{i}") for i, c in enumerate(df.columns)],
    )
    n = F.col("n_rows")
    one = cells.select(
        "n_rows",
        F.lit(p).cast("long").alias("n_columns"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(of_kind(df, "text"))).cast("long").alias("text_columns"),
        F.lit(len(of_kind(df, "datetime"))).cast("long").alias("datetime_columns"),
        (n * p).alias("total_cells"),
        nulls.alias("null_cells"),
        ratio(nulls, n * p).alias("null_rate"),
    )
    return one.crossJoin(F.broadcast(duplicate_rows(df)))  # two one-row results


def correlation_heatmap(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form, both triangles and the diagonal."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    half = report(
        df,
        {f"{i},{j}": {"r": corr(number(names[i]), number(names[j]))} for i, j in combinations(range(len(names)), 2)},
        label="pair",
    )
    look = F.array(*[F.lit(n) for n in names])
    at = F.split("pair", ",")
    half = half.select(look[at[0].cast("int")].alias("col_a"), look[at[1].cast("int")].alias("col_b"), "r")
    other = half.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    same = report(
        df,
        {n: {"r": F.when(F.stddev_pop(number(n)) > 0, 1.0)} for n in names},
        label="col_a",
    ).select("col_a", F.col("col_a").alias("col_b"), "r")
    return union_all([half, other, same])


def full_report(df: DataFrame, k: float = 1.5) -> DataFrame:
    """Shape, missing, duplicates, statistics and outliers as (section, column, metric, value).

    Value counts are written once; statistics, quartiles and outliers are read off them.
    """

    def long(part: DataFrame, section: str, names: Sequence[str], keyed: bool = True) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        key = F.col("column") if keyed else F.lit(None).cast("string").alias("column")
        return part.select(F.lit(section).alias("section"), key, F.inline(rows)).filter("value is not null")

    df = nan_to_null(df)
    counts = values.written_counts(df)
    summary = values.value_summary(df, counts=counts)
    stats = _stats(df, summary)
    return union_all(
        [
            long(shape(df), "shape", ["n_rows", "n_columns"], keyed=False),
            long(_missing(df, summary), "missing", ["n_missing"]),
            long(duplicate_rows(df), "duplicates", ["n_duplicates"], keyed=False),
            long(stats, "stats", ["n_distinct", "n_present", "min", "max", "mean"]),
            long(_outlying(df, counts, k), "outliers", ["n_outliers", "lower", "upper"]),
        ]
    )


def _missing(df: DataFrame, summary: DataFrame) -> DataFrame:
    """``missing_values`` from a summary; an empty table has no counts, so its columns are named."""
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return every.join(F.broadcast(summary.select("column", "n_missing")), "column", "left").fillna(0)


def _outlying(df: DataFrame, counts: dict[str, DataFrame], k: float) -> DataFrame:
    """``iqr_outlier_report`` from written value counts; numbers counted as text (wide decimals) take the rows."""
    place = {c: i for i, c in enumerate(df.columns)}
    numeric = numeric_columns(df)
    rest = [c for c in numeric if values.slot(df.schema[c]) not in ("i", "d")]
    names = F.get(F.array(*[F.lit(c) for c in df.columns]), F.col("c"))
    wanted = [place[c] for c in numeric if c not in rest]
    parts = [iqr_outlier_report(df.select(*[col(c) for c in rest]), k)] if rest else []
    kept = [counts[slot].select("c", F.col("v").cast("double").alias("v"), "n") for slot in ("i", "d") if slot in counts]
    if kept and wanted:
        cells = union_all(kept).where(F.col("c").isin(wanted))
        lo, hi = F.col("q")[0], F.col("q")[1]
        lim = values.count_quantiles(cells, [0.25, 0.75]).select("c", (lo - k * (hi - lo)).alias("lower"), (hi + k * (hi - lo)).alias("upper"))
        far = cells.join(F.broadcast(lim), "c").where((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper")))  # one row per column
        parts.append(far.groupBy(names.alias("column"), "lower", "upper").agg(F.sum("n").alias("n_outliers")).select("column", "n_outliers", "lower", "upper"))
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, n_outliers long, lower double, upper double")
    return union_all(parts)
