"""Column kinds, missing-value handling and one-pass reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Expressions per aggregate; small enough for the generated code to be compiled.
CHUNK = 45


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def kind(field: T.StructField) -> str:
    t = field.dataType
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(t, T.BooleanType):
        return "boolean"
    return "nested"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f) for f in df.schema.fields}


def of_kind(df: DataFrame, *wanted: str) -> list[str]:
    return [n for n, k in kinds(df).items() if k in wanted]


def numeric_columns(df: DataFrame) -> list[str]:
    return of_kind(df, "numeric")


def text_columns(df: DataFrame) -> list[str]:
    return of_kind(df, "text")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere, so it becomes null once, up front."""
    return df.select(
        *[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def number(name: str) -> Column:
    return col(name).cast("double")


def report(df: DataFrame, metrics: Mapping[str, Mapping[str, Column]], label: str = "column") -> DataFrame:
    """One output row per key of ``metrics``; all aggregates run in one pass.

    Very wide tables are cut into several aggregates of about ``CHUNK``
    expressions each, which are unioned.
    """
    parts: list[DataFrame] = []
    batch: list[tuple[str, Mapping[str, Column]]] = []
    size = 0

    def flush() -> None:
        aggs = [agg.alias(f"r{i}_{j}") for i, (_, ms) in enumerate(batch) for j, agg in enumerate(ms.values())]
        rows = [
            F.struct(F.lit(key).alias(label), *[F.col(f"r{i}_{j}").alias(m) for j, m in enumerate(ms)])
            for i, (key, ms) in enumerate(batch)
        ]
        parts.append(df.agg(*aggs).select(F.inline(F.array(*rows))))

    for key, ms in metrics.items():
        if batch and size + len(ms) > CHUNK:
            flush()
            batch, size = [], 0
        batch.append((key, ms))
        size += len(ms)
    if batch:
        flush()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def one_row(df: DataFrame, aggs: Mapping[str, Column]) -> dict:
    """Run global aggregates (chunked) and return their handful of values."""
    names = list(aggs)
    out: dict = {}
    for start in range(0, len(names), CHUNK):
        part = names[start : start + CHUNK]
        row = df.agg(*[aggs[n].alias(f"v{i}") for i, n in enumerate(part)]).first()
        out.update({n: row[f"v{i}"] for i, n in enumerate(part)})
    return out


def frame(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """A small driver-made result (advice, issues, one row per column)."""
    return spark.createDataFrame(list(rows), schema)


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("long")


def constant(df: DataFrame, name: str) -> Column:
    """Aggregate: does the column hold one value only (null counts as a value)?"""
    c = F.to_json(col(name)) if isinstance(df.schema[name].dataType, T.MapType) else col(name)
    na, n = F.count(F.when(c.isNull(), 1)), F.count(F.lit(1))
    return (na == n) | ((na == 0) & F.min(c).eqNullSafe(F.max(c)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero (plain division would fail in ANSI mode)."""
    return a / F.nullif(b, F.lit(0))


def corr(a: Column, b: Column) -> Column:
    """Pearson r over rows where both are present; null when either is constant."""
    # ``corr`` itself divides by zero on constants; r² does not
    cov, r2 = F.covar_pop(a, b), F.regr_r2(a, b)
    return F.when((cov == 0) & (r2 == 1), F.lit(None).cast("double")).otherwise(F.signum(cov) * F.sqrt(r2))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
