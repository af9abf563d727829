"""Detecting column types, casting, and landing files as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scratch, values
from ..functions.columns import col, count_if, frame, kinds, nan_to_null, one_row, text_columns, union_all
from ..operators import profile
from ..operators.contracts import looks_numeric
from . import names
from .readers import Dataset, read_csv_resilient, read_json_flat, read_table

# Words and patterns that decide a type.
TRUE_WORDS = ["true", "yes", "1", "t", "y", "on", "✓", "x"]
FALSE_WORDS = ["false", "no", "0", "f", "n", "off", "", "none", "null", "nan"]
DATE_PATTERNS = [
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{4}/\d{2}/\d{2}$",
    r"^\d{2}-\d{2}-\d{4}$",
    r"^\d{4}\.\d{2}\.\d{2}$",
]
DATETIME_PATTERNS = [
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}",
    r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}",
]
ID_WORDS = ["id", "key", "uuid", "code", "ref"]
INDEX_WORDS = ["id", "key", "date", "time", "status", "type", "category", "region", "label", "class", "flag"]

TYPES = "column string, type string, n_missing long, n_distinct long, unique_ratio double, is_id boolean, is_text boolean, is_index boolean"


def _declared(t: T.DataType) -> str | None:
    if isinstance(t, T.IntegralType):
        return "INTEGER"
    if isinstance(t, T.NumericType):
        return "REAL"
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, T.DateType):
        return "DATE"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    if isinstance(t, (T.StructType, T.ArrayType, T.MapType)):
        return "JSON"
    return None


def is_json(c: Column) -> Column:
    """Does the text parse as JSON?"""
    return F.try_parse_json(c).isNotNull()


def detect_column_types(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Landing type per column from hit rates over every row, plus id, long-text and index hints."""
    df = nan_to_null(df)
    texts = text_columns(df)
    aggs: dict[str, Column] = {}
    for c in texts:
        x = col(c)
        plain = F.lower(F.trim(x))
        num = F.when(looks_numeric(x), x.try_cast("double"))
        aggs[f"n|{c}"] = F.count(x)
        aggs[f"bool|{c}"] = F.count(F.when(plain.isin(TRUE_WORDS + FALSE_WORDS), 1))
        aggs[f"num|{c}"] = F.count(num)
        aggs[f"whole|{c}"] = F.count(F.when(num == F.floor(num), 1))
        aggs[f"json|{c}"] = F.count(F.when(is_json(x), 1))
        aggs[f"len|{c}"] = F.avg(F.length(x))
        for i, p in enumerate(DATETIME_PATTERNS):
            aggs[f"ts{i}|{c}"] = F.count(F.when(x.rlike(p), 1))
        for i, p in enumerate(DATE_PATTERNS):
            aggs[f"d{i}|{c}"] = F.count(F.when(x.rlike(p), 1))
        aggs[f"time|{c}"] = F.count(F.try_to_timestamp(x))
    got = one_row(df, aggs) if aggs else {}
    rows = []
    for f in values.value_summary(df).collect():  # one row per column
        c = f["column"]
        kind = _declared(df.schema[c].dataType)
        if kind is None:
            n = max(got[f"n|{c}"], 1)
            hit = lambda k: got[f"{k}|{c}"] / n  # noqa: B023, E731
            dates = max(hit(f"d{i}") for i in range(len(DATE_PATTERNS)))
            if not got[f"n|{c}"]:
                kind = "TEXT"
            elif hit("bool") == 1 and f["n_distinct"] <= 4:
                kind = "BOOLEAN"
            elif hit("num") >= threshold:
                kind = "INTEGER" if got[f"whole|{c}"] == got[f"num|{c}"] else "REAL"
            elif max(hit(f"ts{i}") for i in range(len(DATETIME_PATTERNS))) >= threshold:
                kind = "DATETIME"
            elif dates >= threshold:
                kind = "DATE"
            elif hit("time") == 1:
                kind = "DATETIME"
            else:
                kind = "JSON" if hit("json") >= threshold else "TEXT"
        ratio = f["n_distinct"] / max(f["n_rows"], 1)
        has = lambda words: any(w in c.lower() for w in words)  # noqa: B023, E731
        is_id = ratio > 0.95 and kind in ("INTEGER", "TEXT") and has(ID_WORDS)
        is_text = kind == "TEXT" and ratio > 0.5 and (got.get(f"len|{c}") or 0) > 20
        rows.append(
            (c, kind, f["n_missing"], f["n_distinct"], round(ratio, 4), is_id, is_text, is_id or ratio < 0.05 or has(INDEX_WORDS))
        )
    return frame(df.sparkSession, rows, TYPES)


def cast_column(df: DataFrame, name: str, kind: str) -> Column:
    x = col(name)
    is_text = kinds(df)[name] == "text"
    if kind == "INTEGER":
        return F.when(looks_numeric(x), x.try_cast("double")).try_cast("long") if is_text else x.try_cast("long")
    if kind == "REAL":
        return F.when(looks_numeric(x), x.try_cast("double")) if is_text else x.cast("double")
    if kind == "BOOLEAN":
        word = F.lower(F.trim(x.cast("string")))
        return F.when(word.isin(TRUE_WORDS), 1).when(word.isin(FALSE_WORDS), 0)
    if kind in ("DATE", "DATETIME"):
        t = F.try_to_timestamp(x) if is_text else x.cast("timestamp")
        return F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    if kind == "JSON" and kinds(df)[name] == "nested":
        return F.to_json(x)
    return x


def cast_to_detected(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast every column to its landing type; what does not fit becomes null."""
    return df.select(*[cast_column(df, c, types.get(c, "TEXT")).alias(c) for c in df.columns])


def type_map(types: DataFrame) -> dict[str, str]:
    return {r["column"]: r["type"] for r in types.select("column", "type").collect()}  # one row per column


def add_audit_columns(df: DataFrame, source: str | None = None) -> DataFrame:
    src = F.lit(source) if source is not None else F.col("_metadata.file_path")
    return df.withColumn("__source_file", src).withColumn("__loaded_at", F.current_timestamp())


def validate_for_landing(df: DataFrame, small: int = 10, wide: int = 200) -> DataFrame:
    """(level, kind, column, value): empty table, null columns, duplicates, size."""
    df = nan_to_null(df)
    got = one_row(df, {"n": F.count(F.lit(1)), **{f"na|{c}": count_if(col(c).isNull()) for c in df.columns}})
    n = got["n"]
    if n == 0:
        return frame(df.sparkSession, [("error", "empty", None, 0.0)], "level string, kind string, column string, value double")
    rows = []
    for c in df.columns:
        na = got[f"na|{c}"]
        if na == n:
            rows.append(("warning", "all_null", c, 1.0))
        if na / n > 0.5:
            rows.append(("warning", "mostly_null", c, na / n))
    dup = profile.duplicate_rows(df).first()[0]
    if dup:
        rows.append(("warning", "duplicates", None, float(dup)))
    if n < small:
        rows.append(("warning", "few_rows", None, float(n)))
    if len(df.columns) > wide:
        rows.append(("warning", "many_columns", None, float(len(df.columns))))
    return frame(df.sparkSession, rows, "level string, kind string, column string, value double")


# ---- landing ----


def keep_last(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the one with the largest ``order``; combined map-side."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*[col(k) for k in key]).agg(F.max_by(F.struct(*[col(c) for c in rest]), order).alias("__r"))
    return best.select(*[col(k) for k in key], *[F.col("__r")[c].alias(c) for c in rest]).select(*[col(c) for c in df.columns])


def one_per_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key, nulls alike; of several the smallest by the other columns, in their order."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    best = df.groupBy(*[col(k) for k in key]).agg(F.min(F.struct(*[col(c) for c in rest])).alias("__r"))
    return best.select(*[col(k) if k in key else F.col("__r")[k].alias(k) for k in df.columns])


def _unseen(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key ``other`` doesn't hold; a null equals a null."""
    right = other.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(key)])
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)])
    return df.join(right, same, "left_anti")


def upsert(existing: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows win over old rows with the same key; of equal new keys ``one_per_key`` says which."""
    new = one_per_key(fresh, key)
    return _unseen(existing, new, key).unionByName(new, allowMissingColumns=True)


def insert_ignore(existing: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows win; only unseen keys are added, one row each as in ``one_per_key``."""
    return existing.unionByName(_unseen(one_per_key(fresh, key), existing, key), allowMissingColumns=True)


def land_table(df: DataFrame, path: str, mode: str = "replace", key: Sequence[str] = ()) -> DataFrame:
    """replace, append, skip, upsert or ignore into a Parquet table; returns the table.

    Only a missing path counts as "no table yet": a table that can't be read is an
    error in every mode and stays as it is. Replacing and merging write a new folder
    and rename it into place.
    """
    spark = df.sparkSession
    if mode not in ("replace", "append", "skip", "upsert", "ignore"):
        raise ValueError(f"unknown mode: {mode}")
    if mode in ("upsert", "ignore") and not key:
        raise ValueError(f"{mode} needs a key")
    old = spark.read.parquet(path) if scratch.exists(spark, path) else None
    if old is None or mode == "replace":
        scratch.swap_in(df, path)
    elif mode == "append":
        df.write.mode("append").parquet(path)
    elif mode == "upsert":
        scratch.swap_in(upsert(old, df, key), path)
    elif mode == "ignore":
        scratch.swap_in(insert_ignore(old, df, key), path)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def landing_metadata(df: DataFrame, table: str, source: str, types: DataFrame | None = None, key: Sequence[str] = ()) -> DataFrame:
    """One row: table, source, rows, columns and a JSON description of every column."""
    t = types if types is not None else detect_column_types(df)
    n = df.agg(F.count(F.lit(1)).alias("row_count"))
    info = t.agg(
        F.to_json(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "column",
                        "type",
                        (F.col("n_missing") > 0).alias("nullable"),
                        F.col("column").isin(list(key)).alias("is_pk"),
                        "unique_ratio",
                        "n_missing",
                    )
                )
            )
        ).alias("schema_json")
    )  # one entry per column
    return n.crossJoin(info).select(
        F.lit(table).alias("table_name"),
        F.lit(source).alias("source_file"),
        "row_count",
        F.lit(len(df.columns)).alias("col_count"),
        "schema_json",
    )


def preview_schema(df: DataFrame, source: str, n: int = 5, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """What landing would create: column types, checks, first rows and DDL."""
    clean = names.with_clean_names(df)
    types = detect_column_types(clean)
    spark_types = {"INTEGER": "bigint", "REAL": "double", "BOOLEAN": "int"}
    kinds_ = type_map(types)
    ddl = ", ".join(f"`{c}` {spark_types.get(kinds_[c], 'string')}" for c in clean.columns)
    first = clean.orderBy(*[col(o) for o in order]).limit(n) if order else clean.limit(n)
    return types, validate_for_landing(clean), first, f"CREATE TABLE {names.table_name(source)} ({ddl})"


@dataclass
class Landed:
    table: str
    source: str
    rows: int
    columns: int
    status: str
    detail: str = ""


def read_any(spark: SparkSession, path: str) -> Dataset:
    ext = path.rsplit(".", 1)[-1].lower()
    if ext == "csv":
        return read_csv_resilient(spark, path)
    return read_json_flat(spark, path) if ext == "json" else read_table(spark, path)


def land_file(spark: SparkSession, path: str, out_dir: str, mode: str = "replace", key: Sequence[str] = (), detect: bool = True) -> Landed:
    """Read, clean names, detect and cast types, add audit columns, write."""
    df = names.with_clean_names(read_any(spark, path).df)
    types = detect_column_types(df)
    if detect:
        df = cast_to_detected(df, type_map(types))
    table = names.table_name(path)
    landed = land_table(add_audit_columns(df, path), f"{out_dir}/{table}", mode, key)
    meta = landing_metadata(landed, table, path, types, key)
    meta.write.mode("append").parquet(f"{out_dir}/_table_metadata")
    return Landed(table, path, landed.count(), len(landed.columns), "ok")


def land_many(spark: SparkSession, paths: Sequence[str], out_dir: str, mode: str = "replace") -> DataFrame:
    """Each file becomes a table; one bad file does not stop the others."""
    done = []
    for p in paths:
        try:
            done.append(land_file(spark, p, out_dir, mode))
        except Exception as e:
            done.append(Landed(names.table_name(p), p, 0, 0, "failed", str(e)[:200]))
    rows = [(d.table, d.source, d.rows, d.columns, d.status, d.detail) for d in done]
    return frame(spark, rows, "table string, source string, n_rows long, n_columns int, status string, detail string")


def land_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("n_files"),
        count_if(F.col("status") == "ok").alias("n_ok"),
        F.sum("n_rows").alias("n_rows"),
    )


def compare_datasets(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, columns, missing, duplicates, outlier columns, readiness, violations."""
    from ..operators import advise, contracts

    parts = []
    for name, df in tables.items():
        stats = profile.dataset_stats(df).select("n_rows", "n_columns", "null_cells", "n_duplicates")
        out = profile.iqr_outlier_report(df).agg(F.count(F.lit(1)).alias("outlier_columns"))
        ready = advise.readiness_grade(advise.ml_readiness(df)).select(F.col("score").alias("ml_score"), F.col("grade").alias("ml_grade"))
        bad = contracts.evaluate_contracts(df).agg(F.count(F.lit(1)).alias("violations"))
        # four one-row results side by side
        parts.append(stats.crossJoin(out).crossJoin(ready).crossJoin(bad).select(F.lit(name).alias("dataset"), "*"))
    return union_all(parts)


def best_dataset(compared: DataFrame) -> DataFrame:
    return compared.orderBy(F.desc("ml_score"), "dataset").limit(1)
