"""Reading files, resilient CSV and JSON, JDBC, and row caps."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..functions.columns import col
from .names import dedupe_columns

SEPARATORS = [",", ";", "\t", "|"]


@dataclass
class Dataset:
    """A table and where it came from."""

    df: DataFrame
    source: str
    warnings: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.df.columns


def not_empty(df: DataFrame, source: str) -> DataFrame:
    if not df.columns:
        raise ValueError(f"{source}: no columns")
    if not df.take(1):
        raise ValueError(f"{source}: no rows")
    return df


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> Dataset:
    """CSV, TSV, JSON or Parquet by extension; a declared schema avoids inference."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    r = spark.read if schema is None else spark.read.schema(schema)
    if ext in ("csv", "tsv"):
        df = r.csv(path, header=True, inferSchema=schema is None, sep="\t" if ext == "tsv" else ",", multiLine=False)
    elif ext in ("json", "jsonl", "ndjson"):
        df = r.json(path)
        if "_corrupt_record" in df.columns:  # one object or array over several lines
            df = r.json(path, multiLine=True)
    elif ext == "parquet":
        df = r.parquet(path)
    else:
        raise ValueError(f"unsupported file type: {ext}")
    return Dataset(not_empty(df, path), path)


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    # a separator that never occurs keeps each line whole, in any encoding
    return spark.read.csv(path, sep="\u0001", encoding=encoding, quote="", header=False, schema="line string")


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line holds bytes that are not; then Latin-1."""
    bad = _lines(spark, path, "UTF-8").filter(F.col("line").contains("�"))
    return "UTF-8" if bad.isEmpty() else "ISO-8859-1"


def sniff_separator(spark: SparkSession, path: str, encoding: str) -> str:
    """The separator that cuts the lines, all of them, into the most rows as wide as the first."""
    lines = _lines(spark, path, encoding).select(F.coalesce("line", F.lit("")).alias("line"))
    first = lines.first()
    if first is None:
        return ","
    heads = [first["line"].count(s) for s in SEPARATORS]
    width = [F.length("line") - F.length(F.replace(F.col("line"), F.lit(s), F.lit(""))) for s in SEPARATORS]
    same = lines.agg(*[F.avg((w == h).cast("int")).alias(f"s{i}") for i, (w, h) in enumerate(zip(width, heads))]).first()
    best, score = ",", 0.0
    for i, sep in enumerate(SEPARATORS):
        if heads[i] and same[i] * heads[i] > score:
            best, score = sep, same[i] * heads[i]
    return best


def read_csv_resilient(spark: SparkSession, path: str) -> Dataset:
    """Guess encoding and separator, skip malformed lines, report what was done."""
    encoding = sniff_encoding(spark, path)
    sep = sniff_separator(spark, path, encoding)
    notes = []
    if encoding != "UTF-8":
        notes.append(f"decoded as {encoding}")
    if sep != ",":
        notes.append(f"separator {sep!r}")
    opts = {"header": True, "sep": sep, "encoding": encoding}
    inferred = spark.read.csv(path, inferSchema=True, mode="DROPMALFORMED", **opts).schema
    clean = dedupe_columns([f.name.lstrip("﻿") for f in inferred.fields])
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(clean, inferred.fields)])
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    rows = spark.read.schema(full).csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad", enforceSchema=True, **opts)
    # a line with too few cells is padded with nulls, one with too many is skipped
    cells = F.size(F.split("__bad", "[" + sep + "]", -1))
    kept = rows.filter(F.col("__bad").isNull() | (cells <= len(clean))).drop("__bad")
    return Dataset(not_empty(kept, path), path, notes)


def bad_csv_lines(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """The malformed lines themselves."""
    full = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    rows = spark.read.schema(full).csv(path, header=True, sep=sep, encoding=encoding, columnNameOfCorruptRecord="__bad")
    return rows.select(*full.fieldNames()).filter("__bad is not null").select(F.col("__bad").alias("line"))


def flatten(df: DataFrame, joiner: str = ".") -> DataFrame:
    """Nested structs become columns named ``outer.inner``; arrays stay arrays."""

    def leaves(schema: T.StructType, at: Column | None, prefix: str):
        for f in schema.fields:
            here = col(f.name) if at is None else at[f.name]
            name = f.name if not prefix else f"{prefix}{joiner}{f.name}"
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, here, name)
            else:
                yield here.alias(name)

    return df.select(*leaves(df.schema, None, ""))


def read_json_flat(spark: SparkSession, path: str) -> Dataset:
    """An object, an array of objects or JSON lines, flattened to columns."""
    df = spark.read.json(path)
    if "_corrupt_record" in df.columns:
        df = spark.read.json(path, multiLine=True)
    return Dataset(flatten(not_empty(df, path)), path)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 8,
    **options: str,
) -> DataFrame:
    """A database table; with a numeric key and its bounds it is read in parallel."""
    if not re.fullmatch(r"[\w.]+", table):
        raise ValueError(f"not a table name: {table}")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        r = (
            r.option("partitionColumn", key)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return r.load()


def read_jdbc_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    from .catalog import check_sql

    check_sql(sql)
    return spark.read.format("jdbc").option("url", url).option("query", sql).options(**options).load()


# ---- caps and samples: the reference's own interactive-size operators ----


def _shuffled(key: Sequence[str], seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]), 256)


def take_random(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly n rows, the ones with the smallest hash.

    A threshold on the hash leaves a little more than n rows for the top-n, so its
    last task gets about n rows, not n from every partition.
    """
    total = df.count()
    if n >= total:
        return df
    h = _shuffled(key, seed)
    share = (n + 6 * math.sqrt(n) + 50) / total
    near = df.filter(F.substring(h, 1, 8) < f"{int(share * 16**8):08x}") if share < 1 else df
    if share < 1 and near.limit(n).count() < n:  # keys that repeat may bunch
        near = df
    return near.orderBy(h, *[col(k) for k in key]).limit(n)


def cap_rows(
    df: DataFrame, key: Sequence[str], max_rows: int = 1_000_000, sample_rows: int = 250_000, max_columns: int = 2_000, seed: int = 42
) -> Dataset:
    """Above ``max_rows`` keep exactly ``sample_rows`` random rows."""
    notes = [f"wide table: {len(df.columns)} columns"] if len(df.columns) > max_columns else []
    n = df.count()
    if n <= max_rows:
        return Dataset(df, "", notes)
    notes.append(f"sampled {min(sample_rows, n)} of {n} rows")
    return Dataset(take_random(df, min(sample_rows, n), key, seed), "", notes)


def smart_sample(
    df: DataFrame,
    key: Sequence[str],
    limit: int = 10_000,
    target: str | None = None,
    small: int = 50_000,
    medium: int = 500_000,
    seed: int = 42,
) -> DataFrame:
    """Everything, a random ``limit``, or an equal random share of every class."""
    n = df.count()
    if n <= small or n <= limit:
        return df
    if n <= medium or target is None:
        return take_random(df, limit, key, seed)
    placed = values.with_position(df.withColumn("__h", _shuffled(key, seed)), [target, "__h"], "__p")
    first = placed.groupBy(col(target).alias("__c")).agg(F.min("__p").alias("__first"))
    each = max(1, limit // max(first.count(), 1))
    joined = placed.join(first, col(target).eqNullSafe(F.col("__c")))
    return joined.filter(F.col("__p") - F.col("__first") < each).select(*[col(c) for c in df.columns])


def write_output(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")


def union_tables(*tables: DataFrame) -> DataFrame:
    """Append by column name; absent columns become null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
