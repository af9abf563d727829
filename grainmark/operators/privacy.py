"""Personal-data detection and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.columns import col, count_if, report, text_columns

# What counts as personal data.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+?[\d\s\-\(\)]{10,15})\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit": r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
}

SCHEMA = "column string, pii_type string, n_hits long"


def pii_hits(df: DataFrame) -> DataFrame:
    """How many cells of each text column match each pattern, in one pass."""
    metrics = {
        f"{c}\u0000{k}": {"n_hits": count_if(col(c).rlike(p))} for c in text_columns(df) for k, p in PATTERNS.items()
    }
    if not metrics:
        return df.sparkSession.createDataFrame([], SCHEMA)
    parts = F.split("key", "\u0000")
    return report(df, metrics, label="key").select(parts[0].alias("column"), parts[1].alias("pii_type"), "n_hits")


def detect_pii(df: DataFrame, min_hits: int = 2) -> DataFrame:
    """Columns holding at least ``min_hits`` matching values; all rows are read."""
    return pii_hits(df).filter(F.col("n_hits") >= min_hits)


def privacy_report(df: DataFrame, min_hits: int = 2) -> DataFrame:
    """Risk level, affected columns and whether the table is safe to train on."""
    found = detect_pii(df, min_hits)
    types = F.count_distinct("pii_type")
    advice = F.create_map(
        F.lit("email"), F.lit("hash or remove"),
        F.lit("phone"), F.lit("mask"),
        F.lit("ssn"), F.lit("remove at once"),
        F.lit("credit"), F.lit("remove at once"),
        F.lit("ip"), F.lit("review"),
    )
    out = found.agg(
        types.alias("n_types"),
        F.count(F.lit(1)).alias("affected_columns"),
        F.array_join(F.sort_array(F.collect_set("pii_type")), ",").alias("pii_types"),
        F.sort_array(
            F.collect_list(F.concat_ws(": ", "column", "pii_type", F.element_at(advice, F.col("pii_type"))))
        ).alias("advice"),
    )
    risk = F.when(F.col("n_types") >= 3, "high").when(F.col("n_types") >= 1, "medium").otherwise("low")
    return out.withColumn("risk_level", risk).withColumn("safe_for_ml", F.col("n_types") == 0)


def anonymize_column(df: DataFrame, column: str, method: str = "hash", order: list[str] | None = None) -> DataFrame:
    """hash, mask, drop or fake_id one column in place.

    ``fake_id`` numbers the rows, so it needs a total ``order``.
    """
    c = col(column)
    if method == "hash":
        return df.withColumn(column, F.substring(F.sha2(c.cast("string"), 256), 1, 8))
    if method == "mask":
        return df.withColumn(column, F.when(c.isNotNull(), F.lit("***")))
    if method == "drop":
        return df.withColumn(column, F.lit(None).cast("string"))
    if method == "fake_id":
        if not order:
            raise ValueError("fake_id needs an order")
        numbered = values.with_position(df, order, "__place")
        return numbered.withColumn(column, F.format_string("ID_%06d", "__place")).drop("__place")
    raise ValueError(f"unknown method: {method}")
