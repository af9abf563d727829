"""Guarded SQL, table inventory, previews and canned questions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, count_if, frame, kinds, nan_to_null, number, numeric_columns, report, union_all

# Fixed value: the statements that may never be sent, as one pattern.
FORBIDDEN = re.compile(
    r"--|;|\bDROP\b|\bDELETE\b|\bTRUNCATE\b|\bALTER\b|\bINSERT\b|\bUPDATE\b|\bCREATE\b|\bGRANT\b|"
    r"\bREVOKE\b|\bEXEC\b|\bEXECUTE\b|\bXP_\w+|\bINTO\s+OUTFILE\b|\bLOAD_FILE\b",
    re.IGNORECASE,
)
#: A LIMIT of the outermost SELECT: the end of the text, hence outside brackets and strings.
OWN_LIMIT = re.compile(r"\bLIMIT\s+\w+(\s+OFFSET\s+\w+)?\s*$", re.IGNORECASE)
MAX_SQL = 10_000


def check_sql(sql: str) -> str:
    """Raise unless the text is one plain SELECT."""
    text = sql.strip()
    if not text.upper().startswith("SELECT"):
        raise ValueError("only SELECT is allowed")
    if FORBIDDEN.search(text):
        raise ValueError("forbidden statement")
    if len(text) > MAX_SQL:
        raise ValueError("query too long")
    return text


def guarded_sql(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    """Run a checked SELECT, whole unless a ``limit`` is given; a LIMIT of its own goes first."""
    out = spark.sql(check_sql(sql))
    return out if limit is None or OWN_LIMIT.search(sql) else out.limit(limit)


def table_inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, n_rows, n_columns, numeric_columns, text_columns)."""
    parts = []
    for name, df in tables.items():
        k = list(kinds(df).values())
        parts.append(
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table"),
                "n_rows",
                F.lit(len(k)).cast("long").alias("n_columns"),
                F.lit(k.count("numeric")).cast("long").alias("numeric_columns"),
                F.lit(k.count("text")).cast("long").alias("text_columns"),
            )
        )
    return union_all(parts)


def catalog_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Every table and view of a database (default: the current one)."""
    db = database or spark.catalog.currentDatabase()
    return {t.name: spark.table(t.name if t.isTemporary else f"{db}.{t.name}") for t in spark.catalog.listTables(db)}


@dataclass
class ForeignKey:
    table: str
    column: str
    other: str
    other_column: str


def table_summary(df: DataFrame, primary: Sequence[str] = (), foreign: Sequence[ForeignKey] = ()) -> DataFrame:
    """(column, dtype, nullable, primary_key, foreign_key)."""
    refs = {f.column: f"{f.other}.{f.other_column}" for f in foreign}
    rows = [
        (f.name, f.dataType.simpleString(), f.nullable, f.name in primary, refs.get(f.name, "")) for f in df.schema.fields
    ]
    return frame(
        df.sparkSession, rows, "column string, dtype string, nullable boolean, primary_key boolean, foreign_key string"
    )


def preview(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*[col(o) for o in order]) if order else df).limit(n)


def quick_stats(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    return report(
        df,
        {
            c: {
                "min": F.round(F.min(number(c)), 4),
                "max": F.round(F.max(number(c)), 4),
                "mean": F.round(F.avg(number(c)), 4),
                "n_missing": count_if(col(c).isNull()),
            }
            for c in numeric_columns(df)
        },
    )


def template_query(df: DataFrame, name: str, order: Sequence[str] = (), columns: int | None = None, limit: int | None = None) -> DataFrame:
    """preview, count, columns, nulls, distinct or numeric over one table.

    ``columns`` looks at the first so many only, ``limit`` keeps so many rows; both
    are whole by default (a preview is ten rows).
    """

    def cut(out: DataFrame) -> DataFrame:
        out = out.orderBy(*[col(o) for o in order]) if order and name != "distinct" else out
        return out if limit is None else out.limit(limit)

    if name == "preview":
        return preview(df, limit or 10, order)
    if name == "count":
        return df.agg(F.count(F.lit(1)).alias("total"))
    if name == "columns":
        return cut(df.select(*[col(c) for c in df.columns[:columns]]))
    if name == "nulls":
        any_null = F.lit(False)
        for c in df.columns[:columns]:
            any_null = any_null | col(c).isNull()
        return cut(df.filter(any_null))
    if name == "distinct":
        return df.select(col(df.columns[0])).distinct().orderBy(col(df.columns[0])).transform(cut)
    if name == "numeric":
        x = number(numeric_columns(df)[0])
        return df.agg(
            F.min(x).alias("min_val"), F.max(x).alias("max_val"), F.avg(x).alias("avg_val"), F.count(x).alias("count_val")
        )
    raise ValueError(f"unknown template: {name}")


def foreign_keys(spark: SparkSession, keys: Sequence[ForeignKey]) -> DataFrame:
    rows = [(k.table, k.column, k.other, k.other_column) for k in keys]
    return frame(spark, rows, "table string, column string, other string, other_column string")


def join_on_fk(tables: Mapping[str, DataFrame], key: ForeignKey) -> DataFrame:
    """Inner join along a declared key; either side may come first."""
    a, b = tables[key.table], tables[key.other]
    return a.join(b, a[key.column] == b[key.other_column], "inner")


def suggest_joins(keys: Sequence[ForeignKey], table: str) -> list[ForeignKey]:
    """Declared keys that leave or reach the table."""
    return [k for k in keys if table in (k.table, k.other)]


def fk_violations(tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """Rows per declared key that point at nothing."""
    parts = []
    for k in keys:
        a, b = tables[k.table], tables[k.other]
        lost = a.filter(col(k.column).isNotNull()).join(
            b.select(col(k.other_column).alias("__k")), col(k.column) == F.col("__k"), "left_anti"
        )
        parts.append(
            lost.agg(F.count(F.lit(1)).alias("n_orphans")).select(
                F.lit(k.table).alias("table"), F.lit(k.column).alias("column"), "n_orphans"
            )
        )
    return union_all(parts)
