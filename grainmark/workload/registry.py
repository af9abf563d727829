"""The query register and the derived inputs that queries and SQL share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# The given tables have no nulls, so both sides make the same ones.
GAPPY = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity",
    "CASE WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN NULL ELSE l_discount END AS discount",
    "CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice END AS price",
    "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS flag",
    "l_linestatus AS status",
    "l_shipdate AS shipped",
]
GAPPY_SQL = "SELECT " + ", ".join(GAPPY) + " FROM lineitem"


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*GAPPY)


LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def per(columns: Sequence[str], template: str) -> str:
    """UNION ALL of one SELECT per column."""
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)
