from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import profile
from .registry import GAPPY_SQL, LINE_NUM, gappy, per, query, table

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
GAP = ["l_orderkey", "l_partkey", "l_suppkey", "quantity", "discount", "price", "flag", "status", "shipped"]
G = f"WITH g AS ({GAPPY_SQL}) "


@query("shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def _(spark, sf):
    return profile.shape(table(spark, sf, "lineitem"))


@query(
    "missing_values",
    G + per(GAP, "SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM g"),
)
def _(spark, sf):
    return profile.missing_values(gappy(spark, sf))


@query(
    "null_rates",
    G + per(GAP, "SELECT '{c}' AS \"column\", round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_rate FROM g"),
)
def _(spark, sf):
    return profile.null_rates(gappy(spark, sf)).withColumn("null_rate", F.round("null_rate", 6))


DUP = "SELECT l_partkey, l_quantity, l_returnflag FROM lineitem"


def _dup(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")


@query(
    "duplicate_rows",
    f"SELECT CAST((SELECT count(*) FROM lineitem) - count(*) AS BIGINT) AS n_duplicates FROM (SELECT DISTINCT * FROM ({DUP}))",
)
def _(spark, sf):
    return profile.duplicate_rows(_dup(spark, sf))


@query(
    "list_duplicates",
    "SELECT l_partkey, l_quantity, l_returnflag, count(*) AS n_copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(spark, sf):
    return profile.list_duplicates(_dup(spark, sf))


@query(
    "duplicate_documents",
    "SELECT CAST(count(*) - count(DISTINCT text) AS BIGINT) AS n_duplicates FROM documents",
)
def _(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").select("text"))


NUM = [c for c in LINEITEM if c not in ("l_returnflag", "l_linestatus", "l_shipdate")]
STATS_SQL = (
    per(
        NUM,
        """SELECT '{c}' AS "column", 'numeric' AS kind, count(DISTINCT {c}) AS n_distinct, count({c}) AS n_present,
           CAST(min({c}) AS DOUBLE) AS "min", CAST(max({c}) AS DOUBLE) AS "max", round(avg({c}), 5) AS mean,
           NULL AS most_common FROM lineitem""",
    )
    + " UNION ALL "
    + per(
        ["l_returnflag", "l_linestatus"],
        """SELECT '{c}', 'text', count(DISTINCT {c}), count({c}), NULL, NULL, NULL,
           (SELECT {c} FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) FROM lineitem""",
    )
)


@query("basic_stats", STATS_SQL)
def _(spark, sf):
    df = table(spark, sf, "lineitem").drop("l_shipdate")
    return profile.basic_stats(df).withColumn("mean", F.round("mean", 5))


IQR_SQL = per(
    ["event_id", "user_id", "value"],
    """SELECT '{c}' AS "column", CAST(sum(CASE WHEN {c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
    round(any_value(q1 - 1.5*(q3-q1)), 4) AS lower, round(any_value(q3 + 1.5*(q3-q1)), 4) AS upper
    FROM events, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events) HAVING n_outliers > 0""",
)


@query("iqr_outlier_report", IQR_SQL)
def _(spark, sf):
    out = profile.iqr_outlier_report(table(spark, sf, "events"))
    return out.withColumn("lower", F.round("lower", 4)).withColumn("upper", F.round("upper", 4))


@query(
    "example_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    o AS (SELECT value, row_number() OVER (ORDER BY event_id) AS place FROM events, q
          WHERE value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1))
    SELECT 'value' AS "column", place, value FROM o WHERE place <= 100""",
)
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return profile.example_outliers(df, ["event_id"]).filter("column = 'value'")


FULL_SQL = f"""
WITH li AS (SELECT l_orderkey, l_quantity, l_extendedprice, l_tax, l_returnflag FROM lineitem),
q AS ({per(["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"],
  "SELECT '{c}' AS c, quantile_cont({c},0.25) - 1.5*(quantile_cont({c},0.75)-quantile_cont({c},0.25)) AS lo, quantile_cont({c},0.75) + 1.5*(quantile_cont({c},0.75)-quantile_cont({c},0.25)) AS hi FROM li")}),
v AS ({per(["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"], "SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS x FROM li")}),
o AS (SELECT v.c, CAST(count(*) AS DOUBLE) AS n, any_value(lo) AS lo, any_value(hi) AS hi FROM v JOIN q ON v.c = q.c WHERE x < lo OR x > hi GROUP BY v.c),
s AS ({per(["l_orderkey", "l_quantity", "l_extendedprice", "l_tax"],
  "SELECT '{c}' AS c, count(DISTINCT {c})::DOUBLE AS n_distinct, count({c})::DOUBLE AS n_present, min({c})::DOUBLE AS mn, max({c})::DOUBLE AS mx, avg({c}) AS mean FROM li")}
  UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag)::DOUBLE, count(l_returnflag)::DOUBLE, NULL, NULL, NULL FROM li),
u AS (
SELECT 'shape' AS section, NULL AS "column", 'n_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM li
UNION ALL SELECT 'shape', NULL, 'n_columns', 5.0
UNION ALL {per(["l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag"],
  "SELECT 'missing', '{c}', 'n_missing', CAST(count(*) - count({c}) AS DOUBLE) FROM li")}
UNION ALL SELECT 'duplicates', NULL, 'n_duplicates', CAST((SELECT count(*) FROM li) - count(*) AS DOUBLE) FROM (SELECT DISTINCT * FROM li)
UNION ALL SELECT 'stats', c, 'n_distinct', n_distinct FROM s
UNION ALL SELECT 'stats', c, 'n_present', n_present FROM s
UNION ALL SELECT 'stats', c, 'min', mn FROM s WHERE mn IS NOT NULL
UNION ALL SELECT 'stats', c, 'max', mx FROM s WHERE mx IS NOT NULL
UNION ALL SELECT 'stats', c, 'mean', mean FROM s WHERE mean IS NOT NULL
UNION ALL SELECT 'outliers', c, 'n_outliers', n FROM o
UNION ALL SELECT 'outliers', c, 'lower', lo FROM o
UNION ALL SELECT 'outliers', c, 'upper', hi FROM o)
SELECT section, "column", metric, round(value, 5) AS value FROM u"""


def full_report(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag")
    return profile.full_report(df).withColumn("value", F.round("value", 5))


query("full_report", FULL_SQL)(full_report)


CS = ["l_orderkey", "l_partkey", "l_suppkey", "quantity", "flag", "status"]
CS_TYPE = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "quantity": "double"}


def _cs(c):
    t = CS_TYPE.get(c, "string")
    return f"""SELECT '{c}' AS "column", '{t}' AS dtype, round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct,
      count(DISTINCT {c}) AS n_distinct,
      (SELECT count(*) FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common_n,
      (SELECT CAST({c} AS VARCHAR) FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common
      FROM g"""


@query("column_summary", G + " UNION ALL ".join(_cs(c) for c in CS))
def _(spark, sf):
    return profile.column_summary(gappy(spark, sf).select(*CS)).withColumn("null_pct", F.round("null_pct", 4))


@query("value_counts", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1")
def _(spark, sf):
    return profile.value_counts(table(spark, sf, "part"), "p_brand")


@query(
    "value_counts_top",
    "SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
)
def _(spark, sf):
    return profile.value_counts(table(spark, sf, "documents"), "source", 5)


HIST = per(
    ["l_quantity", "l_extendedprice"],
    """SELECT '{c}' AS "column", CAST(least(floor(({c} - lo) / ((hi - lo) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
    FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1, 2""",
)


@query("histogram", HIST)
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    return profile.histogram(df, ["l_quantity", "l_extendedprice"]).select("column", "bin", "n")


@query(
    "dataset_stats",
    G
    + """SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns, CAST(6 AS BIGINT) AS numeric_columns,
    CAST(2 AS BIGINT) AS text_columns, CAST(1 AS BIGINT) AS datetime_columns, count(*) * 9 AS total_cells,
    CAST(4 * count(*) - count(quantity) - count(discount) - count(price) - count(flag) AS BIGINT) AS null_cells,
    round((4 * count(*) - count(quantity) - count(discount) - count(price) - count(flag)) / (count(*) * 9.0), 6) AS null_rate,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS BIGINT) AS n_duplicates FROM g""",
)
def _(spark, sf):
    return profile.dataset_stats(gappy(spark, sf)).withColumn("null_rate", F.round("null_rate", 6))


@query(
    "correlation_heatmap",
    " UNION ALL ".join(
        f"SELECT '{x}' AS col_a, '{y}' AS col_b, round(corr({a}, {b}), 6) AS r FROM lineitem"
        for a, b in combinations(LINE_NUM, 2)
        for x, y in ((a, b), (b, a))
    )
    + " UNION ALL "
    + per(LINE_NUM, "SELECT '{c}', '{c}', 1.0"),
)
def _(spark, sf):
    return profile.correlation_heatmap(table(spark, sf, "lineitem"), LINE_NUM).withColumn("r", F.round("r", 6))
