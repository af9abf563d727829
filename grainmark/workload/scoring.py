from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from .registry import GAPPY_SQL, gappy, query, table

G = f"WITH g AS ({GAPPY_SQL}) "
HOLES = ["quantity", "discount", "price", "flag"]
ALL = ["l_orderkey", "l_partkey", "l_suppkey", "quantity", "discount", "price", "flag", "status", "shipped"]
NUM = ["l_orderkey", "l_partkey", "l_suppkey", "quantity", "discount", "price"]


def _part(name, q):
    out = q.sub_scores().filter(F.col("dimension") == name)
    return out.select("part", F.round("value", 4).alias("value"))


GAPS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in HOLES)
COMPLETE = (
    G
    + f"""SELECT 'cell' AS part, round(100 * (1 - sum({GAPS}) / (count(*) * 9.0)), 4)::DOUBLE AS value FROM g
    UNION ALL SELECT 'row', round(100.0 * count(*) FILTER ({GAPS} = 0) / count(*), 4)::DOUBLE FROM g
    UNION ALL SELECT 'column', round(100.0 * 5 / 9, 4)::DOUBLE
    UNION ALL SELECT 'numeric', round(100 * (1 - (3 * count(*) - count(quantity) - count(discount) - count(price)) / (count(*) * 6.0)), 4)::DOUBLE FROM g"""
)


@query("quality_completeness", COMPLETE)
def _(spark, sf):
    return _part("completeness", Q.score_quality(gappy(spark, sf), dimensions=["completeness"]))


# A small table derived from parts: copies, a constant and a near-constant column.
ODD = """SELECT p_brand, p_type, p_size AS size_id, 1 AS one, CASE WHEN p_size > 1 THEN 'same' ELSE 'other' END AS mostly FROM part"""


def _odd(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_brand", "p_type", "p_size AS size_id", "1 AS one", "CASE WHEN p_size > 1 THEN 'same' ELSE 'other' END AS mostly"
    )


@query(
    "quality_uniqueness",
    f"""WITH o AS ({ODD}), n AS (SELECT count(*) AS n FROM o), d AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM o))
    SELECT 'row' AS part, round(100.0 * d / n, 4)::DOUBLE AS value FROM n, d UNION ALL SELECT 'constant_penalty', 15.0
    UNION ALL SELECT 'near_constant_penalty', 8.0 * (1 + CASE WHEN (SELECT max(c) FROM (SELECT count(*) AS c FROM o GROUP BY mostly)) / n::DOUBLE > 0.95 THEN 1 ELSE 0 END) FROM n
    UNION ALL SELECT 'id_penalty', 20.0""",
)
def _(spark, sf):
    return _part("uniqueness", Q.score_quality(_odd(spark, sf), dimensions=["uniqueness"]))


# Names that carry hints, with values that break them.
HINT = """SELECT s_acctbal - 9000 AS price, s_nationkey * 3 AS month, s_suppkey % 50 AS quantity, CASE WHEN s_nationkey > 12 THEN upper(s_name) ELSE lower(s_name) END AS label_text,
 CASE WHEN s_nationkey > 20 THEN s_name || ' ' ELSE s_name END AS padded, CAST(s_suppkey AS VARCHAR) AS digits, s_acctbal AS total FROM supplier"""
HINTS = [
    "s_acctbal - 9000 AS price",
    "s_nationkey * 3 AS month",
    "s_suppkey % 50 AS quantity",
    "CASE WHEN s_nationkey > 12 THEN upper(s_name) ELSE lower(s_name) END AS label_text",
    "CASE WHEN s_nationkey > 20 THEN concat(s_name, ' ') ELSE s_name END AS padded",
    "CAST(s_suppkey AS STRING) AS digits",
    "s_acctbal AS total",
]


def _hint(spark, sf):
    return table(spark, sf, "supplier").selectExpr(*HINTS)


def _range(c, lo, hi):
    return f"(SELECT least(30, 5 * count(*)) FROM h WHERE {c} < {lo} OR {c} > {hi})"


@query(
    "quality_validity",
    f"""WITH h AS ({HINT}), n AS (SELECT count(*) AS n FROM h)
    SELECT 'range_penalty' AS part, CAST({_range('price', 0, 1e9)} + {_range('month', 1, 12)} + {_range('quantity', 0, 1e7)} AS DOUBLE) AS value
    UNION ALL SELECT 'negative_penalty', CAST(CASE WHEN min(price) < 0 THEN 10 ELSE 0 END + CASE WHEN min(quantity) < 0 THEN 10 ELSE 0 END AS DOUBLE) FROM h
    UNION ALL SELECT 'cardinality_penalty', CAST(5 * ((SELECT count(DISTINCT label_text) FROM h) > 0.9 * n AND n > 50)::INT
      + 5 * ((SELECT count(DISTINCT padded) FROM h) > 0.9 * n AND n > 50)::INT + 5 * ((SELECT count(DISTINCT digits) FROM h) > 0.9 * n AND n > 50)::INT AS DOUBLE) FROM n
    UNION ALL SELECT 'format_penalty', CAST(3 * (max(CASE WHEN label_text = upper(label_text) THEN 1 ELSE 0 END) + max(CASE WHEN label_text = lower(label_text) THEN 1 ELSE 0 END) > 1)::INT
      + 3 * (max(CASE WHEN padded <> trim(padded) THEN 1 ELSE 0 END))::INT AS DOUBLE) FROM h""",
)
def _(spark, sf):
    return _part("validity", Q.score_quality(_hint(spark, sf), dimensions=["validity"]))


def _issue(check):
    def run(spark, sf):
        return (
            Q.score_quality(_hint(spark, sf))
            .issues()
            .filter(F.col("issue") == check)
            .select("column", F.round("value", 6).alias("value"))
        )

    return run


query(
    "quality_range",
    f"""WITH h AS ({HINT}), u AS (SELECT 'price' AS "column", count(*)::DOUBLE AS value FROM h WHERE price < 0 OR price > 1e9
    UNION ALL SELECT 'month', count(*) FROM h WHERE month < 1 OR month > 12
    UNION ALL SELECT 'quantity', count(*) FROM h WHERE quantity < 0 OR quantity > 1e7) SELECT * FROM u WHERE value > 0""",
)(_issue("out_of_range"))
query(
    "quality_negatives",
    f"""WITH h AS ({HINT}), u AS (SELECT 'price' AS "column", count(*)::DOUBLE AS value FROM h WHERE price < 0
    UNION ALL SELECT 'quantity', count(*) FROM h WHERE quantity < 0) SELECT * FROM u WHERE value > 0""",
)(_issue("negative"))
query(
    "quality_cardinality",
    f"""WITH h AS ({HINT}), u AS (SELECT 'label_text' AS "column", count(DISTINCT label_text)::DOUBLE AS value, count(*) AS n FROM h
    UNION ALL SELECT 'padded', count(DISTINCT padded), count(*) FROM h UNION ALL SELECT 'digits', count(DISTINCT digits), count(*) FROM h)
    SELECT "column", value FROM u WHERE value > 0.9 * n AND n > 50""",
)(_issue("high_cardinality"))
query(
    "quality_format_case",
    f"""WITH h AS ({HINT}), u AS (SELECT 'label_text' AS "column", max((regexp_matches(label_text, '\\p{{Lu}}') AND NOT regexp_matches(label_text, '\\p{{Ll}}'))::INT)
     + max((regexp_matches(label_text, '\\p{{Ll}}') AND NOT regexp_matches(label_text, '\\p{{Lu}}'))::INT) AS k FROM h)
    SELECT "column", 1.0::DOUBLE AS value FROM u WHERE k > 1""",
)(_issue("mixed_case"))
query(
    "quality_format_spaces",
    f"""WITH h AS ({HINT}) SELECT 'padded' AS "column", 1.0::DOUBLE AS value FROM h HAVING max((padded <> trim(padded))::INT) = 1""",
)(_issue("outer_spaces"))
query(
    "quality_hidden_numerics",
    f"""WITH h AS ({HINT}) SELECT 'digits' AS "column", round(avg((TRY_CAST(digits AS DOUBLE) IS NOT NULL)::INT), 6) AS value FROM h HAVING value > 0.9""",
)(_issue("hidden_numeric"))
query(
    "quality_total",
    f"""WITH h AS ({HINT}) SELECT 'total' AS "column", count(*)::DOUBLE AS value FROM h WHERE abs(price * quantity - total) > abs(price * quantity) * 0.01 HAVING count(*) > 0""",
)(_issue("total"))


@query(
    "quality_date_order",
    """SELECT 'start_date>end_date' AS "column", count(*)::DOUBLE AS value FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
    WHERE o_orderdate > l_shipdate HAVING count(*) > 0""",
)
def _(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    df = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderdate").alias("start_date"), F.col("l_shipdate").alias("end_date"), "l_quantity"
    )
    return Q.score_quality(df, dimensions=["consistency"]).issues().filter("issue = 'date'").select("column", "value")


@query(
    "quality_min_max_pairs",
    """SELECT 'min_cost>max_cost' AS "column", count(*)::DOUBLE AS value FROM part WHERE p_retailprice > 1000 + p_size * 10 HAVING count(*) > 0""",
)
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_retailprice AS min_cost", "1000 + p_size * 10 AS max_cost", "p_brand")
    return Q.score_quality(df, dimensions=["consistency"]).issues().filter("issue = 'minmax'").select("column", "value")


@query(
    "quality_pii",
    " UNION ALL ".join(
        f"""SELECT * FROM (SELECT 'text' AS "column", 'personal_data_{k}' AS issue FROM documents HAVING max((regexp_matches(text, '{p}'))::INT) = 1)"""
        for k, p in Q.PII_PATTERNS.items()
    ),
)
def _(spark, sf):
    df = table(spark, sf, "documents").select("text", "lang")
    out = Q.score_quality(df, dimensions=["integrity"]).issues().filter("issue like 'personal_data%'")
    return out.filter("`column` = 'text'").select("column", "issue")


@query(
    "quality_column_names",
    """WITH n AS (SELECT unnest(['nation key', 'name!', 'n_regionkey']) AS c) SELECT c AS "column", 'name_has_spaces' AS issue FROM n WHERE c LIKE '% %'
    UNION ALL SELECT c, 'name_has_specials' FROM n WHERE regexp_matches(c, '[^A-Za-z0-9_]')""",
)
def _(spark, sf):
    df = table(spark, sf, "nation").toDF("nation key", "name!", "n_regionkey")
    return Q.score_quality(df, dimensions=["integrity"]).issues().filter("issue like 'name%'").select("column", "issue")


DNUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DTXT = ["l_returnflag", "l_linestatus"]
DIST = (
    "WITH o AS ("
    + " UNION ALL ".join(
        f"""SELECT greatest(0, 100 - 10 * abs(skewness({c}))) AS sk, greatest(0, 100 - 5 * abs(kurtosis({c}))) AS ku,
    greatest(0, 100 - 500 * (avg(CASE WHEN {c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1) THEN 1.0 ELSE 0 END))) AS ou
    FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)"""
        for c in DNUM
    )
    + "), e AS ("
    + " UNION ALL ".join(
        f"SELECT 100 * entropy({c}) / log2(count(DISTINCT {c})) AS en FROM lineitem" for c in DTXT
    )
    + """) SELECT 'skewness' AS part, round(avg(sk), 4) AS value FROM o UNION ALL SELECT 'kurtosis', round(avg(ku), 4) FROM o
    UNION ALL SELECT 'outlier', round(avg(ou), 4) FROM o UNION ALL SELECT 'entropy', round(avg(en), 4) FROM e"""
)


@query("quality_distribution", DIST)
def _(spark, sf):
    return _part("distribution", Q.score_quality(table(spark, sf, "lineitem").select(*DNUM, *DTXT), dimensions=["distribution"]))


@query(
    "quality_ml_readiness",
    """WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'size' AS part, CASE WHEN count(*) < 100 THEN 20.0 WHEN count(*) < 1000 THEN 60 + count(*) / 1000.0 * 40 ELSE 100 END::DOUBLE AS value FROM orders
    UNION ALL SELECT 'features', 65.0 UNION ALL SELECT 'nulls', 100.0
    UNION ALL SELECT 'balance', 80.0
    UNION ALL SELECT 'collinearity', 100.0 - 10 * ((abs(corr(o_orderkey, o_custkey)) > 0.95)::INT + (abs(corr(o_orderkey, o_totalprice)) > 0.95)::INT + (abs(corr(o_custkey, o_totalprice)) > 0.95)::INT) FROM orders""",
)
def _(spark, sf):
    return _part("ml_readiness", Q.score_quality(table(spark, sf, "orders"), dimensions=["ml_readiness"]))


LI_COLS = [*DNUM, *DTXT]
SCORE_SQL = f"""WITH d AS ({DIST}), w AS (SELECT max(CASE WHEN part='skewness' THEN value END) * 0.3 + max(CASE WHEN part='kurtosis' THEN value END) * 0.2
   + max(CASE WHEN part='outlier' THEN value END) * 0.3 + max(CASE WHEN part='entropy' THEN value END) * 0.2 AS dist FROM d)
SELECT 'distribution' AS dimension, round(dist, 2) AS score, 0.1::DOUBLE AS weight FROM w
UNION ALL SELECT 'completeness', 100.0, 0.22
UNION ALL SELECT 'uniqueness', round(100.0 * (SELECT count(*) FROM (SELECT DISTINCT {', '.join(LI_COLS)} FROM lineitem)) / count(*), 2)::DOUBLE, 0.15 FROM lineitem
UNION ALL SELECT 'consistency', 100.0, 0.15
UNION ALL SELECT 'validity', 100.0 - least(30, 5 * count(*) FILTER (l_extendedprice < 0 OR l_extendedprice > 1e9))
   - {" - ".join(f"3 * (max(CASE WHEN {c} = upper({c}) THEN 1 ELSE 0 END) + max(CASE WHEN {c} = lower({c}) THEN 1 ELSE 0 END) + max(CASE WHEN {c} = upper(substr({c}, 1, 1)) || lower(substr({c}, 2)) THEN 1 ELSE 0 END) > 1)::INT" for c in DTXT)}, 0.18 FROM lineitem"""


@query("quality_scores", SCORE_SQL)
def _(spark, sf):
    q = Q.score_quality(table(spark, sf, "lineitem").select(*LI_COLS))
    out = q.scores().filter(~F.col("dimension").isin("integrity", "ml_readiness"))
    return out.withColumn("score", F.round("score", 2))


@query("quality_verdict")
def _(spark, sf):
    return Q.score_quality(gappy(spark, sf)).verdict()


@query("quality_recommendations")
def _(spark, sf):
    return Q.score_quality(_hint(spark, sf)).recommendations()


@query(
    "quality_mixed_types",
    f"""WITH h AS ({HINT}) SELECT 'label_text' AS "column", 0.0::DOUBLE AS numeric_share, false AS is_mixed
    UNION ALL SELECT 'padded', 0.0, false UNION ALL SELECT 'digits', avg((TRY_CAST(digits AS DOUBLE) IS NOT NULL)::INT), false FROM h""",
)
def _(spark, sf):
    return Q.mixed_types(_hint(spark, sf))
