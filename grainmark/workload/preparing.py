from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import features as J
from .registry import query, table



@query(
    "date_features",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
    CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_day_of_week,
    CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS o_orderdate_is_weekend FROM orders""",
)
def _(spark, sf):
    return J.date_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).drop("o_orderdate")


@query(
    "date_features_from_text",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS day_text_year, CAST(month(o_orderdate) AS INTEGER) AS day_text_month,
    CAST(day(o_orderdate) AS INTEGER) AS day_text_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_text_day_of_week,
    CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS day_text_is_weekend FROM orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"))
    return J.date_features(J.parsed_dates(df)).drop("day_text")


@query(
    "numeric_features",
    """SELECT l_orderkey, l_quantity, l_discount, round(ln(1 + l_quantity), 8) AS l_quantity_log, l_quantity * l_quantity AS l_quantity_squared,
    round(l_discount * l_discount, 8) AS l_discount_squared FROM lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    out = J.numeric_features(df, ["l_quantity", "l_discount"])
    return out.withColumns({c: F.round(c, 8) for c in ("l_quantity_log", "l_discount_squared")})


@query(
    "interactions",
    """SELECT l_orderkey, round(l_quantity * l_extendedprice, 4) AS l_quantity_x_l_extendedprice, round(l_quantity * l_discount, 4) AS l_quantity_x_l_discount,
    round(l_quantity * l_tax, 4) AS l_quantity_x_l_tax, round(l_extendedprice * l_discount, 4) AS l_extendedprice_x_l_discount,
    round(l_extendedprice * l_tax, 4) AS l_extendedprice_x_l_tax FROM lineitem""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = J.interactions(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], limit=5)
    made = [c for c in out.columns if "_x_" in c]
    return out.select("l_orderkey", *[F.round(c, 4).alias(c) for c in made])


@query(
    "interactions_all",
    "SELECT p_partkey, round(p_partkey::DOUBLE * p_size, 4) AS p_partkey_x_p_size, round(p_partkey * p_retailprice, 4) AS p_partkey_x_p_retailprice, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice FROM part",
)
def _(spark, sf):
    out = J.interactions(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"))
    return out.select("p_partkey", *[F.round(c, 4).alias(c) for c in out.columns if "_x_" in c])


@query(
    "text_features",
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length,
    CAST(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS INTEGER) AS text_word_count FROM documents""",
)
def _(spark, sf):
    return J.text_features(table(spark, sf, "documents").select("doc_id", "text"), ["text"]).drop("text")


@query(
    "engineer_features",
    """SELECT p_partkey, p_size, CAST(length(p_name) AS INTEGER) AS p_name_length, round(ln(1 + p_size), 8) AS p_size_log,
    CAST(p_size * p_size AS DOUBLE) AS p_size_squared, round(p_size * p_retailprice, 4) AS p_size_x_p_retailprice FROM part""",
)
def _(spark, sf):
    out = J.engineer_features(table(spark, sf, "part"))
    return out.select(
        "p_partkey",
        "p_size",
        "p_name_length",
        F.round("p_size_log", 8).alias("p_size_log"),
        "p_size_squared",
        F.round("p_size_x_p_retailprice", 4).alias("p_size_x_p_retailprice"),
    )


@query("drop_useless", "SELECT c_custkey, c_mktsegment FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment", "'x' AS same")
    return J.drop_useless(df)


@query(
    "label_encode",
    """SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type FROM part""",
)
def _(spark, sf):
    return J.label_encode(table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"))


@query(
    "label_encode_by_frequency",
    """WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS k FROM part GROUP BY 1)
    SELECT p_partkey, CAST(k AS INTEGER) AS p_brand FROM part JOIN c USING (p_brand)""",
)
def _(spark, sf):
    return J.label_encode(table(spark, sf, "part").select("p_partkey", "p_brand"), by="frequency")


@query(
    "label_encode_large",
    """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS c_name FROM customer""",
)
def _(spark, sf):
    return J.label_encode(table(spark, sf, "customer").select("c_custkey", "c_name"))


@query(
    "standard_scale",
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg(l_extendedprice) AS pm, stddev_samp(l_extendedprice) AS ps FROM lineitem)
    SELECT l_orderkey, round((l_quantity - m) / s, 5) AS l_quantity, round((l_extendedprice - pm) / ps, 5) AS l_extendedprice FROM lineitem, s""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    return J.standard_scale(df, ["l_quantity", "l_extendedprice"], digits=5)


@query(
    "minmax_scale",
    """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT l_orderkey, round((l_quantity - lo) / (hi - lo), 6) AS l_quantity FROM lineitem, s""",
)
def _(spark, sf):
    out = J.minmax_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), ["l_quantity"])
    return out.withColumn("l_quantity", F.round("l_quantity", 6))


@query(
    "robust_scale",
    """WITH s AS (SELECT median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS w FROM lineitem)
    SELECT l_orderkey, round((l_extendedprice - m) / w, 6) AS l_extendedprice FROM lineitem, s""",
)
def _(spark, sf):
    out = J.robust_scale(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), ["l_extendedprice"])
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


PREP = """WITH src AS (SELECT DISTINCT l_partkey, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS flag, 'k' AS same FROM lineitem),
f AS (SELECT l_partkey, coalesce(quantity, (SELECT median(quantity) FROM src)) AS quantity,
  coalesce(flag, (SELECT flag FROM src WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag FROM src),
e AS (SELECT l_partkey, quantity, dense_rank() OVER (ORDER BY flag) - 1 AS flag FROM f),
s AS (SELECT avg(l_partkey) AS m1, stddev_samp(l_partkey) AS s1, avg(quantity) AS m2, stddev_samp(quantity) AS s2, avg(flag) AS m3, stddev_samp(flag) AS s3 FROM e) """


def _prep(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_partkey",
        "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS quantity",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS flag",
        "'k' AS same",
    )
    return J.prepare_for_ml(df, "median")


@query(
    "prepare_for_ml",
    PREP
    + "SELECT round((l_partkey - m1) / s1, 6) AS l_partkey, round((quantity - m2) / s2, 6) AS quantity, round((flag - m3) / s3, 6) AS flag FROM e, s",
)
def _(spark, sf):
    return _prep(spark, sf)[0]


@query(
    "prepare_log",
    PREP
    + """SELECT 'duplicates_removed' AS step, NULL AS "column", CAST((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM src) AS BIGINT) AS n
    UNION ALL SELECT 'filled', 'quantity', CAST(count(*) - count(quantity) AS BIGINT) FROM src
    UNION ALL SELECT 'filled', 'flag', CAST(count(*) - count(flag) AS BIGINT) FROM src""",
)
def _(spark, sf):
    return _prep(spark, sf)[1].filter("n is not null").select("step", "column", "n")


# ---- encoding ----

PCOLS = ["p_name", "p_brand", "p_type"]


@query(
    "encoding_profile",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH c AS (SELECT {c} AS v, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1), t AS (SELECT count(*) AS tn, avg(p_retailprice) AS gm, var_pop(p_retailprice) AS vp FROM part)
    SELECT '{c}' AS "column", count(*) AS n_distinct, CASE WHEN count(*) <= 10 THEN 'low' WHEN count(*) <= 50 THEN 'medium' WHEN count(*) <= 200 THEN 'high' ELSE 'very_high' END AS cardinality,
    round(-sum(n / any_n * log2(n / any_n)), 5) AS entropy, round(max(n) / min(n)::DOUBLE, 5) AS imbalance, round(sum(n * (m - gm) * (m - gm)) / (any_value(vp) * any_value(any_n)), 5) AS target_corr
    FROM (SELECT *, tn::DOUBLE AS any_n FROM c, t))"""
        for c in PCOLS
    ),
)
def _(spark, sf):
    out = E.encoding_profile(table(spark, sf, "part"), "p_retailprice")
    return out.select(
        "column",
        "n_distinct",
        "cardinality",
        F.round("entropy", 5).alias("entropy"),
        F.round("imbalance", 5).alias("imbalance"),
        F.round("target_corr", 5).alias("target_corr"),
    )


ADV = [
    "CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS answer",
    "CASE WHEN p_size > 35 THEN 'High' WHEN p_size > 15 THEN 'Medium' ELSE 'Low' END AS level",
    "p_type",
    "p_brand",
    "p_name",
    "concat(p_brand, ' ', p_type) AS mix",
    "CAST(p_partkey AS STRING) AS code",
    "p_retailprice",
]


@query(
    "advise_encoding",
    """WITH n AS (SELECT 'answer' AS c, count(DISTINCT p_size > 25) AS d FROM part UNION ALL SELECT 'level', 3 UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
    UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part
    UNION ALL SELECT 'mix', count(DISTINCT p_brand || ' ' || p_type) FROM part UNION ALL SELECT 'code', count(*) FROM part),
    t AS (SELECT c, d, CASE WHEN c = 'p_name' THEN (SELECT sum(k * (m - g) * (m - g)) / any_value(v * n) FROM (SELECT count(*) AS k, avg(p_retailprice) AS m FROM part GROUP BY p_name), (SELECT avg(p_retailprice) AS g, var_pop(p_retailprice) AS v, count(*) AS n FROM part))
      WHEN c = 'mix' THEN (SELECT sum(k * (m - g) * (m - g)) / any_value(v * n) FROM (SELECT count(*) AS k, avg(p_retailprice) AS m FROM part GROUP BY p_brand, p_type), (SELECT avg(p_retailprice) AS g, var_pop(p_retailprice) AS v, count(*) AS n FROM part)) END AS eta FROM n)
    SELECT c AS "column", d AS n_distinct, CASE WHEN c = 'answer' THEN 'binary' WHEN c = 'level' THEN 'ordinal' WHEN d <= 10 THEN 'one_hot' WHEN d <= 50 THEN 'label'
      WHEN d <= 200 THEN CASE WHEN round(eta, 4) > 0.05 THEN 'target' ELSE 'frequency' END ELSE 'hash' END AS strategy FROM t""",
)
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr(*ADV)
    return E.advise_encoding(df, "p_retailprice").select("column", "n_distinct", "strategy")


@query("encoding_summary")
def _(spark, sf):
    return E.encoding_summary(E.advise_encoding(table(spark, sf, "part").selectExpr(*ADV), "p_retailprice", "linear"))


@query(
    "encode_one_hot",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O",
    CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM orders""",
)
def _(spark, sf):
    return E.one_hot(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")


@query(
    "encode_ordinal",
    "SELECT p_partkey, CAST(CASE WHEN p_size > 35 THEN 2 WHEN p_size > 15 THEN 1 ELSE 0 END AS INTEGER) AS level FROM part",
)
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", ADV[1])
    return E.ordinal(df, "level", ["low", "medium", "high"])


@query(
    "encode_binary",
    """WITH c AS (SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) AS k FROM part)
    SELECT p_partkey, CAST((k >> 2) & 1 AS INTEGER) AS p_type_0, CAST((k >> 1) & 1 AS INTEGER) AS p_type_1, CAST(k & 1 AS INTEGER) AS p_type_2 FROM c""",
)
def _(spark, sf):
    return E.binary_code(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type")


@query(
    "encode_target",
    "SELECT p_partkey, p_brand, round(avg(p_retailprice) OVER (PARTITION BY p_brand), 5) AS p_brand_target FROM part",
)
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    out = E.target_mean(df, "p_brand", "p_retailprice").drop("p_retailprice")
    return out.withColumn("p_brand_target", F.round("p_brand_target", 5))


@query(
    "encode_frequency",
    "SELECT doc_id, source, round(count(*) OVER (PARTITION BY source) / (count(*) OVER ())::DOUBLE, 8) AS source_freq FROM documents",
)
def _(spark, sf):
    out = E.frequency(table(spark, sf, "documents").select("doc_id", "source"), "source")
    return out.withColumn("source_freq", F.round("source_freq", 8))


@query("encode_hash")
def _(spark, sf):
    return E.hashed(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name")


