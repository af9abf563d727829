from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advise as A
from .registry import gappy, query, table


READY = """WITH t AS (SELECT event_id, user_id, event_type, value FROM events), o AS (SELECT
  (SELECT count(*) FROM t, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM t) WHERE value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1)) > 0 AS a,
  (SELECT count(*) FROM t, (SELECT quantile_cont(user_id, 0.25) AS q1, quantile_cont(user_id, 0.75) AS q3 FROM t) WHERE user_id < q1 - 1.5*(q3-q1) OR user_id > q3 + 1.5*(q3-q1)) > 0 AS b,
  (SELECT count(*) FROM t, (SELECT quantile_cont(event_id, 0.25) AS q1, quantile_cont(event_id, 0.75) AS q3 FROM t) WHERE event_id < q1 - 1.5*(q3-q1) OR event_id > q3 + 1.5*(q3-q1)) > 0 AS c),
k AS (SELECT a::INT + b::INT + c::INT AS n FROM o),
u AS (SELECT 'size' AS "check", CASE WHEN count(*) >= 1000 THEN 20 WHEN count(*) >= 200 THEN 14 WHEN count(*) >= 50 THEN 8 ELSE 0 END AS points, 20 AS max_points FROM t
UNION ALL SELECT 'missing', 25, 25
UNION ALL SELECT 'outliers', CASE WHEN n = 0 THEN 15 WHEN n / 3.0 <= 0.25 THEN 10 WHEN n / 3.0 <= 0.5 THEN 6 ELSE 1 END, 15 FROM k
UNION ALL SELECT 'duplicates', CASE WHEN count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) THEN 10 ELSE 0 END, 10 FROM t
UNION ALL SELECT 'useless', 15, 15
UNION ALL SELECT 'types', 9, 15) """


def _ready(spark, sf):
    return A.ml_readiness(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"))


@query("ml_readiness", READY + 'SELECT "check", points, max_points FROM u')
def _(spark, sf):
    return _ready(spark, sf).select("check", "points", "max_points")


@query(
    "ml_readiness_grade",
    READY
    + """SELECT CAST(sum(points) AS BIGINT) AS score, CASE WHEN sum(points) >= 90 THEN 'A' WHEN sum(points) >= 75 THEN 'B' WHEN sum(points) >= 60 THEN 'C' WHEN sum(points) >= 40 THEN 'D' ELSE 'F' END AS grade FROM u""",
)
def _(spark, sf):
    return A.readiness_grade(_ready(spark, sf)).select("score", "grade")


# (position, class name hint, regression name hint) of each column of orders;
# the hint 'y' is a substring of every '…key' and of 'priority'
TS = """WITH n AS (SELECT count(*) AS n FROM orders), d AS (
 SELECT 'o_orderkey' AS c, 0 AS i, 1 AS ch, 0 AS rh, 1 AS num, count(DISTINCT o_orderkey) AS d FROM orders
 UNION ALL SELECT 'o_custkey', 1, 1, 0, 1, count(DISTINCT o_custkey) FROM orders
 UNION ALL SELECT 'o_orderstatus', 2, 1, 0, 0, count(DISTINCT o_orderstatus) FROM orders
 UNION ALL SELECT 'o_totalprice', 3, 0, 1, 1, count(DISTINCT o_totalprice) FROM orders
 UNION ALL SELECT 'o_orderdate', 4, 0, 0, 0, count(DISTINCT o_orderdate) FROM orders
 UNION ALL SELECT 'o_orderpriority', 5, 1, 0, 0, count(DISTINCT o_orderpriority) FROM orders),
s AS (SELECT c, d, ch, rh, num, i, CASE WHEN i = 5 THEN 30 WHEN i = 0 THEN -20 ELSE 0 END + 40 * ch + 35 * rh + CASE WHEN d = 2 THEN 35 ELSE 0 END
 + CASE WHEN d <= 10 THEN 25 WHEN d / n::DOUBLE >= 0.95 AND num = 1 THEN -15 WHEN d / n::DOUBLE >= 0.95 THEN -30 ELSE 0 END + CASE WHEN num = 1 AND d > 20 THEN 15 ELSE 0 END AS score FROM d, n),
r AS (SELECT c, CAST(score AS INTEGER) AS score, d, i, CASE WHEN d <= 10 THEN 'classification' WHEN rh = 1 THEN 'regression' WHEN ch = 1 THEN 'classification' WHEN num = 1 AND d > 20 THEN 'regression' ELSE 'unknown' END AS task FROM s) """


@query("target_scores", TS + 'SELECT c AS "column", score, d AS n_distinct, task FROM r')
def _(spark, sf):
    return A.target_scores(table(spark, sf, "orders"))


@query(
    "detect_target",
    TS
    + """, o AS (SELECT *, row_number() OVER (ORDER BY score DESC, i) AS k FROM r)
    SELECT a.c AS recommended, a.task, CASE WHEN a.score - b.score >= 30 OR a.score >= 60 THEN 'high' WHEN a.score - b.score >= 15 OR a.score >= 35 THEN 'medium' ELSE 'low' END AS confidence, a.score
    FROM o a, o b WHERE a.k = 1 AND b.k = 2""",
)
def _(spark, sf):
    return A.detect_target(table(spark, sf, "orders"))


@query(
    "detect_task",
    """SELECT 'toxic' AS target, CASE WHEN count(DISTINCT toxic) = 2 THEN 'binary' ELSE 'multiclass' END AS task FROM labels
    UNION ALL SELECT 'event_type', CASE WHEN count(DISTINCT event_type) = 2 THEN 'binary' ELSE 'multiclass' END FROM events
    UNION ALL SELECT 'value', CASE WHEN count(DISTINCT value) = 2 THEN 'binary' WHEN count(DISTINCT value) <= 20 THEN 'multiclass' ELSE 'regression' END FROM events""",
)
def _(spark, sf):
    rows = [(t, A.detect_task(table(spark, sf, src), t)) for src, t in (("labels", "toxic"), ("events", "event_type"), ("events", "value"))]
    return spark.createDataFrame(rows, "target string, task string")


def _adv(src: str, col: str, times: str) -> str:
    return f"""WITH c AS (SELECT {col} AS v, count(*) AS n FROM {src} GROUP BY 1), t AS (SELECT sum(n) AS n, max(n) / min(n)::DOUBLE AS r, min(n) AS lo FROM c)
    SELECT 'classification' AS task, CASE WHEN '{times}' <> '' THEN 'time' WHEN r > 3 THEN 'stratified' ELSE 'random' END AS strategy,
    CASE WHEN n < 1000 THEN 0.2 WHEN n < 10000 THEN 0.15 ELSE 0.1 END::DOUBLE AS test_size, CAST(CASE WHEN n < 50 THEN 3 WHEN lo < 5 THEN greatest(2, lo) ELSE 5 END AS INTEGER) AS cv_folds,
    r > 3 AS stratify, '{times}' AS time_columns FROM t"""


@query("advise_split", _adv("labels", "toxic", ""))
def _(spark, sf):
    return A.advise_split(table(spark, sf, "labels"), "toxic")


@query("advise_split_time", _adv("orders", "o_orderstatus", "o_orderdate"))
def _(spark, sf):
    return A.advise_split(table(spark, sf, "orders"), "o_orderstatus")


H = "sha256('42|' || CAST({k} AS VARCHAR))"
# first 52 bits of the hash as a number in [0, 1)
UNIT = "(CAST(('0x' || substr(" + H + ", 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


@query("split_random", f"SELECT o_orderkey, {UNIT.format(k='o_orderkey')} < 0.2 AS is_test FROM orders")
def _(spark, sf):
    return A.split_random(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "split_stratified",
    f"""SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {H.format(k='o_orderkey')})
     <= round(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) AS is_test FROM orders""",
)
def _(spark, sf):
    return A.split_stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])


@query(
    "split_by_time",
    """SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) > count(*) OVER () - round(count(*) OVER () * 0.2) AS is_test FROM events""",
)
def _(spark, sf):
    return A.split_by_time(table(spark, sf, "events").select("event_id", "ts"), "ts", tie=["event_id"])


@query("k_folds", f"SELECT o_orderkey, CAST(floor({UNIT.format(k='o_orderkey')} * 5) AS INTEGER) AS fold FROM orders")
def _(spark, sf):
    return A.k_folds(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query(
    "stratified_folds",
    f"""SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderstatus, {H.format(k='o_orderkey')}) - 1) % 5 AS INTEGER) AS fold FROM orders""",
)
def _(spark, sf):
    out = A.stratified_folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])
    return out.select("o_orderkey", "fold")


@query(
    "time_folds",
    "SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 5 / count(*) OVER ()) AS INTEGER) AS fold FROM events",
)
def _(spark, sf):
    return A.time_folds(table(spark, sf, "events").select("event_id", "ts"), "ts", tie=["event_id"]).drop("ts")


IMB = "WITH c AS (SELECT {t} AS v, count(*) AS n FROM {s} WHERE {t} IS NOT NULL GROUP BY 1) "


@query(
    "class_distribution",
    IMB.format(t="toxic", s="labels")
    + 'SELECT CAST(v AS VARCHAR) AS "class", n, round(n * 100.0 / (SELECT sum(n) FROM c), 2)::DOUBLE AS pct FROM c',
)
def _(spark, sf):
    return A.class_distribution(table(spark, sf, "labels"), "toxic").withColumn("pct", F.col("pct").cast("double"))


@query(
    "detect_imbalance",
    IMB.format(t="toxic", s="labels")
    + """, r AS (SELECT count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS minority, max(n) AS majority, round(max(n) / min(n)::DOUBLE, 2) AS ratio FROM c)
    SELECT *, CASE WHEN ratio < 1.5 THEN 'none' WHEN ratio < 3 THEN 'mild' WHEN ratio < 10 THEN 'moderate' WHEN ratio < 100 THEN 'severe' ELSE 'extreme' END AS severity,
    CASE WHEN ratio < 1.5 THEN 'none' WHEN minority < 6 THEN 'class_weights' WHEN ratio >= 10 THEN 'smote_tomek' WHEN ratio >= 3 THEN 'smote' ELSE 'class_weights' END AS recommended FROM r""",
)
def _(spark, sf):
    return A.detect_imbalance(table(spark, sf, "labels"), "toxic").drop("warnings")


@query(
    "imbalance_strategies",
    IMB.format(t="toxic", s="labels")
    + """, r AS (SELECT sum(n) AS t, min(n) AS lo, round(max(n) / min(n)::DOUBLE, 2) AS r FROM c)
    SELECT 'smote' AS strategy, r >= 3 AS recommended FROM r WHERE lo >= 6 UNION ALL SELECT 'adasyn', r >= 5 FROM r WHERE lo >= 6
    UNION ALL SELECT 'smote_tomek', r >= 10 FROM r WHERE lo >= 6 UNION ALL SELECT 'class_weights', r < 10 OR lo < 6 FROM r
    UNION ALL SELECT 'under_sampling', t > 1000 AND r < 20 FROM r""",
)
def _(spark, sf):
    return A.imbalance_strategies(table(spark, sf, "labels"), "toxic")


@query(
    "class_weights",
    IMB.format(t="lang", s="documents")
    + """SELECT v AS "class", round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE), 6) AS weight FROM c""",
)
def _(spark, sf):
    return A.class_weights(table(spark, sf, "documents"), "lang").withColumn("weight", F.round("weight", 6))


@query(
    "with_class_weights",
    IMB.format(t="lang", s="documents")
    + "SELECT doc_id, lang, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE), 6) AS weight FROM documents JOIN c ON lang = v",
)
def _(spark, sf):
    out = A.with_class_weights(table(spark, sf, "documents").select("doc_id", "lang"), "lang")
    return out.withColumn("weight", F.round("weight", 6))


@query(
    "under_sample",
    f"""WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {H.format(k='doc_id')}) AS k FROM labels)
    SELECT doc_id, toxic FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))""",
)
def _(spark, sf):
    return A.under_sample(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", ["doc_id"])


@query(
    "id_columns",
    """SELECT 'c_custkey' AS "column" FROM customer HAVING count(DISTINCT c_custkey) / count(*)::DOUBLE >= 0.98
    UNION ALL SELECT 'c_nationkey' FROM customer HAVING count(DISTINCT c_nationkey) / count(*)::DOUBLE >= 0.98""",
)
def _(spark, sf):
    return A.id_columns(table(spark, sf, "customer"))


@query(
    "high_cardinality_text",
    """SELECT 'c_name' AS "column", count(DISTINCT c_name) AS n_distinct FROM customer HAVING count(DISTINCT c_name) / count(*)::DOUBLE >= 0.4 AND count(DISTINCT c_name) > 30
    UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer HAVING count(DISTINCT c_mktsegment) / count(*)::DOUBLE >= 0.4 AND count(DISTINCT c_mktsegment) > 30""",
)
def _(spark, sf):
    return A.high_cardinality_text(table(spark, sf, "customer"))


@query(
    "leakage_hints",
    """SELECT 'vec_id' AS "column", 'identifier' AS reason FROM embeddings HAVING count(DISTINCT vec_id) / count(*)::DOUBLE >= 0.98
    UNION ALL SELECT 'label', 'outcome_name'""",
)
def _(spark, sf):
    return A.leakage_hints(table(spark, sf, "embeddings").select("vec_id", "label"))


@query("analyst_report")
def _(spark, sf):
    return A.analyst_report(gappy(spark, sf))


@query("analyst_risk")
def _(spark, sf):
    return A.analyst_risk(A.analyst_report(table(spark, sf, "customer")))


