from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outlier_models as M
from ..operators import resample as R
from ..operators.neighbours import knn
from .registry import query, table

CUST = ["c_acctbal", "c_nationkey"]


def _cust(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", *CUST, "c_mktsegment")


@query(
    "knn_distances",
    """WITH d AS (SELECT a.c_custkey AS lid, sqrt(pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.c_nationkey - b.c_nationkey, 2)) AS dist,
     row_number() OVER (PARTITION BY a.c_custkey ORDER BY pow(a.c_acctbal - b.c_acctbal, 2) + pow(a.c_nationkey - b.c_nationkey, 2)) AS place FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey)
    SELECT lid, CAST(place AS INTEGER) AS place, round(dist, 8) AS dist FROM d WHERE place <= 5""",
)
def _(spark, sf):
    out = knn(_cust(spark, sf), None, "c_custkey", CUST, 5, cell_rows=100)
    return out.select("lid", "place", F.round("dist", 8).alias("dist"))


LOF = """WITH s AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey::DOUBLE AS y FROM supplier),
d AS (SELECT a.id AS p, b.id AS o, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM s a JOIN s b ON a.id <> b.id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY dist) AS k FROM d) WHERE k <= 20),
kd AS (SELECT p, max(dist) AS kd FROM n GROUP BY p), l AS (SELECT n.p, 1 / (avg(greatest(n.dist, kd.kd)) + 1e-10) AS lrd FROM n JOIN kd ON n.o = kd.p GROUP BY n.p)
SELECT n.p AS s_suppkey, round(avg(b.lrd) / any_value(a.lrd), 6) AS lof FROM n JOIN l a ON n.p = a.p JOIN l b ON n.o = b.p GROUP BY n.p"""


@query("local_outlier_factor", LOF)
def _(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    out = M.local_outlier_factor(df, "s_suppkey", ["s_acctbal", "s_nationkey"])
    return out.select("s_suppkey", F.round("lof", 6).alias("lof"))


@query(
    "dbscan_noise",
    """WITH z AS (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS x, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER () AS y FROM customer),
    d AS (SELECT a.id AS p, b.id AS o, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM z a JOIN z b ON a.id <> b.id),
    k AS (SELECT p, dist FROM (SELECT p, dist, row_number() OVER (PARTITION BY p ORDER BY dist) AS r FROM d) WHERE r = 4), e AS (SELECT quantile_cont(dist, 0.9) AS eps FROM k),
    c AS (SELECT p, dist <= eps AS core FROM k, e), m AS (SELECT DISTINCT d.p FROM d, e WHERE dist <= eps AND d.o IN (SELECT p FROM c WHERE core))
    SELECT c.p AS c_custkey, core AS is_core, NOT core AND c.p NOT IN (SELECT p FROM m) AS is_outlier FROM c""",
)
def _(spark, sf):
    return M.dbscan_noise(_cust(spark, sf), "c_custkey", CUST)


@query("robust_mahalanobis")
def _(spark, sf):
    return M.robust_mahalanobis(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id", "value"])


@query("elliptic_envelope")
def _(spark, sf):
    return M.elliptic_envelope(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id", "value"])


@query("isolation_forest")
def _(spark, sf):
    return M.isolation_forest(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id", "value"])


@query("one_class_svm")
def _(spark, sf):
    return M.one_class_svm(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id", "value"], rounds=5)


@query("outlier_ensemble")
def _(spark, sf):
    return M.ensemble(table(spark, sf, "events").select("event_id", "user_id", "value"), "event_id")


@query("smart_outliers")
def _(spark, sf):
    return M.smart_outliers(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_suppkey")


@query("benchmark_outliers")
def _(spark, sf):
    return M.benchmark_outliers(table(spark, sf, "events").select("event_id", "user_id", "value"), "event_id")


def _labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("source").alias("source_length"), F.col("text"))
    d = d.withColumn("n_words", F.regexp_count("text", F.lit(r"\S+"))).drop("text")
    return d.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")


FEAT = ["n_chars", "source_length", "n_words"]


@query(
    "smote_class_sizes",
    "SELECT toxic, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic)) AS n FROM labels JOIN documents USING (doc_id) GROUP BY toxic",
)
def _(spark, sf):
    return R.smote(_labelled(spark, sf), "toxic", "doc_id", FEAT).groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))


@query("smote")
def _(spark, sf):
    return R.smote(_labelled(spark, sf), "toxic", "doc_id", FEAT)


@query("adasyn")
def _(spark, sf):
    return R.adasyn(_labelled(spark, sf), "toxic", "doc_id", FEAT)


@query(
    "tomek_links",
    """WITH c AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey AS y, CAST(c_nationkey < 12 AS INTEGER) AS t FROM customer),
    n AS (SELECT p, o FROM (SELECT a.id AS p, b.id AS o, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2), b.id) AS k FROM c a JOIN c b ON a.id <> b.id) WHERE k = 1)
    SELECT a.p AS lid, a.o AS rid FROM n a JOIN n b ON a.p = b.o AND a.o = b.p JOIN c x ON x.id = a.p JOIN c y ON y.id = a.o WHERE a.p < a.o AND x.t <> y.t""",
)
def _(spark, sf):
    df = _cust(spark, sf).withColumn("t", (F.col("c_nationkey") < 12).cast("int"))
    return R.tomek_links(df, "t", "c_custkey", CUST)


@query("smote_tomek")
def _(spark, sf):
    return R.smote_tomek(_labelled(spark, sf), "toxic", "doc_id", FEAT)
