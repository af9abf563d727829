from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scratch import root
from ..operators import fingerprint as P
from ..operators import history as H
from .registry import query, table

# Snapshots derived from orders: one per (status, year), measured by aggregation.
SNAP = """SELECT md5(o_orderstatus) AS file_hash, o_orderstatus AS file_path, o_orderstatus AS file_name, make_timestamp(CAST(year(o_orderdate) AS BIGINT), 1, 1, 0, 0, 0) AS taken_at,
 count(*) AS n_rows, count(DISTINCT o_orderpriority) AS n_columns, count(*) FILTER (o_totalprice > 300000) AS n_missing, count(*) - count(DISTINCT o_custkey) AS n_duplicates,
 CAST(floor(avg(o_totalprice) / 4000) AS BIGINT) AS ml_score, count(DISTINCT o_orderdate) AS outlier_columns FROM orders GROUP BY o_orderstatus, year(o_orderdate)"""


def _snaps(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderstatus", F.year("o_orderdate").alias("y")).agg(
        F.md5(F.first("o_orderstatus")).alias("file_hash"),
        F.first("o_orderstatus").alias("file_path"),
        F.first("o_orderstatus").alias("file_name"),
        F.make_timestamp(F.first(F.year("o_orderdate")), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("taken_at"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("o_orderpriority").alias("n_columns"),
        F.count(F.when(F.col("o_totalprice") > 300000, 1)).alias("n_missing"),
        (F.count(F.lit(1)) - F.count_distinct("o_custkey")).alias("n_duplicates"),
        F.floor(F.avg("o_totalprice") / 4000).alias("ml_score"),
        F.count_distinct("o_orderdate").alias("outlier_columns"),
    ).drop("o_orderstatus", "y")


@query("history", f"WITH s AS ({SNAP}) SELECT taken_at, n_rows, ml_score FROM s WHERE file_path = 'F' ORDER BY taken_at DESC LIMIT 3")
def _(spark, sf):
    return H.history(_snaps(spark, sf), "F", 3).select("taken_at", "n_rows", "ml_score")


@query(
    "compare_last_two",
    f"WITH s AS ({SNAP}), r AS (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY taken_at DESC) AS k FROM s), b AS (SELECT n.file_name, n, o FROM r n JOIN r o ON n.file_hash = o.file_hash AND n.k = 1 AND o.k = 2) "
    + " UNION ALL ".join(
        f"SELECT file_name, '{m}' AS measure, o.{m} AS old, n.{m} AS \"new\", n.{m} - o.{m} AS delta, n.{m} {'>' if m == 'ml_score' else '<'} o.{m} AS improved FROM b"
        for m in H.MEASURES
    ),
)
def _(spark, sf):
    return H.compare_last_two(_snaps(spark, sf))


@query(
    "all_files",
    f"WITH s AS ({SNAP}) SELECT file_hash, any_value(file_name) AS file_name, count(*) AS n_inspections, max(taken_at) AS last_seen, max(ml_score) AS best_score FROM s GROUP BY file_hash",
)
def _(spark, sf):
    return H.all_files(_snaps(spark, sf))


@query("clear_history", f"WITH s AS ({SNAP}) SELECT file_name, taken_at FROM s WHERE file_path <> 'F'")
def _(spark, sf):
    store = f"{root(spark)}/grainmark/{uuid.uuid4().hex}"
    _snaps(spark, sf).withColumn("detail", F.lit("")).write.parquet(store)
    H.clear_history(spark, store, "F")
    return H.load(spark, store).select("file_name", "taken_at")


@query(
    "save_snapshot",
    """SELECT md5('part.parquet') AS file_hash, 'part.parquet' AS file_name, count(*) AS n_rows, 6::BIGINT AS n_columns, 0::BIGINT AS n_missing,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM part)) AS BIGINT) AS n_duplicates FROM part""",
)
def _(spark, sf):
    store = f"{root(spark)}/grainmark/{uuid.uuid4().hex}"
    H.save_snapshot(table(spark, sf, "part"), "part.parquet", store)
    return H.load(spark, store).select("file_hash", "file_name", "n_rows", "n_columns", "n_missing", "n_duplicates")


@query("fingerprint")
def _(spark, sf):
    return P.fingerprint(table(spark, sf, "customer"), "customer", "c_mktsegment").drop("created_at")


@query(
    "fingerprint_entropy",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(entropy({c}), 5) AS entropy, count(DISTINCT {c}) AS n_distinct FROM part"
        for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    ),
)
def _(spark, sf):
    return P.entropies(table(spark, sf, "part")).withColumn("entropy", F.round("entropy", 5))


@query(
    "mutual_information",
    """WITH c AS (SELECT p_brand AS a, p_type AS b, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS rb, sum(n) OVER () AS t FROM c)
    SELECT 'p_brand' AS col_a, 'p_type' AS col_b, round(sum(n / t * log2(n * t / (ra * rb))), 6) AS bits FROM m""",
)
def _(spark, sf):
    return P.mutual_information(table(spark, sf, "part"), ["p_brand", "p_type"]).withColumn("bits", F.round("bits", 6))


# A store derived from orders: a "fingerprint" per customer and status.
STORE = """SELECT o_orderstatus AS source, sha256(CAST(o_orderkey AS VARCHAR)) AS fingerprint, o_orderdate AS created_at, sha256(o_orderpriority) AS correlation_hash,
 sha256(o_orderstatus) AS schema_hash, CASE WHEN o_totalprice > 250000 THEN 'regression' ELSE 'classification' END AS task, o_totalprice / 500000 AS separability, CAST(o_custkey % 101 AS BIGINT) AS ml_score,
 CASE WHEN o_orderstatus = 'F' THEN 'MAR' WHEN o_orderstatus = 'O' THEN 'MCAR' ELSE 'MNAR' END AS missing_mechanism, o_totalprice / 5000000 AS outlier_density, CASE WHEN o_custkey > 700 THEN 0.1 ELSE 0.0 END::DOUBLE AS duplicate_ratio,
 o_totalprice / 400000 AS redundancy, o_totalprice / 500000 AS class_balance, o_custkey > 500 AS has_temporal, CAST(o_custkey % 20 AS INTEGER) AS n_columns, o_orderkey FROM orders"""


def _store(spark, sf, printed="o_orderkey"):
    return table(spark, sf, "orders").selectExpr(
        "o_orderstatus AS source",
        f"sha2(CAST({printed} AS STRING), 256) AS fingerprint",
        "o_orderdate AS created_at",
        "sha2(o_orderpriority, 256) AS correlation_hash",
        "sha2(o_orderstatus, 256) AS schema_hash",
        "CASE WHEN o_totalprice > 250000 THEN 'regression' ELSE 'classification' END AS task",
        "o_totalprice / 500000 AS separability",
        "o_custkey % 101 AS ml_score",
        "CASE WHEN o_orderstatus = 'F' THEN 'MAR' WHEN o_orderstatus = 'O' THEN 'MCAR' ELSE 'MNAR' END AS missing_mechanism",
        "o_totalprice / 5000000 AS outlier_density",
        "CAST(CASE WHEN o_custkey > 700 THEN 0.1 ELSE 0.0 END AS DOUBLE) AS duplicate_ratio",
        "o_totalprice / 400000 AS redundancy",
        "o_totalprice / 500000 AS class_balance",
        "o_custkey > 500 AS has_temporal",
        "CAST(o_custkey % 20 AS INT) AS n_columns",
        "o_orderkey",
    )


def _probe(spark, sf):
    return _store(spark, sf).orderBy("o_orderkey").limit(1)


SIM = "((CASE WHEN s.correlation_hash = p.correlation_hash THEN 1.0 ELSE 0.5 END) + (CASE WHEN s.schema_hash = p.schema_hash THEN 1.0 ELSE 0.7 END)) / 2"
PROBE = f"WITH s AS ({STORE}), p AS (SELECT * FROM s ORDER BY o_orderkey LIMIT 1) "


@query(
    "fingerprint_similarity",
    PROBE
    + f""", q AS (SELECT * FROM s ORDER BY o_orderkey DESC LIMIT 1) SELECT round({SIM.replace('s.', 'q.')}, 4)::DOUBLE AS similarity,
    concat_ws(',', CASE WHEN q.schema_hash <> p.schema_hash THEN 'schema' END, CASE WHEN q.task <> p.task THEN 'task' END) AS differences, CASE WHEN {SIM.replace('s.', 'q.')} > 0.8 THEN 'similar' ELSE 'drifted' END AS verdict FROM q, p""",
)
def _(spark, sf):
    other = _store(spark, sf).orderBy(F.desc("o_orderkey")).limit(1)
    out = P.similarity(_probe(spark, sf), other)
    return out.select(F.round("similarity", 4).alias("similarity"), "differences", "verdict")


@query(
    "find_similar",
    PROBE
    + f"SELECT s.fingerprint, s.source, s.task, ({SIM})::DOUBLE AS similarity FROM s, p WHERE s.fingerprint <> p.fingerprint AND s.task = 'classification' AND {SIM} >= 0.5 ORDER BY similarity DESC, s.fingerprint LIMIT 10",
)
def _(spark, sf):
    return P.find_similar(_store(spark, sf), _probe(spark, sf), 10, task="classification")


@query(
    "fingerprint_store",
    f"""WITH s AS ({STORE.replace('sha256(CAST(o_orderkey AS VARCHAR))', 'sha256(CAST(o_custkey AS VARCHAR))')})
    SELECT fingerprint, min(created_at) AS created_at, max(ml_score) AS ml_score, count(*) AS n FROM s GROUP BY 1""",
)
def _(spark, sf):
    s = _store(spark, sf, "o_custkey").select("fingerprint", "created_at", "ml_score")
    return P.collapse(s, "n")


REC = "SELECT fingerprint, task || '_' || source AS strategy, CAST(o_orderkey AS VARCHAR) AS parameters, ml_score, o_orderkey FROM s"


@query(
    "recommend_strategy",
    PROBE
    + f""", r AS ({REC}), m AS (SELECT s.fingerprint, ({SIM})::DOUBLE AS similarity FROM s, p WHERE s.fingerprint <> p.fingerprint AND {SIM} >= 0.5),
    w AS (SELECT strategy, sum(ml_score / 100.0 * similarity) AS weight, count(*) AS n_used FROM r JOIN m USING (fingerprint) WHERE ml_score >= 65 GROUP BY 1)
    SELECT strategy, round(weight, 4) AS weight, n_used, round(weight / (SELECT sum(weight) FROM w), 3) AS confidence FROM w ORDER BY weight DESC, strategy LIMIT 1""",
)
def _(spark, sf):
    s = _store(spark, sf)
    rec = s.selectExpr("fingerprint", "concat(task, '_', source) AS strategy", "CAST(o_orderkey AS STRING) AS parameters", "ml_score")
    sim = P.find_similar(s, _probe(spark, sf), None)
    return P.recommend(sim, rec).select("strategy", F.round("weight", 4).alias("weight"), "n_used", "confidence")


@query(
    "strategy_rules",
    f"""WITH s AS ({STORE}) SELECT source, CASE WHEN missing_mechanism IN ('NONE', 'MCAR') THEN 'mean' WHEN missing_mechanism = 'MAR' THEN 'median' ELSE 'mode' END AS missing_strategy, duplicate_ratio > 0 AS remove_duplicates,
    redundancy < 0.8 AS scale, true AS encode, task = 'classification' AND class_balance < 0.7 AS handle_imbalance, outlier_density > 0.05 AS treat_outliers, has_temporal OR n_columns < 10 AS feature_engineering FROM s""",
)
def _(spark, sf):
    return P.strategy_rules(_store(spark, sf))


@query("select_strategy")
def _(spark, sf):
    s = _store(spark, sf)
    rec = s.selectExpr("fingerprint", "concat(task, '_', source) AS strategy", "CAST(o_orderkey AS STRING) AS parameters", "ml_score")
    return P.select_strategy(_probe(spark, sf), P.recommend(P.find_similar(s, _probe(spark, sf), None), rec))


@query(
    "fingerprint_evolution",
    f"""WITH s AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) AS cust, x.* FROM ({STORE}) x JOIN orders o ON o.o_orderkey = x.o_orderkey), r AS (SELECT *, row_number() OVER w AS version, lag(correlation_hash) OVER w AS pc, lag(schema_hash) OVER w AS ps, lag(separability) OVER w AS pp FROM s WINDOW w AS (PARTITION BY cust ORDER BY created_at, o_orderkey)),
    t AS (SELECT *, (CASE WHEN correlation_hash = pc THEN 1.0 ELSE 0.5 END + CASE WHEN schema_hash = ps THEN 1.0 ELSE 0.7 END) / 2 AS sim FROM r)
    SELECT fingerprint, CAST(version AS INTEGER) AS version, CASE WHEN pc IS NULL THEN 'new' WHEN sim >= 0.95 THEN 'stable' WHEN sim >= 0.75 THEN 'minor_drift' WHEN sim >= 0.5 THEN 'moderate_drift' ELSE 'major_drift' END AS trend,
    CASE WHEN pc IS NULL THEN NULL WHEN separability - pp > 0.1 THEN 'improving' WHEN separability - pp < -0.1 THEN 'degrading' ELSE 'stable' END AS ml_trend FROM t""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cust"))
    s = _store(spark, sf).join(o, "o_orderkey").drop("source").withColumnRenamed("cust", "source")
    s = s.withColumn("created_at", F.struct("created_at", "o_orderkey"))  # a total order within a customer
    return P.evolution(s).select("fingerprint", "version", "trend", "ml_trend")
