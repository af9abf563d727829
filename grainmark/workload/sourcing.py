from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scratch import root
from ..sources import catalog as C
from ..sources import landing as L
from ..sources import names as N
from ..sources import readers as R
from .registry import GAPPY_SQL, gappy, query, table

G = f"WITH g AS ({GAPPY_SQL}) "


def _tmp(spark):
    return f"{root(spark)}/grainmark/{uuid.uuid4().hex}"


@query("read_table", "SELECT * FROM nation")
def _(spark, sf):
    return R.read_table(spark, f"{sf}/nation.parquet").df


@query("read_table_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer")
    path = _tmp(spark) + ".csv"
    R.write_output(df, path, "csv")
    return R.read_table(spark, path, df.schema).df


@query("read_table_json", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def _(spark, sf):
    path = _tmp(spark) + ".jsonl"
    R.write_output(table(spark, sf, "supplier"), path, "json")
    return R.read_table(spark, path).df


@query(
    "read_csv_resilient",
    "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, 'Orán' AS city FROM supplier",
)
def _(spark, sf):
    path = _tmp(spark) + ".csv"
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.lit("Orán").alias("city"))
    df.write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return R.read_csv_resilient(spark, path).df


@query(
    "read_json_flat",
    'SELECT n_nationkey::BIGINT AS "key", n_name AS "place.name", n_regionkey::BIGINT AS "place.region" FROM nation',
)
def _(spark, sf):
    path = _tmp(spark) + ".json"
    df = table(spark, sf, "nation")
    df.select(F.col("n_nationkey").alias("key"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("place")).write.json(path)
    return R.read_json_flat(spark, path).df


@query("write_output", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    path = _tmp(spark)
    R.write_output(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, "parquet")
    return spark.read.parquet(path)


@query("dedupe_columns", "SELECT n_nationkey AS a, n_name AS a_2, n_regionkey AS unnamed FROM nation")
def _(spark, sf):
    return N.with_distinct_names(table(spark, sf, "nation").toDF(" a", "a ", " "))


@query("clean_column_names", 'SELECT n_nationkey AS select_col, n_name AS "col_2_name", n_regionkey AS region_key FROM nation')
def _(spark, sf):
    return N.with_clean_names(table(spark, sf, "nation").toDF("select", "2 -name!", "region  key"))


@query(
    "cap_rows",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY sha256('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.cap_rows(df, ["o_orderkey"], max_rows=1000, sample_rows=500).df


@query(
    "smart_sample_random",
    "SELECT o_orderkey FROM orders ORDER BY sha256('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 200",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    return R.smart_sample(df, ["o_orderkey"], 200, small=100)


@query(
    "smart_sample_stratified",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('42|' || CAST(o_orderkey AS VARCHAR))) AS k FROM orders)
    SELECT o_orderkey, o_orderstatus FROM r WHERE k <= 300 // (SELECT count(DISTINCT o_orderstatus) FROM orders)""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.smart_sample(df, ["o_orderkey"], 300, "o_orderstatus", small=100, medium=1000)


@query(
    "guarded_sql",
    "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderstatus",
)
def _(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("grainmark_orders")
    return C.guarded_sql(
        spark, "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM grainmark_orders GROUP BY o_orderstatus"
    )


INV = {"orders": (6, 3, 2), "customer": (5, 3, 2), "part": (6, 3, 3), "documents": (5, 2, 3)}


@query(
    "table_inventory",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS n_rows, {c}::BIGINT AS n_columns, {n}::BIGINT AS numeric_columns, {x}::BIGINT AS text_columns FROM {t}"""
        for t, (c, n, x) in INV.items()
    ),
)
def _(spark, sf):
    return C.table_inventory({t: table(spark, sf, t) for t in INV})


KEYS = [
    C.ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"),
    C.ForeignKey("orders", "o_custkey", "customer", "c_custkey"),
]


@query(
    "table_summary",
    """SELECT column_name AS "column", CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS dtype,
    true AS nullable, column_name = 'c_custkey' AS primary_key, CASE WHEN column_name = 'c_nationkey' THEN 'nation.n_nationkey' ELSE '' END AS foreign_key FROM (DESCRIBE customer)""",
)
def _(spark, sf):
    return C.table_summary(table(spark, sf, "customer"), ["c_custkey"], KEYS)


@query("preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, sf):
    return C.preview(table(spark, sf, "orders"), 5, ["o_orderkey"])


@query(
    "quick_stats",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(min({c}), 4)::DOUBLE AS "min", round(max({c}), 4)::DOUBLE AS "max", round(avg({c}), 4) AS mean, CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM events"""
        for c in ("event_id", "user_id", "value")
    ),
)
def _(spark, sf):
    return C.quick_stats(table(spark, sf, "events"))


@query("template_preview", "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def _(spark, sf):
    return C.template_query(table(spark, sf, "part"), "preview", ["p_partkey"])


@query("template_count", "SELECT count(*) AS total FROM lineitem")
def _(spark, sf):
    return C.template_query(table(spark, sf, "lineitem"), "count")


@query(
    "template_columns",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 1000",
)
def _(spark, sf):
    return C.template_query(table(spark, sf, "orders"), "columns", ["o_orderkey"], columns=6, limit=1000)


@query("template_columns_all", "SELECT * FROM orders")
def _(spark, sf):
    return C.template_query(table(spark, sf, "orders"), "columns", ["o_orderkey"])


@query(
    "template_nulls",
    G + "SELECT quantity, price, l_orderkey, l_partkey FROM g WHERE quantity IS NULL OR price IS NULL OR l_orderkey IS NULL OR l_partkey IS NULL ORDER BY l_orderkey, l_partkey, quantity NULLS FIRST, price NULLS FIRST LIMIT 100",
)
def _(spark, sf):
    df = gappy(spark, sf).select("quantity", "price", "l_orderkey", "l_partkey")
    return C.template_query(df, "nulls", ["l_orderkey", "l_partkey", "quantity", "price"], limit=100)


@query(
    "template_nulls_all",
    G + "SELECT * FROM g WHERE l_orderkey IS NULL OR l_partkey IS NULL OR l_suppkey IS NULL OR quantity IS NULL OR discount IS NULL OR price IS NULL OR flag IS NULL OR status IS NULL OR shipped IS NULL",
)
def _(spark, sf):
    return C.template_query(gappy(spark, sf), "nulls")


@query("template_distinct", "SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 100")
def _(spark, sf):
    return C.template_query(table(spark, sf, "part").select("p_brand", "p_size"), "distinct", limit=100)


@query("template_distinct_all", "SELECT DISTINCT p_partkey FROM part ORDER BY 1")
def _(spark, sf):
    return C.template_query(table(spark, sf, "part").select("p_partkey", "p_size"), "distinct")


@query(
    "template_numeric",
    "SELECT min(value) AS min_val, max(value) AS max_val, round(avg(value), 6) AS avg_val, count(value) AS count_val FROM events",
)
def _(spark, sf):
    return C.template_query(table(spark, sf, "events").select("value", "event_type"), "numeric").withColumn("avg_val", F.round("avg_val", 6))


@query(
    "foreign_keys",
    """SELECT 'orders' AS "table", 'o_custkey' AS "column", 'customer' AS other, 'c_custkey' AS other_column, count(*) AS n_orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'customer', 'c_nationkey', 'nation', 'n_nationkey', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""",
)
def _(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("customer", "nation", "orders")}
    return C.foreign_keys(spark, KEYS).join(C.fk_violations(tables, KEYS), ["table", "column"])


@query("fk_violations", """SELECT 'orders' AS "table", 'o_custkey' AS "column", count(*) AS n_orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'customer', 'c_nationkey', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)""")
def _(spark, sf):
    return C.fk_violations({t: table(spark, sf, t) for t in ("customer", "nation", "orders")}, KEYS)


@query(
    "join_on_fk",
    "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("customer", "nation", "orders")}
    return C.join_on_fk(tables, C.suggest_joins(KEYS, "orders")[0]).select("o_orderkey", "c_name", "c_mktsegment")


# Columns as text, the way a CSV would deliver them.
TEXTY = [
    "CAST(event_id AS STRING) AS event_id",
    "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS STRING) END AS amount",
    "CASE WHEN event_type = 'view' THEN 'Yes' ELSE 'no' END AS viewed",
    "date_format(ts, 'yyyy-MM-dd') AS day",
    "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS at",
    "props",
    "event_type",
]


def _texty(spark, sf):
    return table(spark, sf, "events").selectExpr(*TEXTY)


@query(
    "detect_column_types",
    """WITH n AS (SELECT count(*)::DOUBLE AS n FROM events)
    SELECT 'event_id' AS "column", 'INTEGER' AS type, 0::BIGINT AS n_missing, count(DISTINCT event_id) AS n_distinct, round(count(DISTINCT event_id) / count(*)::DOUBLE, 4) AS unique_ratio, count(DISTINCT event_id) / count(*)::DOUBLE > 0.95 AS is_id, false AS is_text, true AS is_index FROM events
    UNION ALL SELECT 'amount', 'REAL', CAST(count(*) FILTER (event_type = 'error') AS BIGINT), count(DISTINCT value) FILTER (event_type <> 'error'), round((count(DISTINCT value) FILTER (event_type <> 'error')) / count(*)::DOUBLE, 4), false, false, (count(DISTINCT value) FILTER (event_type <> 'error')) / count(*)::DOUBLE < 0.05 FROM events
    UNION ALL SELECT 'viewed', 'BOOLEAN', 0, 2, round(2 / count(*)::DOUBLE, 4), false, false, true FROM events
    UNION ALL SELECT 'day', 'DATE', 0, count(DISTINCT CAST(ts AS DATE)), round(count(DISTINCT CAST(ts AS DATE)) / count(*)::DOUBLE, 4), false, false, count(DISTINCT CAST(ts AS DATE)) / count(*)::DOUBLE < 0.05 FROM events
    UNION ALL SELECT 'at', 'DATETIME', 0, count(DISTINCT date_trunc('second', ts)), round(count(DISTINCT date_trunc('second', ts)) / count(*)::DOUBLE, 4), false, false, count(DISTINCT date_trunc('second', ts)) / count(*)::DOUBLE < 0.05 FROM events
    UNION ALL SELECT 'props', 'JSON', 0, count(DISTINCT props), round(count(DISTINCT props) / count(*)::DOUBLE, 4), false, false, count(DISTINCT props) / count(*)::DOUBLE < 0.05 FROM events
    UNION ALL SELECT 'event_type', 'TEXT', 0, count(DISTINCT event_type), round(count(DISTINCT event_type) / count(*)::DOUBLE, 4), false, false, true FROM events""",
)
def _(spark, sf):
    return L.detect_column_types(_texty(spark, sf))


@query(
    "cast_to_detected",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS amount, CAST(event_type = 'view' AS INTEGER) AS viewed,
    strftime(CAST(ts AS DATE), '%Y-%m-%d') || ' 00:00:00' AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, props, event_type FROM events""",
)
def _(spark, sf):
    df = _texty(spark, sf)
    return L.cast_to_detected(df, L.type_map(L.detect_column_types(df)))


@query("add_audit_columns", "SELECT *, 'region.parquet' AS __source_file FROM region")
def _(spark, sf):
    return L.add_audit_columns(table(spark, sf, "region"), "region.parquet").drop("__loaded_at")


@query(
    "validate_for_landing",
    """WITH s AS (SELECT l_returnflag, CASE WHEN l_quantity > 10 THEN NULL ELSE l_linestatus END AS status, NULL AS gone FROM lineitem)
    SELECT 'warning' AS level, 'all_null' AS kind, 'gone' AS "column", 1.0::DOUBLE AS value UNION ALL SELECT 'warning', 'mostly_null', 'gone', 1.0
    UNION ALL SELECT 'warning', 'mostly_null', 'status', round(1 - count(status) / count(*)::DOUBLE, 6) FROM s HAVING 1 - count(status) / count(*)::DOUBLE > 0.5
    UNION ALL SELECT 'warning', 'duplicates', NULL, ((SELECT count(*) FROM s) - count(*))::DOUBLE FROM (SELECT DISTINCT * FROM s)""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_returnflag", "CASE WHEN l_quantity > 10 THEN NULL ELSE l_linestatus END AS status", "CAST(NULL AS STRING) AS gone"
    )
    return L.validate_for_landing(df).withColumn("value", F.round("value", 6))


OLD, NEW = "o_orderstatus = 'F'", "o_totalprice > 250000"


def _sides(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.filter(OLD), o.filter(NEW).withColumn("o_totalprice", F.col("o_totalprice") + 1)


def _land(mode):
    def run(spark, sf):
        old, new = _sides(spark, sf)
        path = _tmp(spark)
        L.land_table(old, path, "replace")
        return L.land_table(new, path, mode, ["o_orderkey"])

    return run


A_SQL = f"SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE {OLD}"
B_SQL = f"SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_orderstatus FROM orders WHERE {NEW}"
query("land_replace", B_SQL)(_land("replace"))
query("land_append", f"{A_SQL} UNION ALL {B_SQL}")(_land("append"))
query("land_skip", A_SQL)(_land("skip"))
query(
    "land_upsert",
    f"WITH a AS ({A_SQL}), b AS ({B_SQL}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)",
)(_land("upsert"))
query(
    "land_ignore",
    f"WITH a AS ({A_SQL}), b AS ({B_SQL}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)",
)(_land("ignore"))


@query(
    "keep_last",
    """SELECT user_id, max(ts) AS ts, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""",
)
def _(spark, sf):
    df = table(spark, sf, "events").select("user_id", "ts", "event_id")
    return L.keep_last(df, ["user_id"], F.struct("ts", "event_id"))


@query("landing_metadata")
def _(spark, sf):
    return L.landing_metadata(table(spark, sf, "orders"), "orders", "orders.parquet", key=["o_orderkey"])


@query("preview_schema")
def _(spark, sf):
    types, _checks, _rows, ddl = L.preview_schema(_texty(spark, sf), "events.csv")
    return types.select("column", "type").withColumn("ddl", F.lit(ddl))


@query(
    "land_many",
    " UNION ALL ".join(
        f"SELECT (SELECT count(*) FROM {t}) AS n_rows, CAST((SELECT count(*) FROM (DESCRIBE {t})) + 2 AS INTEGER) AS n_columns, 'ok' AS status" for t in ("nation", "region", "supplier")
    )
    + " UNION ALL SELECT 0, 0, 'failed'",
)
def _(spark, sf):
    paths = []
    for t in ("nation", "region", "supplier"):
        p = f"{_tmp(spark)}_{t}.csv"
        R.write_output(table(spark, sf, t), p, "csv")
        paths.append(p)
    out = L.land_many(spark, [*paths, f"{_tmp(spark)}_absent.csv"], _tmp(spark))
    return out.select("n_rows", "n_columns", "status")


@query(
    "union_tables",
    """SELECT c_custkey, c_acctbal AS acctbal, NULL::BIGINT AS s_suppkey FROM customer UNION ALL SELECT NULL, s_acctbal, s_suppkey FROM supplier""",
)
def _(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal AS acctbal")
    return R.union_tables(c, table(spark, sf, "supplier").selectExpr("s_suppkey", "s_acctbal AS acctbal"))


@query(
    "compare_datasets",
    """SELECT 'customer' AS dataset, count(*) AS n_rows, 5::BIGINT AS n_columns, 0::BIGINT AS null_cells, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS BIGINT) AS n_duplicates FROM customer
    UNION ALL SELECT 'supplier', count(*), 4, 0, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM supplier)) AS BIGINT) FROM supplier""",
)
def _(spark, sf):
    out = L.compare_datasets({t: table(spark, sf, t) for t in ("customer", "supplier")})
    return out.select("dataset", "n_rows", "n_columns", "null_cells", "n_duplicates")


@query("best_dataset")
def _(spark, sf):
    return L.best_dataset(L.compare_datasets({t: table(spark, sf, t) for t in ("customer", "supplier")}))


