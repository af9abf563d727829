from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, contracts, privacy
from .registry import GAPPY_SQL, gappy, per, query, table

G = f"WITH g AS ({GAPPY_SQL}) "


@query("remove_duplicates", "SELECT DISTINCT l_partkey, l_quantity, l_returnflag FROM lineitem")
def _(spark, sf):
    return clean.remove_duplicates(table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_returnflag"))


@query(
    "handle_missing_drop",
    G + "SELECT * FROM g WHERE quantity IS NOT NULL AND discount IS NOT NULL AND price IS NOT NULL AND flag IS NOT NULL",
)
def _(spark, sf):
    return clean.handle_missing(gappy(spark, sf), "drop")


def _filled(mean_like: str) -> str:
    mode = "(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    cols = ", ".join(
        f"coalesce({c}, (SELECT {mean_like.format(c=c)} FROM g)) AS {c}"
        if "mode" not in mean_like
        else f"coalesce({c}, {mode.format(c=c)}) AS {c}"
        for c in ("quantity", "discount", "price")
    )
    flag = "coalesce(flag, " + mode.format(c="flag") + ") AS flag"
    return G + f"SELECT l_orderkey, l_partkey, l_suppkey, {cols}, {flag}, status, shipped FROM g"


@query("handle_missing_mean", _filled("round(avg({c}), 4)"))
def _(spark, sf):
    return clean.handle_missing(gappy(spark, sf), "mean")


@query("handle_missing_median", _filled("median({c})"))
def _(spark, sf):
    return clean.handle_missing(gappy(spark, sf), "median")


@query("handle_missing_mode", _filled("mode"))
def _(spark, sf):
    return clean.handle_missing(gappy(spark, sf), "mode")


@query(
    "handle_missing_fill",
    G
    + """SELECT l_orderkey, l_partkey, l_suppkey, coalesce(quantity, 0) AS quantity, coalesce(discount, 0) AS discount,
    coalesce(price, 0) AS price, coalesce(flag, '0') AS flag, status, shipped FROM g""",
)
def _(spark, sf):
    return clean.handle_missing(gappy(spark, sf), "fill", 0)


@query(
    "fill_log",
    G
    + per(
        ["quantity", "discount", "price"],
        """SELECT '{c}' AS "column", 'median' AS strategy, CAST(count(*) - count({c}) AS BIGINT) AS n_filled,
        round(median({c}), 4) AS replacement FROM g""",
    ),
)
def _(spark, sf):
    log = clean.fill_log(gappy(spark, sf).drop("flag"), "median")
    return log.withColumn("replacement", F.round(F.col("replacement").cast("double"), 4))


SAFE_IN = """SELECT DISTINCT l_partkey, l_linestatus AS status, 1 AS one,
 CASE WHEN l_quantity > 25 THEN NULL ELSE l_quantity END AS quantity,
 CASE WHEN l_linenumber < 4 THEN NULL ELSE l_returnflag END AS flag FROM lineitem"""


def _safe_input(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey",
        "l_linestatus AS status",
        "1 AS one",
        "CASE WHEN l_quantity > 25 THEN NULL ELSE l_quantity END AS quantity",
        "CASE WHEN l_linenumber < 4 THEN NULL ELSE l_returnflag END AS flag",
    )


@query(
    "apply_safe_fixes",
    f"""WITH d AS ({SAFE_IN}) SELECT l_partkey, status,
    CASE WHEN (SELECT avg(CASE WHEN quantity IS NULL THEN 1.0 ELSE 0 END) FROM d) > 0.6 THEN quantity
         ELSE coalesce(quantity, (SELECT median(quantity) FROM d)) END AS quantity,
    CASE WHEN (SELECT avg(CASE WHEN flag IS NULL THEN 1.0 ELSE 0 END) FROM d) > 0.6 THEN flag
         ELSE coalesce(flag, (SELECT flag FROM d WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) END AS flag
    FROM d""",
)
def _(spark, sf):
    df = _safe_input(spark, sf)
    fixed, _log = clean.apply_safe_fixes(df, contracts.evaluate_contracts(df))
    return fixed


@query(
    "safe_fix_actions",
    f"""WITH d AS ({SAFE_IN})
    SELECT 'drop_duplicates' AS action, NULL AS "column", NULL AS strategy,
      CAST((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM d) AS BIGINT) AS n
    UNION ALL SELECT 'drop_constant_column', 'one', NULL, count(*) FROM d
    UNION ALL SELECT 'fill_missing', 'quantity', 'median', CAST(count(*) - count(quantity) AS BIGINT) FROM d
    UNION ALL SELECT 'fill_missing', 'flag', 'mode', CAST(count(*) - count(flag) AS BIGINT) FROM d""",
)
def _(spark, sf):
    df = _safe_input(spark, sf)
    return clean.apply_safe_fixes(df, contracts.evaluate_contracts(df))[1]


@query("repair_audit")
def _(spark, sf):
    df = _safe_input(spark, sf)
    fixed, log = clean.apply_safe_fixes(df, contracts.evaluate_contracts(df))
    return clean.repair_audit(df, fixed, log).drop("made_at")


# RE2 and Java read these patterns alike: ASCII \d, \s and \b.
def _hits(t: str, c: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{k}' AS pii_type,
        CAST(sum(CASE WHEN regexp_matches({c}, '{p}') THEN 1 ELSE 0 END) AS BIGINT) AS n_hits FROM {t}"""
        for k, p in privacy.PATTERNS.items()
    )


@query("detect_pii", f"SELECT * FROM ({_hits('documents', 'text')}) WHERE n_hits >= 2")
def _(spark, sf):
    return privacy.detect_pii(table(spark, sf, "documents").select("doc_id", "text"))


@query(
    "privacy_report",
    f"""WITH h AS (SELECT * FROM ({_hits('documents', 'text')} UNION ALL {_hits('documents', 'source')}) WHERE n_hits >= 2)
    SELECT count(DISTINCT pii_type) AS n_types, count(*) AS affected_columns,
    coalesce((SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT pii_type AS t FROM h)), '') AS pii_types,
    CASE WHEN count(DISTINCT pii_type) >= 3 THEN 'high' WHEN count(DISTINCT pii_type) >= 1 THEN 'medium' ELSE 'low' END AS risk_level,
    count(DISTINCT pii_type) = 0 AS safe_for_ml FROM h""",
)
def _(spark, sf):
    return privacy.privacy_report(table(spark, sf, "documents").select("doc_id", "text", "source")).drop("advice")


@query("anonymize_hash", "SELECT c_custkey, substr(sha256(c_name), 1, 8) AS c_name FROM customer")
def _(spark, sf):
    return privacy.anonymize_column(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "hash")


@query("anonymize_mask", G + "SELECT l_orderkey, CASE WHEN flag IS NULL THEN NULL ELSE '***' END AS flag FROM g")
def _(spark, sf):
    return privacy.anonymize_column(gappy(spark, sf).select("l_orderkey", "flag"), "flag", "mask")


@query("anonymize_drop", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer")
def _(spark, sf):
    return privacy.anonymize_column(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", "drop")


@query(
    "anonymize_fake_id",
    """SELECT o_orderkey, 'ID_' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS VARCHAR), 6, '0') AS o_orderpriority,
    o_orderdate FROM orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return privacy.anonymize_column(df, "o_orderpriority", "fake_id", ["o_orderdate", "o_orderkey"])


@query(
    "cap_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, round(least(greatest(value, q1 - 1.5*(q3-q1)), q3 + 1.5*(q3-q1)), 6) AS value FROM events, q""",
)
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value")
    return clean.cap_outliers(df, ["value"]).withColumn("value", F.round("value", 6))
