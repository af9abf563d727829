from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as O
from .registry import GAPPY_SQL, gappy, query, table

G = f"WITH g AS ({GAPPY_SQL}) "


def _ev(spark, sf):
    return table(spark, sf, "events").select("event_id", "value")


@query(
    "iqr_outliers",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
    f AS (SELECT q1 - 1.5*(q3-q1) AS lo, q3 + 1.5*(q3-q1) AS hi, q3 - q1 AS iqr FROM q)
    SELECT event_id, value, value < lo OR value > hi AS value__iqr,
    round(CASE WHEN value > hi THEN (value - hi) / (iqr + 1e-12) WHEN value < lo THEN (lo - value) / (iqr + 1e-12) ELSE 0 END, 6) AS value__iqr_score
    FROM events, f""",
)
def _(spark, sf):
    out = O.iqr_outliers(_ev(spark, sf), ["value"])
    return out.withColumn("value__iqr_score", F.round("value__iqr_score", 6))


@query(
    "zscore_outliers",
    """WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
    SELECT event_id, value, abs((value - m) / s) > 3 AS value__zscore, round(abs((value - m) / s), 6) AS value__zscore_score FROM events, q""",
)
def _(spark, sf):
    out = O.zscore_outliers(_ev(spark, sf), ["value"])
    return out.withColumn("value__zscore_score", F.round("value__zscore_score", 6))


@query(
    "modified_zscore_outliers",
    """WITH q AS (SELECT median(value) AS m FROM events), d AS (SELECT median(abs(value - m)) AS mad FROM events, q)
    SELECT event_id, value, abs(0.6745 * (value - m) / mad) > 3.5 AS value__modified_zscore,
    round(abs(0.6745 * (value - m) / mad), 6) AS value__modified_zscore_score FROM events, q, d""",
)
def _(spark, sf):
    out = O.modified_zscore_outliers(_ev(spark, sf), ["value"])
    return out.withColumn("value__modified_zscore_score", F.round("value__modified_zscore_score", 6))


UNION = """WITH e AS (SELECT event_id, value, user_id FROM events),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(user_id, 0.25) AS u1, quantile_cont(user_id, 0.75) AS u3,
 avg(value) AS m, stddev_samp(value) AS s, avg(user_id) AS um, stddev_samp(user_id) AS us, median(value) AS md, median(user_id) AS umd FROM e),
d AS (SELECT median(abs(value - md)) AS mad, median(abs(user_id - umd)) AS umad FROM e, q),
r AS (SELECT event_id,
 CASE WHEN value > q3 + 1.5*(q3-q1) THEN (value - q3 - 1.5*(q3-q1)) / (q3 - q1 + 1e-12) WHEN value < q1 - 1.5*(q3-q1) THEN (q1 - 1.5*(q3-q1) - value) / (q3 - q1 + 1e-12) ELSE 0 END AS s1,
 CASE WHEN user_id > u3 + 1.5*(u3-u1) THEN (user_id - u3 - 1.5*(u3-u1)) / (u3 - u1 + 1e-12) WHEN user_id < u1 - 1.5*(u3-u1) THEN (u1 - 1.5*(u3-u1) - user_id) / (u3 - u1 + 1e-12) ELSE 0 END AS s2,
 abs((value - m) / s) AS s3, abs((user_id - um) / us) AS s4, abs(0.6745 * (value - md) / mad) AS s5, abs(0.6745 * (user_id - umd) / umad) AS s6 FROM e, q, d),
l AS (SELECT min(s1) AS a1, max(s1) AS b1, min(s2) AS a2, max(s2) AS b2, min(s3) AS a3, max(s3) AS b3, min(s4) AS a4, max(s4) AS b4, min(s5) AS a5, max(s5) AS b5, min(s6) AS a6, max(s6) AS b6 FROM r),
u AS (SELECT event_id, s1 > 0 OR s2 > 0 OR s3 > 3 OR s4 > 3 OR s5 > 3.5 OR s6 > 3.5 AS is_outlier,
 ((CASE WHEN b1 - a1 < 1e-12 THEN 0 ELSE (s1 - a1) / (b1 - a1) END) + (CASE WHEN b2 - a2 < 1e-12 THEN 0 ELSE (s2 - a2) / (b2 - a2) END)
 + (s3 - a3) / (b3 - a3) + (s4 - a4) / (b4 - a4) + (s5 - a5) / (b5 - a5) + (s6 - a6) / (b6 - a6)) / 6 AS outlier_score FROM r, l) """


@query("statistical_union", UNION + "SELECT event_id, is_outlier, round(outlier_score, 6) AS outlier_score FROM u")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    out = O.statistical_union(df, ["value", "user_id"])
    return out.select("event_id", "is_outlier", F.round("outlier_score", 6).alias("outlier_score"))


@query("drop_outliers", UNION + "SELECT e.event_id, e.value, e.user_id FROM e JOIN u ON e.event_id = u.event_id WHERE NOT is_outlier")
def _(spark, sf):
    from ..operators import clean

    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    return clean.drop_outliers(O.statistical_union(df, ["value", "user_id"])).select("event_id", "value", "user_id")


@query(
    "ensemble_vote",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s, median(value) AS md FROM events),
    d AS (SELECT median(abs(value - md)) AS mad FROM events, q),
    f AS (SELECT event_id, CAST(value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1) AS INTEGER) AS a, CAST(abs((value - m) / s) > 3 AS INTEGER) AS b,
      CAST(abs(0.6745 * (value - md) / mad) > 3.5 AS INTEGER) AS c FROM events, q, d)
    SELECT event_id, round((a + b + c) / 3.0, 6)::DOUBLE AS vote_share, (a + b + c) / 3.0 >= 0.5 AS is_outlier FROM f""",
)
def _(spark, sf):
    out = _flagged(spark, sf)
    return out.select("event_id", F.round("vote_share", 6).alias("vote_share"), "is_outlier")


def _flagged(spark, sf):
    df = _ev(spark, sf)
    for det in (O.fit_iqr(df, ["value"]), O.fit_zscore(df, ["value"]), O.fit_modified_zscore(df, ["value"])):
        df = O.apply(df, det)
    return O.vote(df, ["value__iqr", "value__zscore", "value__modified_zscore"])


@query(
    "ensemble_agreement",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS s, median(value) AS md FROM events),
    d AS (SELECT median(abs(value - md)) AS mad FROM events, q),
    f AS (SELECT event_id, CAST(value < q1 - 1.5*(q3-q1) OR value > q3 + 1.5*(q3-q1) AS INTEGER) AS a, CAST(abs((value - m) / s) > 3 AS INTEGER) AS b,
      CAST(abs(0.6745 * (value - md) / mad) > 3.5 AS INTEGER) AS c FROM events, q, d),
    u AS (SELECT 'value__iqr' AS method, sum(a) AS n FROM f UNION ALL SELECT 'value__zscore', sum(b) FROM f UNION ALL SELECT 'value__modified_zscore', sum(c) FROM f
     UNION ALL SELECT 'is_outlier', sum(CASE WHEN a + b + c >= 2 THEN 1 ELSE 0 END) FROM f)
    SELECT method, CAST(n AS BIGINT) AS n_outliers, round(n / (SELECT count(*) FROM f)::DOUBLE, 6) AS rate FROM u""",
)
def _(spark, sf):
    out = O.agreement(_flagged(spark, sf), ["value__iqr", "value__zscore", "value__modified_zscore"])
    return out.withColumn("rate", F.round("rate", 6))


@query(
    "outlier_report",
    G
    + " UNION ALL ".join(
        f"""SELECT * FROM (WITH q AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s, median({c}) AS md FROM g),
    d AS (SELECT median(abs({c} - md)) AS mad FROM g, q),
    f AS (SELECT coalesce({c} < q1 - 1.5*(q3-q1) OR {c} > q3 + 1.5*(q3-q1), false) AS a, coalesce(abs(({c} - m) / s) > 3, false) AS b,
      coalesce(abs(0.6745 * ({c} - md) / mad) > 3.5, false) AS x FROM g, q, d)
    SELECT 'iqr' AS method, '{c}' AS "column", count(*) FILTER (a) AS n_outliers, round(count(*) FILTER (a) / count(*)::DOUBLE, 6) AS rate FROM f
    UNION ALL SELECT 'zscore', '{c}', count(*) FILTER (b), round(count(*) FILTER (b) / count(*)::DOUBLE, 6) FROM f
    UNION ALL SELECT 'modified_zscore', '{c}', count(*) FILTER (x), round(count(*) FILTER (x) / count(*)::DOUBLE, 6) FROM f)"""
        for c in ("quantity", "price")
    ),
)
def _(spark, sf):
    out = O.outlier_report(gappy(spark, sf), ["quantity", "price"])
    return out.withColumn("rate", F.round("rate", 6))


@query("grubbs_outliers")
def _(spark, sf):
    return O.grubbs_outliers(table(spark, sf, "events"), "value", ["event_id"])


@query("grubbs_flagged_rows")
def _(spark, sf):
    df = _ev(spark, sf)
    found = O.grubbs_outliers(df, "value", ["event_id"])
    return O.flag_rows(df, found, ["event_id"]).filter("is_outlier")


@query(
    "grubbs_test",
    """SELECT 'value' AS "column", round(greatest(max(value) - avg(value), avg(value) - min(value)) / stddev_samp(value), 6) AS statistic,
    CASE WHEN max(value) - avg(value) > avg(value) - min(value) THEN max(value) ELSE min(value) END AS value FROM events""",
)
def _(spark, sf):
    out = O.grubbs_test(table(spark, sf, "events"), ["value"])
    return out.select("column", F.round("statistic", 6).alias("statistic"), "value")


@query("gesd_test")
def _(spark, sf):
    return O.gesd_test(table(spark, sf, "events"), "value", ["event_id"])


DIX = """WITH t AS (SELECT o_custkey, list_sort(list(o_totalprice)) AS xs, count(*) AS n FROM orders GROUP BY 1
  HAVING count(*) BETWEEN 3 AND 30 AND max(o_totalprice) > min(o_totalprice)),
 q AS (SELECT *, (xs[2] - xs[1]) / (xs[n] - xs[1]) AS ql, (xs[n] - xs[n-1]) / (xs[n] - xs[1]) AS qh,
  CASE n WHEN 3 THEN 0.941 WHEN 4 THEN 0.765 WHEN 5 THEN 0.642 WHEN 6 THEN 0.560 WHEN 7 THEN 0.507 WHEN 8 THEN 0.468 WHEN 9 THEN 0.437 WHEN 10 THEN 0.412 ELSE {d} END::DOUBLE AS qc FROM t)
 SELECT o_custkey, n, round(ql, 6) AS q_low, round(qh, 6) AS q_high, qc AS q_critical, ql > qc AS low_is_outlier, qh > qc AS high_is_outlier FROM q"""


def _dix(spark, sf, beyond):
    out = O.dixon(table(spark, sf, "orders"), "o_totalprice", ["o_custkey"], beyond)
    return out.select(
        "o_custkey", "n", F.round("q_low", 6).alias("q_low"), F.round("q_high", 6).alias("q_high"), "q_critical", "low_is_outlier", "high_is_outlier"
    )


@query("dixon_outliers", DIX.replace("{d}", "0.412"))
def _(spark, sf):
    return _dix(spark, sf, 0.412)


@query("dixon_q_test", DIX.replace("{d}", "0.3"))
def _(spark, sf):
    return _dix(spark, sf, 0.3)


@query("smart_outlier_choice")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ev = table(spark, sf, "events").select("value")
    rows = [("lineitem", O.choose_method(li)), ("events", O.choose_method(ev))]
    return spark.createDataFrame(rows, "source string, method string")


@query("outlier_recommendations")
def _(spark, sf):
    return O.recommendations(_flagged(spark, sf), ["value__iqr", "value__zscore", "value__modified_zscore"])
