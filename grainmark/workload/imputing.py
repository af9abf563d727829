from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import impute as I
from .registry import GAPPY_SQL, gappy, per, query, table

G = f"WITH g AS ({GAPPY_SQL}) "
HOLES = ["quantity", "discount", "price", "flag"]
ALL = ["l_orderkey", "l_partkey", "l_suppkey", "quantity", "discount", "price", "flag", "status", "shipped"]
GAPS = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in HOLES)


@query(
    "analyze_missing",
    G
    + f"""SELECT count(*) AS n_rows, CAST(sum({GAPS}) AS BIGINT) AS n_missing, count(*) FILTER ({GAPS} = 0) AS rows_complete,
    count(*) FILTER ({GAPS} > 0) AS rows_with_missing, CAST(max({GAPS}) AS BIGINT) AS max_missing_in_row,
    round(sum({GAPS}) / (count(*) * 9.0), 6) AS missing_rate FROM g""",
)
def _(spark, sf):
    return I.analyze_missing(gappy(spark, sf)).withColumn("missing_rate", F.round("missing_rate", 6))


@query(
    "missing_by_column",
    G
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, round((count(*) - count({c})) * 100.0 / count(*), 4) AS pct_missing,
    {'false' if c in ('flag', 'status', 'shipped') else 'true'} AS is_numeric FROM g"""
        for c in ALL
    ),
)
def _(spark, sf):
    return I.missing_by_column(gappy(spark, sf)).withColumn("pct_missing", F.round("pct_missing", 4))


@query(
    "missing_mask",
    G + "SELECT " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in ALL) + " FROM g",
)
def _(spark, sf):
    return I.missing_mask(gappy(spark, sf))


@query(
    "mask_correlation",
    G
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} IS NULL AS INTEGER), CAST({b} IS NULL AS INTEGER)), 6) AS r FROM g"
        for i, a in enumerate(HOLES)
        for b in HOLES[i + 1 :]
    ),
)
def _(spark, sf):
    return I.mask_correlation(gappy(spark, sf)).withColumn("r", F.round("r", 6))


@query("missing_mechanism")
def _(spark, sf):
    return I.missing_mechanism(gappy(spark, sf))


def _simple(expr: str) -> str:
    nums = ", ".join(f"round(coalesce({c}, (SELECT {expr.format(c=c)} FROM g)), 6) AS {c}" for c in ("quantity", "discount", "price"))
    return G + f"SELECT l_orderkey, l_partkey, {nums}, coalesce(flag, (SELECT flag FROM g WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag FROM g"


def _rounded(df):
    return df.select(
        "l_orderkey", "l_partkey", *[F.round(c, 6).alias(c) for c in ("quantity", "discount", "price")], "flag"
    )


for _s, _e in (("mean", "avg({c})"), ("median", "median({c})"), ("min", "min({c})"), ("max", "max({c})")):

    def _run(spark, sf, how=_s):
        return _rounded(I.impute_simple(gappy(spark, sf), how))

    query(f"impute_{_s}", _simple(_e))(_run)


@query(
    "impute_mode",
    G
    + "SELECT l_orderkey, l_partkey, "
    + ", ".join(
        f"coalesce({c}, (SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS {c}" for c in HOLES
    )
    + " FROM g",
)
def _(spark, sf):
    return I.impute_simple(gappy(spark, sf), "mode").select("l_orderkey", "l_partkey", *HOLES)


@query(
    "impute_zero",
    G + "SELECT l_orderkey, coalesce(quantity, 0) AS quantity, coalesce(discount, 0) AS discount, coalesce(flag, '0') AS flag FROM g",
)
def _(spark, sf):
    return I.impute_simple(gappy(spark, sf), "zero").select("l_orderkey", "quantity", "discount", "flag")


@query(
    "impute_constant",
    G + "SELECT l_orderkey, coalesce(quantity, 99) AS quantity, coalesce(price, 99) AS price, coalesce(flag, '99') AS flag FROM g",
)
def _(spark, sf):
    return I.impute_constant(gappy(spark, sf), 99).select("l_orderkey", "quantity", "price", "flag")


@query(
    "impute_per_column",
    G
    + """SELECT l_orderkey, coalesce(quantity, (SELECT max(quantity) FROM g)) AS quantity, coalesce(price, (SELECT median(price) FROM g)) AS price,
    CAST(quantity IS NULL AS INTEGER) AS quantity_missing, CAST(price IS NULL AS INTEGER) AS price_missing FROM g""",
)
def _(spark, sf):
    out = I.impute_simple(gappy(spark, sf), {"quantity": "max", "price": "median"}, indicators=True)
    return out.select("l_orderkey", "quantity", "price", "quantity_missing", "price_missing")


@query("impute_drop", G + "SELECT * FROM g WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in HOLES))
def _(spark, sf):
    return I.impute_drop(gappy(spark, sf))


# Ordered fills: events by time, gaps where the type is 'error'.
EV = "SELECT event_id, ts, user_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS value, CASE WHEN value > 60 THEN NULL ELSE event_type END AS kind FROM events"


def _ev(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "event_id",
        "ts",
        "user_id",
        "CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE value END AS value",
        "CASE WHEN value > 60 THEN NULL ELSE event_type END AS kind",
    )


def _last(c, over="ORDER BY ts, event_id"):
    return f"last_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _first(c, over="ORDER BY ts, event_id"):
    return f"first_value({c} IGNORE NULLS) OVER ({over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(
    "impute_ffill",
    f"WITH e AS ({EV}) SELECT event_id, ts, user_id, coalesce({_last('value')}, {_first('value')}) AS value, coalesce({_last('kind')}, {_first('kind')}) AS kind FROM e",
)
def _(spark, sf):
    return I.impute_ffill(_ev(spark, sf), ["ts", "event_id"])


@query(
    "impute_bfill",
    f"WITH e AS ({EV}) SELECT event_id, ts, user_id, coalesce({_first('value')}, {_last('value')}) AS value, coalesce({_first('kind')}, {_last('kind')}) AS kind FROM e",
)
def _(spark, sf):
    return I.impute_bfill(_ev(spark, sf), ["ts", "event_id"])


BY_USER = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "impute_ffill_by_group",
    f"WITH e AS ({EV}) SELECT event_id, coalesce({_last('value', BY_USER)}, {_first('value', BY_USER)}) AS value FROM e",
)
def _(spark, sf):
    return I.impute_ffill(_ev(spark, sf), ["ts", "event_id"], ["value"], ["user_id"]).select("event_id", "value")


def _interp(over: str) -> str:
    cell = "CASE WHEN value IS NOT NULL THEN pos END"
    return f"""WITH e AS ({EV}), p AS (SELECT *, row_number() OVER ({over}) AS pos FROM e),
    n AS (SELECT *, {_last(cell, over)} AS pp, {_first(cell, over)} AS np, {_last('value', over)} AS pv, {_first('value', over)} AS nv FROM p)
    SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN pp IS NULL THEN nv WHEN np IS NULL THEN pv
      ELSE pv + (nv - pv) * (pos - pp) / (np - pp) END, 6) AS value FROM n"""


@query("impute_interpolate", _interp("ORDER BY ts, event_id"))
def _(spark, sf):
    out = I.impute_interpolate(_ev(spark, sf), ["ts", "event_id"], ["value"])
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("impute_timeseries_linear", _interp(BY_USER))
def _(spark, sf):
    out = I.impute_timeseries(_ev(spark, sf).drop("kind"), "ts", "user_id", "linear", tie=["event_id"])
    return out.select("event_id", F.round("value", 6).alias("value"))


@query(
    "impute_timeseries_locf",
    f"WITH e AS ({EV}) SELECT event_id, coalesce({_last('value', BY_USER)}, {_first('value', BY_USER)}) AS value, coalesce({_last('kind')}, {_first('kind')}) AS kind FROM e",
)
def _(spark, sf):
    out = I.impute_timeseries(_ev(spark, sf), "ts", "user_id", "locf", tie=["event_id"])
    return out.select("event_id", "value", "kind")


@query(
    "impute_timeseries_nocb",
    f"WITH e AS ({EV}) SELECT event_id, coalesce({_first('value', BY_USER)}, {_last('value', BY_USER)}) AS value FROM e",
)
def _(spark, sf):
    out = I.impute_timeseries(_ev(spark, sf).drop("kind"), "ts", "user_id", "nocb", tie=["event_id"])
    return out.select("event_id", "value")


@query(
    "impute_ffill_limited",
    f"""WITH e AS ({EV}), p AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM e),
    n AS (SELECT *, {_last('CASE WHEN value IS NOT NULL THEN pos END')} AS pp, {_last('value')} AS pv, {_first('value')} AS nv FROM p)
    SELECT event_id, coalesce(value, CASE WHEN pos - pp <= 1 THEN pv END, nv) AS value FROM n""",
)
def _(spark, sf):
    return I.impute_ffill(_ev(spark, sf), ["ts", "event_id"], ["value"], limit=1).select("event_id", "value")


@query("impute_timeseries_cubic")
def _(spark, sf):
    out = I.impute_timeseries(_ev(spark, sf).drop("kind"), "ts", "user_id", "cubic", tie=["event_id"])
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("impute_timeseries_spline")
def _(spark, sf):
    out = I.impute_timeseries(_ev(spark, sf).drop("kind"), "ts", None, "spline", tie=["event_id"])
    return out.select("event_id", F.round("value", 6).alias("value"))


for _s, _e in (("mean", "avg(quantity)"), ("median", "median(quantity)"), ("min", "min(quantity)"), ("max", "max(quantity)")):

    def _run(spark, sf, how=_s):
        df = gappy(spark, sf).select("l_orderkey", "l_suppkey", "quantity", "flag")
        out = I.impute_group(df, "l_suppkey", how)
        return out.select("l_orderkey", "l_suppkey", F.round("quantity", 6).alias("quantity"), "flag")

    query(
        f"impute_group_{_s}",
        G
        + f""", s AS (SELECT l_suppkey, {_e} AS q FROM g GROUP BY 1),
        m AS (SELECT l_suppkey, flag FROM (SELECT l_suppkey, flag, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, flag) AS r
          FROM g WHERE flag IS NOT NULL GROUP BY 1, 2) WHERE r = 1)
        SELECT g.l_orderkey, g.l_suppkey, round(coalesce(g.quantity, s.q, (SELECT avg(quantity) FROM g)), 6) AS quantity,
        coalesce(g.flag, m.flag, (SELECT flag FROM g WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag
        FROM g LEFT JOIN s ON g.l_suppkey = s.l_suppkey LEFT JOIN m ON g.l_suppkey = m.l_suppkey""",
    )(_run)


@query("impute_random")
def _(spark, sf):
    df = gappy(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "shipped", "quantity")
    return I.impute_random(df, ["quantity"], ["l_orderkey", "l_partkey", "l_suppkey", "shipped"])


@query(
    "extract_from_text",
    """WITH d AS (SELECT doc_id, text, CASE WHEN n_chars > 500 THEN NULL ELSE source END AS source FROM documents)
    SELECT doc_id, coalesce(source, nullif(regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)', 1), ''),
      CASE WHEN length(text) > 300 THEN substr(text, 1, 300) ELSE text END) AS source FROM d""",
)
def _(spark, sf):
    df = table(spark, sf, "documents").selectExpr(
        "doc_id", "text", "CASE WHEN n_chars > 500 THEN NULL ELSE source END AS source"
    )
    return I.extract_from_text(df, "source", "text", "([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)").drop("text")


@query(
    "imputation_audit",
    G
    + per(
        HOLES,
        """SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS n_before, CAST(0 AS BIGINT) AS n_after,
    CAST(count(*) - count({c}) AS BIGINT) AS n_filled, round((count(*) - count({c})) * 100.0 / count(*), 4) AS pct_filled FROM g""",
    ),
)
def _(spark, sf):
    df = gappy(spark, sf)
    return I.imputation_audit(df, I.impute_simple(df, "median")).withColumn("pct_filled", F.round("pct_filled", 4))


@query("smart_imputer_choice")
def _(spark, sf):
    df = gappy(spark, sf)
    rows = [("with_time", I.choose_imputer(table(spark, sf, "events"))), ("gappy", I.choose_imputer(df))]
    return spark.createDataFrame(rows, "source string, method string")
