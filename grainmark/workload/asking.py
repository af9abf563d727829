from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ask
from ..operators.ask import Question
from .registry import GAPPY_SQL, gappy, per, query, table

G = f"WITH g AS ({GAPPY_SQL}) "


@query(
    "ask_filter",
    """SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
    WHERE o_totalprice > 200000 AND o_totalprice < 300000 AND lower(o_orderstatus) = 'f'""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return ask.where(df, [("o_totalprice", ">", 200000), ("o_totalprice", "<", 300000), ("o_orderstatus", "==", "f")])


@query(
    "ask_aggregate",
    G + "SELECT round(avg(price), 4) AS value FROM g WHERE quantity > 10 AND lower(status) = 'o'",
)
def _(spark, sf):
    q = Question("aggregate", ["price"], [("quantity", ">", 10), ("status", "==", "O")], "mean")
    return ask.answer(gappy(spark, sf), q).select(F.round("value", 4).alias("value"))


for _how, _fn in (("sum", "sum"), ("max", "max"), ("min", "min"), ("count", "count"), ("std", "stddev_samp")):

    def _run(spark, sf, how=_how):
        out = ask.aggregate(gappy(spark, sf), "quantity", how)
        return out if how == "count" else out.select(F.round("value", 4).alias("value"))

    _val = "count(quantity)" if _how == "count" else f"round({_fn}(quantity), 4)"
    query(f"ask_aggregate_{_how}", G + f"SELECT {_val} AS value FROM g")(_run)


@query(
    "ask_group_aggregate",
    """SELECT c_nationkey AS "group", round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1 ORDER BY value DESC, 1 LIMIT 5""",
)
def _(spark, sf):
    return ask.group_aggregate(table(spark, sf, "customer"), "c_nationkey", "c_acctbal", "mean")


@query(
    "ask_sort_desc",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    q = Question("sort", order_by="o_totalprice", ascending=False, tie=["o_orderkey"])
    return ask.answer(df, q)


@query("ask_sort_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ask.sort(df, "o_totalprice", tie=["o_orderkey"])


@query(
    "ask_describe_numeric",
    """SELECT round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, min(value) AS "min", max(value) AS "max",
    round(median(value), 5) AS median FROM events""",
)
def _(spark, sf):
    out = ask.describe(table(spark, sf, "events"), "value")
    return out.select(*[F.round(c, 5).alias(c) for c in ("mean", "std", "min", "max", "median")])


@query(
    "ask_describe_text",
    "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
)
def _(spark, sf):
    return ask.describe(table(spark, sf, "orders"), "o_orderpriority")


@query(
    "ask_missing",
    G
    + per(
        ["quantity", "discount", "price", "flag"],
        "SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM g",
    ),
)
def _(spark, sf):
    return ask.missing(gappy(spark, sf))


@query("ask_unique", "SELECT DISTINCT p_brand AS value FROM part ORDER BY 1 LIMIT 20")
def _(spark, sf):
    return ask.unique(table(spark, sf, "part"), "p_brand")


@query(
    "ask_overview",
    G
    + """SELECT count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns,
    CAST(4 * count(*) - count(quantity) - count(discount) - count(price) - count(flag) AS BIGINT) AS null_cells FROM g""",
)
def _(spark, sf):
    return ask.overview(gappy(spark, sf))


@query(
    "ask_compare",
    G
    + """SELECT round(corr(quantity, price), 6) AS r,
    CASE WHEN abs(corr(quantity, price)) > 0.7 THEN 'strong' WHEN abs(corr(quantity, price)) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
    CASE WHEN corr(quantity, price) > 0 THEN 'positive' ELSE 'negative' END AS direction,
    round(avg(quantity), 4) AS mean_a, round(avg(price), 4) AS mean_b FROM g""",
)
def _(spark, sf):
    out = ask.answer(gappy(spark, sf), Question("compare", ["quantity", "price"]))
    return out.select(
        F.round("r", 6).alias("r"), "strength", "direction", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b")
    )
