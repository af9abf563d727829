from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import drift, relate
from .registry import GAPPY_SQL, LINE_NUM, gappy, per, query, table

G = f"WITH g AS ({GAPPY_SQL}) "
NUM = ["quantity", "discount", "price"]


@query(
    "pearson_pairs",
    G
    + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r, count({a} + {b}) AS n FROM g"
        for a, b in combinations(NUM, 2)
    ),
)
def _(spark, sf):
    return relate.pearson_pairs(gappy(spark, sf), NUM).withColumn("r", F.round("r", 6))


def _v(t: str, a: str, b: str) -> str:
    return f"""(SELECT sqrt(greatest(n * (s - 1), 0) / (n * (least(ka, kb) - 1))) FROM (
      SELECT sum(o) AS n, sum(o * o / (ra * rb)) AS s, (SELECT count(DISTINCT {a}) FROM {t} WHERE {b} IS NOT NULL) AS ka,
      (SELECT count(DISTINCT {b}) FROM {t} WHERE {a} IS NOT NULL) AS kb FROM (
        SELECT o, sum(o) OVER (PARTITION BY {a})::DOUBLE AS ra, sum(o) OVER (PARTITION BY {b})::DOUBLE AS rb FROM (
          SELECT {a}, {b}, count(*)::DOUBLE AS o FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}))))"""


@query(
    "cramers_v_pairs",
    " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({_v('part', a, b)}, 6) AS v, (SELECT count(*) FROM part) AS n"
        for a, b in combinations(["p_name", "p_brand", "p_type"], 2)
    ),
)
def _(spark, sf):
    return relate.cramers_v_pairs(table(spark, sf, "part")).withColumn("v", F.round("v", 6))


def _pb(t: str, x: str, b: str, one: str) -> str:
    return f"""SELECT '{x}' AS col_a, '{b}' AS col_b,
    abs((avg({x}) FILTER ({b} = '{one}') - avg({x}) FILTER ({b} <> '{one}')) / stddev_samp({x})
    * sqrt(count({x}) FILTER ({b} = '{one}') * count({x}) FILTER ({b} <> '{one}') / (count({x})::DOUBLE * count({x})))) AS r,
    count({x}) AS n FROM {t} WHERE {b} IS NOT NULL"""


@query(
    "point_biserial_pairs",
    "SELECT col_a, col_b, round(r, 6) AS r, n FROM ("
    + " UNION ALL ".join(_pb("lineitem", x, "l_linestatus", "F") for x in LINE_NUM)
    + ")",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").select(*LINE_NUM, "l_returnflag", "l_linestatus")
    return relate.point_biserial_pairs(df).withColumn("r", F.round("r", 6))


REL = """WITH li AS (SELECT l_quantity, l_extendedprice, l_quantity * l_discount AS off, l_returnflag, l_linestatus,
 CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size,
 CASE WHEN l_quantity > 35 THEN 'large' WHEN l_quantity > 25 THEN 'mid' ELSE 'low' END AS band FROM lineitem), """
RNUM, RTXT = ["l_quantity", "l_extendedprice", "off"], ["l_returnflag", "l_linestatus", "size", "band"]
REL_SQL = (
    REL
    + "u AS ("
    + " UNION ALL ".join(
        f"""SELECT '{a}' AS col_a, '{b}' AS col_b, 'pearson' AS method, round(abs(corr({a}, {b})), 4) AS strength,
        CASE WHEN corr({a}, {b}) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM li"""
        for a, b in combinations(RNUM, 2)
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{a}', '{b}', 'cramers_v', round({_v('li', a, b)}, 4), 'association'" for a, b in combinations(RTXT, 2)
    )
    + " UNION ALL SELECT col_a, col_b, 'point_biserial', round(r, 4), 'association' FROM ("
    + " UNION ALL ".join(_pb("li", x, b, o) for x in RNUM for b, o in (("l_linestatus", "F"), ("size", "big")))
    + ")) "
)


def _rel(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_quantity",
        "l_extendedprice",
        "l_quantity * l_discount AS off",
        "l_returnflag",
        "l_linestatus",
        "CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size",
        "CASE WHEN l_quantity > 35 THEN 'large' WHEN l_quantity > 25 THEN 'mid' ELSE 'low' END AS band",
    )


@query("detect_relationships", REL_SQL + "SELECT * FROM u WHERE strength >= 0.5")
def _(spark, sf):
    return relate.detect_relationships(_rel(spark, sf))


@query(
    "network_edges",
    REL_SQL
    + "SELECT col_a AS source, col_b AS target, method, strength, direction, round(strength * 10, 1) AS weight FROM u WHERE strength >= 0.3",
)
def _(spark, sf):
    return relate.network_edges(_rel(spark, sf))


@query(
    "network_nodes",
    REL.rstrip(", ")
    + " "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS id, '{'numeric' if c in RNUM else 'categorical'}' AS type, count(DISTINCT {c}) AS n_unique,
        CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM li"""
        for c in RNUM + RTXT
    ),
)
def _(spark, sf):
    return relate.network_nodes(_rel(spark, sf))


@query(
    "network_summary",
    REL_SQL
    + """SELECT count(*) AS total_edges, count(*) FILTER (strength >= 0.7) AS strong,
    count(*) FILTER (strength >= 0.5 AND strength < 0.7) AS moderate, count(*) FILTER (strength < 0.5) AS weak FROM u WHERE strength >= 0.3""",
)
def _(spark, sf):
    return relate.network_summary(relate.network_edges(_rel(spark, sf)))


@query(
    "network_strongest",
    REL_SQL
    + """SELECT col_a AS source, col_b AS target, strength FROM u WHERE strength >= 0.3
    ORDER BY strength DESC, source, target LIMIT 5""",
)
def _(spark, sf):
    return relate.strongest(relate.network_edges(_rel(spark, sf))).select("source", "target", "strength")


# Drift: orders before and after a date, the later half with a price rise.
CUT = "1998-01-01"
B_SQL = f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'"
C_SQL = f"""SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
 o_totalprice * 1.5 AS o_totalprice, CASE WHEN o_custkey < 200 THEN NULL ELSE o_orderpriority END AS o_orderpriority
 FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}'"""


def _before(spark, sf):
    df = table(spark, sf, "orders").filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp"))
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def _after(spark, sf):
    df = table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit(CUT).cast("timestamp"))
    return df.selectExpr(
        "o_orderkey",
        "o_custkey",
        "CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus",
        "o_totalprice * 1.5 AS o_totalprice",
        "CASE WHEN o_custkey < 200 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    )


ONUM = ["o_orderkey", "o_custkey", "o_totalprice"]
OTXT = ["o_orderstatus", "o_orderpriority"]


def _stat(src: str) -> str:
    return (
        per(
            ONUM,
            f"""SELECT '{{c}}' AS c, (count(*) - count({{c}})) / count(*)::DOUBLE AS nr, avg({{c}}) AS m, stddev_samp({{c}}) AS s,
        CAST(min({{c}}) AS DOUBLE) AS lo, CAST(max({{c}}) AS DOUBLE) AS hi FROM {src}""",
        )
        + " UNION ALL "
        + per(OTXT, f"SELECT '{{c}}', (count(*) - count({{c}})) / count(*)::DOUBLE, NULL, NULL, NULL, NULL FROM {src}")
    )


ND_SQL = f"""WITH b AS ({B_SQL}), c AS ({C_SQL}), sb AS ({_stat('b')}), sc AS ({_stat('c')}),
nd AS (SELECT sb.c AS "column", 'missing_rate' AS issue, sb.nr AS before, sc.nr AS after FROM sb JOIN sc ON sb.c = sc.c WHERE abs(sc.nr - sb.nr) >= 0.05
UNION ALL SELECT sb.c, 'mean_shift', sb.m, sc.m FROM sb JOIN sc ON sb.c = sc.c WHERE sb.m <> 0 AND abs(sc.m - sb.m) / abs(sb.m) >= 0.1
UNION ALL SELECT sb.c, 'std_shift', sb.s, sc.s FROM sb JOIN sc ON sb.c = sc.c WHERE sb.s <> 0 AND abs(sc.s - sb.s) / abs(sb.s) >= 0.25
UNION ALL SELECT sb.c, 'new_minimum', sb.lo, sc.lo FROM sb JOIN sc ON sb.c = sc.c WHERE sc.lo < sb.lo
UNION ALL SELECT sb.c, 'new_maximum', sb.hi, sc.hi FROM sb JOIN sc ON sb.c = sc.c WHERE sc.hi > sb.hi),
cd AS ({" UNION ALL ".join(f'''
SELECT '{c}' AS "column", 'new_category' AS issue, v AS value FROM (SELECT DISTINCT {c} AS v FROM c WHERE {c} IS NOT NULL EXCEPT SELECT DISTINCT {c} FROM b)
UNION ALL SELECT '{c}', 'missing_category', v FROM (SELECT DISTINCT {c} AS v FROM b WHERE {c} IS NOT NULL EXCEPT SELECT DISTINCT {c} FROM c)
UNION ALL SELECT '{c}', 'top_category', tc FROM (SELECT (SELECT {c} FROM b WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS tb,
 (SELECT {c} FROM c WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS tc) WHERE tb <> tc''' for c in OTXT)}) """


@query("drift_numeric", ND_SQL + 'SELECT "column", issue, round(before, 3) AS before, round(after, 3) AS after FROM nd')
def _(spark, sf):
    out = drift.numeric_drift(_before(spark, sf), _after(spark, sf))
    return out.withColumn("before", F.round("before", 3)).withColumn("after", F.round("after", 3))


@query("drift_categorical", ND_SQL + "SELECT * FROM cd")
def _(spark, sf):
    return drift.categorical_drift(_before(spark, sf), _after(spark, sf))


DD = (
    ND_SQL
    + """, i AS (SELECT "column", issue FROM nd UNION ALL SELECT DISTINCT "column", issue FROM cd),
    d AS (SELECT "column", count(*) AS n_issues, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) = 2 THEN 'medium' ELSE 'low' END AS severity FROM i GROUP BY 1
    UNION ALL SELECT 'schema:column_added', 1, 'high' UNION ALL SELECT 'schema:column_removed', 1, 'high') """
)


def _drifted(spark, sf):
    b = _before(spark, sf).withColumn("old", F.lit(1))
    c = _after(spark, sf).withColumn("fresh", F.lit(1))
    return drift.detect_drift(b, c)


@query("detect_drift", DD + "SELECT * FROM d")
def _(spark, sf):
    return _drifted(spark, sf)


@query(
    "drift_verdict",
    DD
    + """SELECT count(*) AS n_drifted, CAST(sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
    CASE WHEN count(*) = 0 THEN 'none' WHEN sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) >= 2 OR count(*) >= 2.5 THEN 'high'
    WHEN sum(CASE WHEN severity = 'high' THEN 1 ELSE 0 END) = 1 OR count(*) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM d""",
)
def _(spark, sf):
    return drift.drift_verdict(_drifted(spark, sf), 5)
