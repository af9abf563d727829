from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from .registry import GAPPY_SQL, gappy, per, query, table

G = f"WITH g AS ({GAPPY_SQL}) "
GAP = ["l_orderkey", "l_partkey", "l_suppkey", "quantity", "discount", "price", "flag", "status", "shipped"]


def _contract_sql(src: str, cols, texts, max_missing: float) -> str:
    facts = per(
        cols,
        """SELECT '{c}' AS c, (count(*) - count({c})) / count(*)::DOUBLE AS miss,
        count(DISTINCT {c}) + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS uniq, count(*) AS n FROM src""",
    )
    names = ", ".join(f"'{t}'" for t in texts)
    return f"""WITH src AS ({src}), f AS ({facts}), u AS (
    SELECT CASE WHEN miss > 0.6 THEN 'high' ELSE 'medium' END AS level, 'missing' AS kind, c AS "column", miss AS value FROM f WHERE miss > {max_missing}
    UNION ALL SELECT 'medium', 'constant', c, uniq FROM f WHERE uniq <= 1
    UNION ALL SELECT 'medium', 'high_cardinality_text', c, uniq / n::DOUBLE FROM f WHERE c IN ({names}) AND uniq / n::DOUBLE >= 0.95 AND uniq > 25
    UNION ALL SELECT 'medium', 'duplicates', NULL, (SELECT count(*) FROM src) - count(*) FROM (SELECT DISTINCT * FROM src) HAVING (SELECT count(*) FROM src) > count(*))"""


CUST = """SELECT c_name, c_mktsegment, 7 AS seven, CASE WHEN c_acctbal < 5000 THEN NULL ELSE c_nationkey END AS nation,
 CASE WHEN c_acctbal < 9000 THEN NULL ELSE c_mktsegment END AS rare FROM customer
 UNION ALL SELECT c_name, c_mktsegment, 7, CASE WHEN c_acctbal < 5000 THEN NULL ELSE c_nationkey END,
 CASE WHEN c_acctbal < 9000 THEN NULL ELSE c_mktsegment END FROM customer WHERE c_nationkey = 3"""


def _cust(spark, sf):
    df = table(spark, sf, "customer")
    made = [
        "c_name",
        "c_mktsegment",
        "7 AS seven",
        "CASE WHEN c_acctbal < 5000 THEN NULL ELSE c_nationkey END AS nation",
        "CASE WHEN c_acctbal < 9000 THEN NULL ELSE c_mktsegment END AS rare",
    ]
    return df.selectExpr(*made).unionByName(df.filter("c_nationkey = 3").selectExpr(*made))


CUST_SQL = _contract_sql(CUST, ["c_name", "c_mktsegment", "seven", "nation", "rare"], ["c_name", "c_mktsegment", "rare"], 0.35)


@query("evaluate_contracts", CUST_SQL + ' SELECT level, kind, "column", round(value, 6) AS value FROM u')
def _(spark, sf):
    return C.evaluate_contracts(_cust(spark, sf)).withColumn("value", F.round("value", 6))


@query(
    "contract_risk",
    CUST_SQL
    + """ SELECT CAST(sum(CASE WHEN level = 'high' THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
    CAST(sum(CASE WHEN level = 'medium' THEN 1 ELSE 0 END) AS BIGINT) AS n_medium, count(*) AS n_total,
    CASE WHEN sum(CASE WHEN level = 'high' THEN 1 ELSE 0 END) > 0 THEN 'high' WHEN count(*) > 0 THEN 'medium' ELSE 'low' END AS overall_risk FROM u""",
)
def _(spark, sf):
    return C.contract_risk(C.evaluate_contracts(_cust(spark, sf)))


def _check(name: str, column: str, rule: C.Rule, sql: str, source=None) -> None:
    """One check of one column as its own query."""

    def run(spark, sf):
        df = source(spark, sf) if source else gappy(spark, sf)
        return C.validate_schema(df, {column: rule})

    query(name, sql)(run)


def _count(column: str, check: str, cond: str, src: str = "g", pre: str = G) -> str:
    return (
        pre
        + f"""SELECT '{column}' AS "column", '{check}' AS "check", CASE WHEN n > 0 THEN 'error' ELSE 'passed' END AS outcome,
        n AS n_bad FROM (SELECT CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM {src})"""
    )


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _pages(spark, sf):
    return table(spark, sf, "pages")


_check("rule_required", "quantity", C.Rule(required=True), _count("quantity", "required", "quantity IS NULL"))
_check(
    "rule_nullable_pct",
    "price",
    C.Rule(nullable_pct=0.5),
    _count("price", "nullable_pct", "price IS NULL").replace("'error'", "'passed'"),
)
_check(
    "rule_unique",
    "l_orderkey",
    C.Rule(unique=True),
    """SELECT 'l_orderkey' AS "column", 'unique' AS "check", 'error' AS outcome, CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS n_bad FROM lineitem""",
)
_check(
    "rule_type_numeric",
    "source",
    C.Rule(dtype="numeric"),
    _count("source", "type", f"NOT regexp_matches(source, '{C.NUMERIC_TEXT}')", "documents", ""),
    _docs,
)
_check(
    "rule_type_date",
    "flag",
    C.Rule(dtype="date"),
    _count("flag", "type", "flag IS NOT NULL AND TRY_CAST(flag AS TIMESTAMP) IS NULL"),
)
_check(
    "rule_type_boolean",
    "flag",
    C.Rule(dtype="boolean"),
    _count("flag", "type", "flag IS NOT NULL AND lower(flag) NOT IN ('true','false','yes','no','1','0','y','n','t','f')"),
)
_check(
    "rule_range",
    "price",
    C.Rule(min_val=5000, max_val=60000),
    _count("price", "min", "price < 5000") + " UNION ALL " + _count("price", "max", "price > 60000", pre=""),
)
_check(
    "rule_length",
    "text",
    C.Rule(min_length=100, max_length=5000),
    _count("text", "min_length", "length(text) < 100", "documents", "")
    + " UNION ALL "
    + _count("text", "max_length", "length(text) > 5000", "documents", ""),
    _docs,
)
_check(
    "rule_allowed",
    "flag",
    C.Rule(allowed_values=["A", " N "]),
    _count("flag", "allowed", "flag IS NOT NULL AND lower(trim(flag)) NOT IN ('a', 'n')"),
)
_check(
    "rule_forbidden",
    "flag",
    C.Rule(forbidden_values=["R"]),
    _count("flag", "forbidden", "lower(trim(flag)) = 'r'"),
)
_check(
    "rule_pattern",
    "url",
    C.Rule(pattern="url"),
    _count("url", "pattern", f"NOT regexp_matches(url, '{C.PATTERNS['url']}')", "pages", ""),
    _pages,
)


@query(
    "rule_custom",
    """SELECT 'l_extendedprice' AS "column", 'custom' AS "check", CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS outcome, n AS n_bad
    FROM (SELECT count(*) FILTER (NOT (l_extendedprice > l_quantity)) AS n FROM lineitem)""",
)
def _(spark, sf):
    rule = C.Rule(custom=F.col("l_extendedprice") > F.col("l_quantity"))
    return C.validate_schema(table(spark, sf, "lineitem"), {"l_extendedprice": rule})


RULES = {
    "quantity": C.Rule(dtype="numeric", required=True, min_val=1, max_val=50),
    "flag": C.Rule(allowed_values=["A", "N"], nullable_pct=0.5, min_length=1),
    "status": C.Rule(required=True, pattern="^[A-Z]$"),
    "gone": C.Rule(required=True),
}
RULES_SQL = (
    G
    + """, u AS (SELECT 'quantity' AS c, 'required' AS k, CAST(count(*) - count(quantity) AS BIGINT) AS n FROM g
    UNION ALL SELECT 'quantity', 'type', 0
    UNION ALL SELECT 'quantity', 'min', CAST(sum(CASE WHEN quantity < 1 THEN 1 ELSE 0 END) AS BIGINT) FROM g
    UNION ALL SELECT 'quantity', 'max', CAST(sum(CASE WHEN quantity > 50 THEN 1 ELSE 0 END) AS BIGINT) FROM g
    UNION ALL SELECT 'flag', 'min_length', CAST(sum(CASE WHEN length(flag) < 1 THEN 1 ELSE 0 END) AS BIGINT) FROM g
    UNION ALL SELECT 'flag', 'allowed', CAST(sum(CASE WHEN flag NOT IN ('A','N') THEN 1 ELSE 0 END) AS BIGINT) FROM g
    UNION ALL SELECT 'status', 'required', CAST(count(*) - count(status) AS BIGINT) FROM g
    UNION ALL SELECT 'status', 'pattern', CAST(sum(CASE WHEN NOT regexp_matches(status, '^[A-Z]$') THEN 1 ELSE 0 END) AS BIGINT) FROM g),
    r AS (SELECT c AS "column", k AS "check", CASE WHEN n > 0 THEN 'error' ELSE 'passed' END AS outcome, n AS n_bad FROM u
    UNION ALL SELECT 'flag', 'nullable_pct', CASE WHEN (count(*) - count(flag)) / count(*)::DOUBLE > 0.5 THEN 'error' ELSE 'passed' END, CAST(count(*) - count(flag) AS BIGINT) FROM g
    UNION ALL SELECT 'gone', 'present', 'missing', 0) """
)


@query("validate_schema", RULES_SQL + "SELECT * FROM r")
def _(spark, sf):
    return C.validate_schema(gappy(spark, sf), RULES)


@query(
    "schema_status",
    RULES_SQL
    + """SELECT "column", CASE WHEN max(CASE WHEN outcome = 'missing' THEN 1 ELSE 0 END) = 1 THEN 'missing'
    WHEN max(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) = 1 THEN 'fail' ELSE 'pass' END AS status,
    CAST(sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors, CAST(0 AS BIGINT) AS n_warnings,
    CAST(sum(CASE WHEN outcome = 'passed' THEN 1 ELSE 0 END) AS BIGINT) AS n_passed FROM r GROUP BY 1""",
)
def _(spark, sf):
    return C.schema_status(C.validate_schema(gappy(spark, sf), RULES))


@query(
    "schema_verdict",
    RULES_SQL
    + """, s AS (SELECT "column" AS c, max(CASE WHEN outcome IN ('error','missing') THEN 1 ELSE 0 END) AS bad FROM r GROUP BY 1)
    SELECT CAST(sum(1 - bad) AS BIGINT) AS n_passed, CAST(sum(bad) AS BIGINT) AS n_failed, CAST(0 AS BIGINT) AS n_warnings,
    CAST(44.4 AS DOUBLE) AS coverage, 'l_orderkey,l_partkey,l_suppkey,discount,price,shipped' AS uncovered, sum(bad) = 0 AS valid FROM s""",
)
def _(spark, sf):
    df = gappy(spark, sf)
    return C.schema_verdict(df, RULES, C.validate_schema(df, RULES))


@query(
    "violation_examples",
    """WITH b AS (SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part WHERE p_size > 40 GROUP BY 1),
    d AS (SELECT p_brand AS value, count(*) AS n FROM part WHERE lower(p_brand) IN ('brand#1', 'brand#2') GROUP BY 1)
    SELECT * FROM (SELECT 'p_size' AS "column", 'max' AS "check", value, n FROM b ORDER BY value LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'p_brand', 'forbidden', value, n FROM d ORDER BY value LIMIT 5)""",
)
def _(spark, sf):
    rules = {"p_size": C.Rule(max_val=40), "p_brand": C.Rule(forbidden_values=["Brand#1", "Brand#2"])}
    return C.violation_examples(table(spark, sf, "part"), rules)


@query(
    "duplicate_examples",
    "SELECT text AS value, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY encode(value) LIMIT 3",
)
def _(spark, sf):
    return C.duplicate_examples(table(spark, sf, "documents"), "text")


@query(
    "not_in_table",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return C.not_in_table(orders, "o_custkey", table(spark, sf, "customer").filter("c_acctbal > 0"), "c_custkey")


@query(
    "infer_schema",
    """SELECT 'o_orderkey' AS "column", 'numeric' AS dtype, true AS required, count(DISTINCT o_orderkey) = count(*) AS "unique",
      CAST(min(o_orderkey) AS DOUBLE) AS min_val, CAST(max(o_orderkey) AS DOUBLE) AS max_val, NULL AS allowed FROM orders
    UNION ALL SELECT 'o_custkey', 'numeric', true, count(DISTINCT o_custkey) = count(*), min(o_custkey), max(o_custkey), NULL FROM orders
    UNION ALL SELECT 'o_totalprice', 'numeric', true, count(DISTINCT o_totalprice) = count(*), round(min(o_totalprice), 4), round(max(o_totalprice), 4), NULL FROM orders
    UNION ALL SELECT 'o_orderdate', 'date', true, count(DISTINCT o_orderdate) = count(*), NULL, NULL, NULL FROM orders
    UNION ALL SELECT 'o_orderstatus', 'text', true, false, NULL, NULL, string_agg(DISTINCT lower(o_orderstatus), ',' ORDER BY lower(o_orderstatus)) FROM orders
    UNION ALL SELECT 'o_orderpriority', 'text', true, false, NULL, NULL, string_agg(DISTINCT lower(o_orderpriority), ',' ORDER BY lower(o_orderpriority)) FROM orders""",
)
def _(spark, sf):
    df = table(spark, sf, "orders")
    return C.schema_table(df, C.infer_schema(df))


@query(
    "schema_round_trip",
    """WITH f AS (SELECT count(*) - count(n_nationkey) AS a, count(*) - count(DISTINCT n_nationkey) AS b, count(*) - count(n_name) AS c, count(*) - count(DISTINCT n_name) AS d, count(*) - count(n_regionkey) AS e FROM nation),
    r AS (SELECT unnest([('n_nationkey', 'required', a), ('n_nationkey', 'unique', b), ('n_nationkey', 'type', 0), ('n_nationkey', 'min', 0), ('n_nationkey', 'max', 0), ('n_name', 'required', c), ('n_name', 'unique', d),
      ('n_regionkey', 'required', e), ('n_regionkey', 'type', 0), ('n_regionkey', 'min', 0), ('n_regionkey', 'max', 0)]) AS t FROM f)
    SELECT t[1] AS "column", t[2] AS "check", CASE WHEN t[3] = 0 THEN 'passed' ELSE 'failed' END AS outcome, t[3] AS n_bad FROM r""",
)
def _(spark, sf):
    df = table(spark, sf, "nation")
    schema = C.schema_from_dict(C.schema_to_dict(C.infer_schema(df)))
    return C.validate_schema(df, schema)
