from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import outliers as O
from ..operators import series as Z
from ..operators import stats as S
from .registry import GAPPY_SQL, LINE_NUM, gappy, per, query, table

G = f"WITH g AS ({GAPPY_SQL}) "


def _li(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE_NUM)


def _r(df, digits=5):
    kept = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*kept)


@query(
    "describe_extended",
    per(
        LINE_NUM,
        """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 5) AS mean, round(median({c}), 5) AS median, (SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
    round(stddev_samp({c}), 5) AS std, round(stddev_samp({c}) / sqrt(count({c})), 5) AS sem, round(100 * stddev_samp({c}) / avg({c}), 5) AS cv_pct,
    min({c}) AS "min", max({c}) AS "max", round(max({c}) - min({c}), 5) AS "range", round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 5) AS iqr FROM lineitem""",
    ),
)
def _(spark, sf):
    return _r(S.describe_extended(_li(spark, sf)).drop("var"))


@query(
    "percentiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {p}.0::DOUBLE AS percent, round(quantile_cont({c}, {p / 100}), 5) AS value FROM lineitem"""
        for c in LINE_NUM
        for p in S.PERCENTS
    ),
)
def _(spark, sf):
    return _r(S.percentiles(_li(spark, sf)))


@query(
    "percentiles_bracketed",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {p} AS p, round(quantile_cont({c}, {p}), 5) AS value FROM lineitem"""
        for c in LINE_NUM
        for p in (0.01, 0.25, 0.5, 0.9)
    ).replace("AS p,", "::DOUBLE AS p,"),
)
def _(spark, sf):
    from ..functions import values

    ps = [0.01, 0.25, 0.5, 0.9]
    q = values.quantiles(_li(spark, sf), {c: F.col(c) for c in LINE_NUM}, ps, small_rows=0)
    return _r(spark.createDataFrame([(c, p, v) for c, vs in q.items() for p, v in zip(ps, vs)], "column string, p double, value double"))


@query(
    "trimmed_winsorised_means",
    per(
        ["value", "user_id"],
        """SELECT * FROM (WITH r AS (SELECT {c}::DOUBLE AS x, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS n FROM events),
    e AS (SELECT max(CASE WHEN i = floor(n * 0.05) THEN x END) AS lo, max(CASE WHEN i = n - floor(n * 0.05) - 1 THEN x END) AS hi FROM r)
    SELECT '{c}' AS "column", round(avg(x) FILTER (i >= floor(n * 0.1) AND i < n - floor(n * 0.1)), 5) AS trimmed_mean, round(avg(least(greatest(x, lo), hi)), 5) AS winsorised_mean FROM r, e)""",
    ),
)
def _(spark, sf):
    return _r(S.trimmed_means(table(spark, sf, "events"), ["value", "user_id"]))


@query(
    "mad",
    per(
        LINE_NUM,
        """SELECT '{c}' AS "column", round(any_value(m), 5) AS median, round(median(abs({c} - m)), 5) AS mad FROM lineitem, (SELECT median({c}) AS m FROM lineitem)""",
    ),
)
def _(spark, sf):
    return _r(S.mad(_li(spark, sf)))


@query("mean_interval")
def _(spark, sf):
    return S.mean_interval(_li(spark, sf))


@query(
    "gini",
    per(
        ["l_extendedprice", "l_quantity"],
        """SELECT '{c}' AS "column", round(2 * sum(i * {c}) / (count(*) * sum({c})) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini
    FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS i FROM lineitem)""",
    ),
)
def _(spark, sf):
    return _r(S.gini(_li(spark, sf), ["l_extendedprice", "l_quantity"]), 6)


# population skewness and excess kurtosis in SQL
MOM = """(SELECT '{c}' AS c, count(*) AS n, avg({c}) AS m, sum(pow({c} - mm, 2)) / count(*) AS m2, sum(pow({c} - mm, 3)) / count(*) AS m3, sum(pow({c} - mm, 4)) / count(*) AS m4
 FROM events, (SELECT avg({c}) AS mm FROM events))"""
MOMS = f"WITH m AS ({MOM.replace('{c}', 'value')} UNION ALL {MOM.replace('{c}', 'user_id')}), s AS (SELECT c, n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM m) "
EV = ["value", "user_id"]


@query(
    "shape_classes",
    MOMS
    + """SELECT c AS "column", round(s, 5) AS skewness, round(k, 5) AS kurtosis,
    CASE WHEN s > 1 THEN 'highly_right' WHEN s > 0.5 THEN 'moderately_right' WHEN s < -1 THEN 'highly_left' WHEN s < -0.5 THEN 'moderately_left' ELSE 'symmetric' END AS skew_class,
    CASE WHEN k > 1 THEN 'leptokurtic' WHEN k < -1 THEN 'platykurtic' ELSE 'mesokurtic' END AS kurtosis_class FROM s""",
)
def _(spark, sf):
    return _r(S.shape_classes(table(spark, sf, "events"), EV))


@query(
    "skew_kurtosis_report",
    MOMS
    + """, t AS (SELECT 'value' AS c, avg(CASE WHEN abs(value - m) > 3 * d THEN 1.0 ELSE 0 END) AS h FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events)
     UNION ALL SELECT 'user_id', avg(CASE WHEN abs(user_id - m) > 3 * d THEN 1.0 ELSE 0 END) FROM events, (SELECT avg(user_id) AS m, stddev_pop(user_id) AS d FROM events))
    SELECT s.c AS "column", n, round(s, 5) AS skewness, round(k, 5) AS kurtosis, round(s / sqrt(6.0 / n), 4) AS skew_z, round(k / sqrt(24.0 / n), 4) AS kurtosis_z,
    round((s * s + 1) / (k + 3.0 * (n - 1) * (n - 1) / ((n - 2.0) * (n - 3))), 5) AS bimodality, (s * s + 1) / (k + 3.0 * (n - 1) * (n - 1) / ((n - 2.0) * (n - 3))) > 0.555 AS maybe_bimodal,
    round(h, 5)::DOUBLE AS heavy_tail_ratio, abs(s) > 0.5 OR abs(k) > 2 AS needs_transform FROM s JOIN t ON s.c = t.c""",
)
def _(spark, sf):
    out = S.skew_kurtosis_report(table(spark, sf, "events"), EV).drop("advice")
    return _r(_r(out).withColumn("skew_z", F.round("skew_z", 4)).withColumn("kurtosis_z", F.round("kurtosis_z", 4)))


@query("jarque_bera", MOMS + 'SELECT c AS "column", round(n / 6.0 * (s * s + k * k / 4), 3) AS statistic, round(exp(-n / 12.0 * (s * s + k * k / 4)), 6) AS p_value FROM s')
def _(spark, sf):
    out = S.jarque_bera(table(spark, sf, "events"), EV)
    return out.select("column", F.round("statistic", 3).alias("statistic"), F.round("p_value", 6).alias("p_value"))


@query("dagostino")
def _(spark, sf):
    return S.dagostino(table(spark, sf, "events"), EV)


@query("edf_statistics")
def _(spark, sf):
    return S.edf_statistics(table(spark, sf, "customer"), ["c_acctbal"])


@query("shapiro")
def _(spark, sf):
    return S.shapiro(table(spark, sf, "customer"), ["c_acctbal"])


@query("normality_report")
def _(spark, sf):
    return S.normality_report(table(spark, sf, "customer"), ["c_acctbal"])


@query("fit_distributions")
def _(spark, sf):
    return Z.fit_distributions(table(spark, sf, "events"), "value", rounds=6)


PAIRS = list(combinations(["quantity", "discount", "price"], 2))
EFFECT = "CASE WHEN abs(r) < 0.10 THEN 'negligible' WHEN abs(r) < 0.30 THEN 'small' WHEN abs(r) < 0.50 THEN 'medium' ELSE 'large' END AS effect"


@query(
    "pearson_with_p",
    G
    + f""", u AS ({" UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r, count({a} + {b}) AS n FROM g" for a, b in PAIRS)})
    SELECT col_a, col_b, round(r, 6) AS r, n, {EFFECT} FROM u""",
)
def _(spark, sf):
    return _r(S.pearson(gappy(spark, sf), ["quantity", "discount", "price"]).drop("p_value"), 6)


def _spear(t: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS col_a, '{b}' AS col_b, corr(ra, rb) AS r, count(*) AS n FROM (SELECT
    rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb
    FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query(
    "spearman",
    f"WITH u AS ({' UNION ALL '.join(_spear('lineitem', a, b) for a, b in combinations(['l_quantity', 'l_extendedprice', 'l_discount'], 2))}) SELECT col_a, col_b, round(r, 6) AS r, n, {EFFECT} FROM u",
)
def _(spark, sf):
    return _r(S.spearman(_li(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"]).drop("p_value"), 6)


@query(
    "spearman_with_gaps",
    f"WITH g AS ({GAPPY_SQL}), u AS ({_spear('g', 'quantity', 'price')}) SELECT col_a, col_b, round(r, 6) AS r, n, {EFFECT} FROM u",
)
def _(spark, sf):
    return _r(S.spearman(gappy(spark, sf), ["quantity", "price"]).drop("p_value"), 6)


@query(
    "kendall",
    """WITH c AS (SELECT s_acctbal AS x, s_nationkey AS y FROM supplier), p AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM c a, c b),
    t AS (SELECT (SELECT sum(k * (k - 1)) / 2.0 FROM (SELECT count(*) AS k FROM c GROUP BY x)) AS n1, (SELECT sum(k * (k - 1)) / 2.0 FROM (SELECT count(*) AS k FROM c GROUP BY y)) AS n2, count(*) AS n FROM c)
    SELECT 's_acctbal' AS col_a, 's_nationkey' AS col_b, round(s / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 6) AS tau, n FROM p, t""",
)
def _(spark, sf):
    return _r(S.kendall(table(spark, sf, "supplier"), "s_acctbal", "s_nationkey").drop("p_value"), 6)


@query("kendall_pairs")
def _(spark, sf):
    return S.kendall_pairs(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("adjust_p_fdr")
def _(spark, sf):
    return S.adjust_p(S.pearson(_li(spark, sf)), method="fdr_bh")


@query("adjust_p_bonferroni")
def _(spark, sf):
    return S.adjust_p(S.pearson(_li(spark, sf)), method="bonferroni")


@query(
    "chi_squared",
    """WITH c AS (SELECT p_brand AS a, p_type AS b, count(*)::DOUBLE AS o FROM part GROUP BY 1, 2), m AS (SELECT o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS k, sum(o) OVER () AS n FROM c),
    x AS (SELECT any_value(n) * (sum(o * o / (r * k)) - 1) AS chi2, any_value(n) AS n FROM m), d AS (SELECT count(DISTINCT p_brand) AS ka, count(DISTINCT p_type) AS kb FROM part)
    SELECT 'chi_squared' AS test, round(chi2, 4) AS statistic, (ka - 1) * (kb - 1) AS dof, round(sqrt(chi2 / (n * (least(ka, kb) - 1))), 6) AS cramers_v, n::BIGINT AS n FROM x, d""",
)
def _(spark, sf):
    out = S.chi_squared(table(spark, sf, "part"), "p_brand", "p_type").drop("p_value")
    return out.withColumn("statistic", F.round("statistic", 4)).withColumn("cramers_v", F.round("cramers_v", 6))


@query(
    "chi_squared_yates",
    """WITH c AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS o FROM labels GROUP BY 1, 2), m AS (SELECT a, b, o, sum(o) OVER (PARTITION BY a) AS r, sum(o) OVER (PARTITION BY b) AS k, sum(o) OVER () AS n FROM c)
    SELECT 'chi_squared' AS test, round(sum(pow(abs(o - r * k / n) - least(0.5, abs(o - r * k / n)), 2) / (r * k / n)), 5) AS statistic, 1::BIGINT AS dof FROM m""",
)
def _(spark, sf):
    df = table(spark, sf, "labels").selectExpr("CAST(quality AS STRING) AS quality", "CAST(toxic AS STRING) AS toxic")
    return _r(S.chi_squared(df, "quality", "toxic").select("test", "statistic", "dof"))


@query("fisher_exact")
def _(spark, sf):
    df = table(spark, sf, "nation").selectExpr("CASE WHEN n_regionkey = 1 THEN 'a' ELSE 'b' END AS x", "CASE WHEN n_nationkey < 4 THEN 'p' ELSE 'q' END AS y")
    return S.chi_squared(df, "x", "y")


@query("point_biserial", "SELECT 'toxic' AS \"binary\", 'n_chars' AS numeric, round(corr(toxic, n_chars), 6) AS r, count(*) AS n FROM labels JOIN documents USING (doc_id)")
def _(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return _r(S.point_biserial(df, "toxic", "n_chars").drop("p_value"), 6)


@query(
    "partial_correlation",
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_tax) AS ac, corr(l_extendedprice, l_tax) AS bc, count(*) AS n FROM lineitem)
    SELECT 'l_quantity' AS col_a, 'l_extendedprice' AS col_b, 'l_tax' AS control, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS r, n FROM r""",
)
def _(spark, sf):
    return _r(S.partial_correlation(_li(spark, sf), "l_quantity", "l_extendedprice", "l_tax").drop("p_value"), 6)


@query(
    "correlation_matrix",
    G
    + f""", f AS (SELECT {", ".join(f"coalesce({c}, (SELECT median({c}) FROM g)) AS {c}" for c in ("quantity", "discount", "price"))} FROM g)
    {" UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS r FROM f" for a, b in PAIRS)}""",
)
def _(spark, sf):
    return _r(S.correlation_matrix(gappy(spark, sf), ["quantity", "discount", "price"]).select("col_a", "col_b", "r"), 6)


@query(
    "compare_groups_many",
    """WITH r AS (SELECT c_mktsegment AS g, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY c_acctbal) AS t FROM customer),
    s AS (SELECT sum(rs * rs / n) AS q, sum(n) AS n FROM (SELECT g, sum(r) AS rs, count(*) AS n FROM r GROUP BY g)), ties AS (SELECT sum(t * t - 1.0) AS t FROM r)
    SELECT 'kruskal_wallis' AS test, round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4)::DOUBLE AS statistic FROM s, ties""",
)
def _(spark, sf):
    out = S.compare_groups(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment")
    return out.select("test", F.round("statistic", 4).alias("statistic"))


@query(
    "compare_groups_two",
    """WITH d AS (SELECT toxic AS g, n_chars AS x FROM labels JOIN documents USING (doc_id)), r AS (SELECT g, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM d)
    SELECT 'mann_whitney_u' AS test, sum(r) - count(*) * (count(*) + 1) / 2.0 AS statistic FROM r WHERE g = 0""",
)
def _(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return S.compare_groups(df, "n_chars", "toxic").select("test", "statistic")


@query("anova_by_segment", """WITH p AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS w FROM p)
 SELECT round((sum(n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (any_value(w) / (any_value(nn) - any_value(k))), 6) AS f, round(sum(n * (m - gm) * (m - gm)) / (sum(n * (m - gm) * (m - gm)) + any_value(w)), 8) AS eta2 FROM p, t""")
def _(spark, sf):
    a = S.anova(S._groups(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment"))
    return spark.createDataFrame([(round(a["f"], 6), round(a["eta2"], 8))], "f double, eta2 double")


@query(
    "variance_equality",
    """WITH z AS (SELECT c_mktsegment AS g, abs(c_acctbal - median(c_acctbal) OVER (PARTITION BY c_mktsegment)) AS z FROM customer), p AS (SELECT g, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM z GROUP BY g),
    t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS w FROM p),
    b AS (SELECT count(*) AS n, var_samp(c_acctbal) AS v FROM customer GROUP BY c_mktsegment), q AS (SELECT sum(n - 1) AS df, count(*) AS k, sum((n - 1) * v) AS s, sum((n - 1) * ln(v)) AS l, sum(1.0 / (n - 1)) AS i FROM b)
    SELECT 'levene' AS test, round((sum(n * (m - gm) * (m - gm)) / (any_value(k) - 1)) / (any_value(w) / (any_value(nn) - any_value(k))), 5) AS statistic FROM p, t
    UNION ALL SELECT 'bartlett', round((df * ln(s / df) - l) / (1 + (i - 1.0 / df) / (3.0 * (k - 1))), 5) FROM q""",
)
def _(spark, sf):
    return _r(S.variance_equality(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment").select("test", "statistic"))


@query("one_sample_t", "SELECT 'c_acctbal' AS \"column\", round(avg(c_acctbal), 4) AS mean, round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(*))), 5) AS statistic FROM customer")
def _(spark, sf):
    out = S.one_sample_t(table(spark, sf, "customer"), "c_acctbal", 4500)
    return out.select("column", F.round("mean", 4).alias("mean"), F.round("statistic", 5).alias("statistic"))


@query(
    "autocorrelation",
    """WITH s AS (SELECT value - avg(value) OVER () AS x, row_number() OVER (ORDER BY ts, event_id) AS i FROM events), v AS (SELECT sum(x * x) AS v FROM s)
    SELECT CAST(k AS INTEGER) AS lag, round((SELECT sum(a.x * b.x) FROM s a JOIN s b ON b.i = a.i + k) / v, 6) AS acf FROM range(0, 21) t(k), v""",
)
def _(spark, sf):
    return _r(Z.autocorrelation(table(spark, sf, "events"), "value", ["ts", "event_id"]).select("lag", "acf"), 6)


@query("partial_autocorrelation")
def _(spark, sf):
    return Z.autocorrelation(table(spark, sf, "events"), "value", ["ts", "event_id"])


@query("stationarity")
def _(spark, sf):
    return Z.stationarity(table(spark, sf, "events"), "value", ["ts", "event_id"])


@query("granger")
def _(spark, sf):
    return Z.granger(table(spark, sf, "events"), "user_id", "value", ["ts", "event_id"], 3)


SK = "sum(pow(x - m, 3)) / count(*) / pow(sum(pow(x - m, 2)) / count(*), 1.5)"


@query(
    "advise_transform",
    " UNION ALL ".join(
        f"SELECT '{n}' AS transform, round({SK}, 5) AS skew_after FROM (SELECT x, avg(x) OVER () AS m FROM (SELECT {e} AS x FROM events))"
        for n, e in (("log1p", "ln(1 + value)"), ("sqrt", "sqrt(abs(value))"), ("square", "value * value"), ("cbrt", "cbrt(value)"))
    ),
)
def _(spark, sf):
    out = Z.advise_transform(table(spark, sf, "events"), ["value"])
    keep = out.filter(F.col("transform").isin("log1p", "sqrt", "square", "cbrt"))
    return _r(keep.select("transform", "skew_after"))


@query("full_stats_report")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    return Z.full_stats_report(df, groups=["c_mktsegment"])


@query("outlier_tests")
def _(spark, sf):
    return O.grubbs_test(table(spark, sf, "customer"), ["c_acctbal"])
