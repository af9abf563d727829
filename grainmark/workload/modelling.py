from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import automl as A
from ..operators import impute_models as I
from ..plans import flow
from .registry import gappy, query, table

EVK = [
    "event_id",
    "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D AS at",
    "CAST(user_id AS DOUBLE) AS who",
    "CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value",
]


def _ev(spark, sf):
    return table(spark, sf, "events").selectExpr(*EVK)


@query(
    "impute_knn",
    """WITH e AS (SELECT event_id, epoch_us(ts) / 1e6 AS tt, user_id::DOUBLE AS who, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events),
    d AS (SELECT * FROM e WHERE value IS NOT NULL), s AS (SELECT avg(tt) AS am, stddev_pop(tt) AS asd, avg(who) AS wm, stddev_pop(who) AS wsd FROM d),
    p AS (SELECT a.event_id, d.value, sqrt(pow((a.tt - am) / asd - (d.tt - am) / asd, 2) + pow((a.who - wm) / wsd - (d.who - wm) / wsd, 2)) AS dist FROM e a, d, s WHERE a.value IS NULL),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist) AS k FROM p) WHERE k <= 5),
    f AS (SELECT event_id, CASE WHEN min(dist) = 0 THEN avg(value) FILTER (dist = 0) ELSE sum(value / dist) / sum(1 / dist) END AS v FROM n GROUP BY 1)
    SELECT e.event_id, round(coalesce(e.value, f.v), 5) AS value FROM e LEFT JOIN f ON e.event_id = f.event_id""",
)
def _(spark, sf):
    out = I.impute_knn(_ev(spark, sf), "event_id")
    return out.select("event_id", F.round("value", 5).alias("value"))


# Five features of a customer; everybody lacks one of them.
FIVE = [
    "c_acctbal",
    "(c_custkey * 7919 % 10007) / 100.0",
    "sqrt(c_custkey)",
    "10 * sin(c_custkey)",
    "c_mktsegment",
]


def _lacking(double: str) -> list[str]:
    return [
        f"CASE WHEN c_custkey % 5 <> {i} THEN {e if i == 4 else f'CAST({e} AS {double})'} END AS f{i}" for i, e in enumerate(FIVE)
    ]


@query(
    "impute_knn_gaps",
    f"""WITH t AS (SELECT c_custkey AS id, {", ".join(_lacking("DOUBLE"))} FROM customer),
    d AS ({" UNION ALL ".join(
        f"SELECT {t} AS t, a.id, b.id AS o, " + (f"CAST(b.f{t} AS VARCHAR)" if t < 4 else "b.f4") + " AS v, "
        + "sqrt(5.0 / (" + " + ".join(f"(a.f{j} IS NOT NULL AND b.f{j} IS NOT NULL)::INT" for j in range(5)) + ") * ("
        + " + ".join(f"coalesce(pow((a.f{j} - b.f{j}) / (SELECT stddev_pop(f{j}) FROM t WHERE f{t} IS NOT NULL), 2), 0)" for j in range(4))
        + " + coalesce((a.f4 <> b.f4)::INT, 0))) AS dist"
        + f" FROM t a JOIN t b ON a.f{t} IS NULL AND b.f{t} IS NOT NULL"
        for t in range(5)
    )}),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, id ORDER BY dist) AS k FROM d) WHERE k <= 5),
    m AS (SELECT id, t, sum(CAST(v AS DOUBLE) / dist) / sum(1 / dist) AS v FROM n WHERE t < 4 GROUP BY ALL),
    x AS (SELECT id, arg_min(v, (-s, v)) AS v FROM (SELECT id, v, sum(1 / dist) AS s FROM n WHERE t = 4 GROUP BY ALL) GROUP BY id)
    SELECT t.id AS c_custkey, {", ".join(f"round(coalesce(f{i}, m.v), 4) AS f{i}" if i < 4 else "coalesce(f4, x.v) AS f4" for i in range(5))}
    FROM t LEFT JOIN m ON t.id = m.id AND t.id % 5 = m.t LEFT JOIN x ON t.id = x.id""",
)
def _(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey", *_lacking("DOUBLE"))
    out = I.impute_knn(df, "c_custkey")
    return out.select("c_custkey", *[F.round(f"f{i}", 4).alias(f"f{i}") for i in range(4)], "f4")


SMALL = ["l_orderkey", "quantity", "discount", "price", "flag"]


def _g(spark, sf):
    return gappy(spark, sf).withColumn("row", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "price")).select("row", *SMALL[1:])


def _left(df):
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in SMALL[1:]], F.count(F.lit(1)).alias("n_rows"))


DONE = "SELECT 0::BIGINT AS quantity, 0::BIGINT AS discount, 0::BIGINT AS price, 0::BIGINT AS flag, count(*) AS n_rows FROM lineitem"


@query("impute_mice", DONE)
def _(spark, sf):
    return _left(I.impute_mice(_g(spark, sf), SMALL[1:], rounds=1))


@query("impute_missforest", DONE)
def _(spark, sf):
    return _left(I.impute_missforest(_g(spark, sf), SMALL[1:], rounds=1, trees=5))


@query("impute_gbt", DONE)
def _(spark, sf):
    return _left(I.impute_gbt(_g(spark, sf), SMALL[1:], trees=3))


@query(
    "impute_ensemble",
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)
    SELECT event_id, round(coalesce(value, ((SELECT avg(value) FROM e) + 3 * (SELECT median(value) FROM e)) / 4), 5) AS value FROM e""",
)
def _(spark, sf):
    df = _ev(spark, sf).select("event_id", "value")
    return I.impute_ensemble(df, "event_id", {"mean": 1.0, "median": 3.0}).select("event_id", F.round("value", 5).alias("value"))


@query("impute_smart", DONE.replace("lineitem", "lineitem"))
def _(spark, sf):
    return _left(I.impute_smart(_g(spark, sf), key=["row"]))


@query("evaluate_imputer")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("row", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"))
    return I.evaluate_imputer(df.select("row", "l_quantity", "l_extendedprice"), "median", "row", trials=1)


@query("compare_imputers")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("row", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"))
    return I.compare_imputers(df.select("row", "l_quantity", "l_extendedprice"), "row", ["mean", "median", "zero"], trials=1)


@query("impute_by_name", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS value FROM events")
def _(spark, sf):
    return I.impute_by_name(_ev(spark, sf), "zero").select("event_id", "value")


# ---- metrics on predictions that are plain expressions ----


@query(
    "classification_metrics",
    """WITH p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS t, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS g FROM lineitem),
    c AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (t = 1 AND g = 1)::DOUBLE AS tp, count(*) FILTER (t = 0 AND g = 1)::DOUBLE AS fp, count(*) FILTER (t = 1 AND g = 0)::DOUBLE AS fn, count(*) FILTER (t = 0 AND g = 0)::DOUBLE AS tn FROM p)
    SELECT 'accuracy' AS metric, round((tp + tn) / n, 6) AS value FROM c UNION ALL SELECT 'f1_micro', round((tp + tn) / n, 6) FROM c
    UNION ALL SELECT 'f1_macro', round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) FROM c
    UNION ALL SELECT 'f1_weighted', round((2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / n, 6) FROM c
    UNION ALL SELECT 'precision_macro', round((tp / (tp + fp) + tn / (tn + fn)) / 2, 6) FROM c UNION ALL SELECT 'recall_macro', round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) FROM c
    UNION ALL SELECT 'mcc', round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) FROM c""",
)
def _(spark, sf):
    p = table(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_returnflag = 'R' THEN 1.0D ELSE 0.0D END AS label", "CASE WHEN l_quantity > 25 THEN 1.0D ELSE 0.0D END AS prediction"
    )
    return A.classification_metrics(p).withColumn("value", F.round("value", 6))


@query(
    "regression_metrics",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS g FROM lineitem)
    SELECT 'rmse' AS metric, round(sqrt(avg(pow(y - g, 2))), 4) AS value FROM p UNION ALL SELECT 'mae', round(avg(abs(y - g)), 4) FROM p
    UNION ALL SELECT 'r2', round(1 - sum(pow(y - g, 2)) / (var_pop(y) * count(*)), 4) FROM p UNION ALL SELECT 'mape', round(avg(abs((y - g) / y)) * 100, 4) FROM p""",
)
def _(spark, sf):
    p = table(spark, sf, "lineitem").selectExpr("l_extendedprice AS label", "l_quantity * 1500 AS prediction")
    return A.regression_metrics(p).withColumn("value", F.round("value", 4))


LIKELY = "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS label, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS prediction, (l_quantity + 100 * l_discount) / 100 AS p"


@query(
    "binary_report",
    f"""WITH p AS (SELECT label AS y, prediction AS g, round(p, 4)::DOUBLE AS p FROM (SELECT {LIKELY} FROM lineitem)), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM p),
    c AS (SELECT count(*) FILTER (y = 1 AND g = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND g = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND g = 0)::DOUBLE AS fn FROM p)
    SELECT 'f1' AS metric, round(2 * tp / (2 * tp + fp + fn), 6) AS value FROM c UNION ALL SELECT 'precision', round(tp / (tp + fp), 6) FROM c UNION ALL SELECT 'recall', round(tp / (tp + fn), 6) FROM c
    UNION ALL SELECT 'roc_auc', round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)::DOUBLE / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 6) FROM r
    UNION ALL SELECT 'log_loss', round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) FROM p""",
)
def _(spark, sf):
    p = table(spark, sf, "lineitem").selectExpr(*[e.strip() for e in LIKELY.replace(" AS label, ", " AS label; ").replace(" AS prediction, ", " AS prediction; ").split(";")])
    p = p.withColumn("p", F.round("p", 4).cast("double")).withColumn("probability", array_to_vector(F.array(1 - F.col("p"), F.col("p"))))
    out = A.classification_report(p.withColumns({c: F.col(c).cast("double") for c in ("label", "prediction")}))
    return out.filter("metric in ('f1', 'precision', 'recall', 'roc_auc', 'log_loss')").withColumn("value", F.round("value", 6))


@query(
    "soft_vote",
    """WITH p AS (SELECT c_custkey, (c_custkey % 7) / 8.0 AS a, (c_custkey % 5) / 8.0 AS b, (c_custkey % 11) / 16.0 AS c FROM customer)
    SELECT c_custkey, CASE WHEN a + b + c > 3 - (a + b + c) THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM p""",
)
def _(spark, sf):
    p = table(spark, sf, "customer").selectExpr(
        "c_custkey", *[f"array(1 - (c_custkey % {m}) / {d}D, (c_custkey % {m}) / {d}D) AS p{m}" for m, d in ((7, 8), (5, 8), (11, 16))]
    )
    return A.soft_vote(p, ["p7", "p5", "p11"]).select("c_custkey", "prediction")


@query("model_catalog")
def _(spark, sf):
    n = table(spark, sf, "lineitem").count()
    return A.catalog(spark).withColumn("n_rows", F.lit(n))


def _labelled(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", "text")
    d = d.withColumn("n_words", F.regexp_count("text", F.lit(r"\S+"))).withColumn("n_lines", F.regexp_count("text", F.lit("\n"))).drop("text")
    return d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def _prep(spark, sf):
    return A.prepare(_labelled(spark, sf), "quality", ["n_chars", "n_words", "n_lines"], keep=["doc_id"])


def _price(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("row", F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"))
    return A.prepare(df, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], keep=["row"])


@query("cross_validate")
def _(spark, sf):
    return A.cross_validate(_prep(spark, sf), "logistic", ["doc_id"], 3, "stratified")


@query("cross_validate_regression")
def _(spark, sf):
    return A.cross_validate(_price(spark, sf), "ridge", ["row"], 3)


@query("discriminants")
def _(spark, sf):
    p = _prep(spark, sf)
    return A.cross_validate(p, "lda", ["doc_id"], 2).unionByName(A.cross_validate(p, "qda", ["doc_id"], 2))


@query("random_search")
def _(spark, sf):
    return A.random_search(_prep(spark, sf), "logistic", ["doc_id"], trials=2)


@query("joint_search")
def _(spark, sf):
    return A.joint_search(_price(spark, sf), ["ridge", "lasso"], ["row"], trials=1)


@query("nested_cv")
def _(spark, sf):
    return A.nested_cv(_price(spark, sf), "ridge", ["row"], outer=2, trials=1)


@query("learning_curve")
def _(spark, sf):
    return A.learning_curve(_prep(spark, sf), "logistic", ["doc_id"])


def _halves(p, key):
    from ..operators import advise

    d = advise.split_random(p.df, key, 0.3, seed=5)
    return d.filter(~F.col("is_test")).drop("is_test"), d.filter("is_test").drop("is_test")


@query("voting")
def _(spark, sf):
    p = _prep(spark, sf)
    train, test = _halves(p, ["doc_id"])
    return A.classification_metrics(A.voting(p, ["logistic", "decision_tree", "naive_bayes"], train, test))


@query("stacking")
def _(spark, sf):
    p = _price(spark, sf)
    train, test = _halves(p, ["row"])
    return A.regression_metrics(A.stacking(p, ["ridge", "decision_tree"], ["row"], train, test, folds=2))


@query("leaderboard")
def _(spark, sf):
    p = _prep(spark, sf)
    return A.leaderboard(A.cross_validate(p, "logistic", ["doc_id"], 2).unionByName(A.cross_validate(p, "decision_tree", ["doc_id"], 2)))


@query("warm_start")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    found = A.random_search(_price(spark, sf), "ridge", ["row"], trials=2)
    return A.warm_start(df, A.remember(df, found))


@query("run_automl")
def _(spark, sf):
    run = A.run_automl(_labelled(spark, sf), "quality", ["doc_id"], folds=2, columns=["n_chars", "n_words", "n_lines"])
    return run.metrics


@query("automl_predict")
def _(spark, sf):
    df = _labelled(spark, sf)
    run = A.run_automl(df, "quality", ["doc_id"], ["logistic"], folds=2, columns=["n_chars", "n_words", "n_lines"])
    return run.predict(df).select("doc_id", "predicted")


@query("feature_importance")
def _(spark, sf):
    return A.feature_importance(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"], trees=10)


@query("permutation_importance")
def _(spark, sf):
    p = _price(spark, sf)
    model = A.make("ridge", "regression", 3, 2).fit(p.df)
    return A.permutation_importance(p, model, ["row"]).drop("n_rows")


NEAR = """WITH c AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, (c_custkey * 7919 % 10007) / 1000.0 AS y, c_nationkey AS v FROM customer),
    n AS (SELECT a.id, b.v, row_number() OVER (PARTITION BY a.id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS k FROM c a JOIN c b ON a.id % 5 = 0 AND b.id % 5 <> 0)"""


def _near(spark, sf, label: str):
    at = F.array(F.expr("c_acctbal / 1000"), F.expr("CAST((c_custkey * 7919 % 10007) / 1000.0 AS DOUBLE)"))
    df = table(spark, sf, "customer").select("c_custkey", array_to_vector(at).alias("features"), F.expr(label).cast("double").alias("label"))
    return df.where("c_custkey % 5 <> 0"), df.where("c_custkey % 5 = 0")


@query("knn_regression", NEAR + " SELECT id AS c_custkey, round(avg(v), 6) AS prediction FROM n WHERE k <= 5 GROUP BY id")
def _(spark, sf):
    train, test = _near(spark, sf, "c_nationkey")
    return A.make("knn", "regression", 2, 0, k=5).fit(train).transform(test).select("c_custkey", F.round("prediction", 6).alias("prediction"))


@query(
    "knn_classification",
    NEAR
    + """, s AS (SELECT id, v % 4 AS g, count(*) AS c FROM n WHERE k <= 7 GROUP BY ALL)
    SELECT id AS c_custkey, CAST(arg_min(g, (-c, g)) AS DOUBLE) AS prediction, round(max(c) / 7, 6) AS share FROM s GROUP BY id""",
)
def _(spark, sf):
    train, test = _near(spark, sf, "c_nationkey % 4")
    out = A.make("knn", "classification", 2, 4, k=7).fit(train).transform(test)
    return out.select("c_custkey", "prediction", F.round(F.array_max(vector_to_array("probability")), 6).alias("share"))


@query("build_pipeline_knn")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    model = A.build_pipeline(df.drop("c_custkey"), "c_acctbal", "knn").fit(df)
    return model.transform(df).select("c_custkey", "prediction")


@query("build_pipeline")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    model = A.build_pipeline(df, "o_totalprice", "decision_tree").fit(df)
    return model.transform(df).agg(F.count("prediction").alias("n"), F.round(F.avg("prediction"), 2).alias("mean"))


# ---- composed pipelines ----


@query("flow_inspect")
def _(spark, sf):
    return flow.inspect(gappy(spark, sf).drop("shipped")).log_table().select("step", "status")


@query(
    "flow_clean",
    """WITH s AS (SELECT DISTINCT l_quantity AS q, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS tax FROM lineitem)
    SELECT q, round(coalesce(tax, (SELECT median(tax) FROM s)), 6) AS tax FROM s""",
)
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_quantity AS q", "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS tax")
    return flow.Flow().run(df, "clean").df.withColumn("tax", F.round("tax", 6))


@query("flow_prepare")
def _(spark, sf):
    return flow.Flow().run(gappy(spark, sf).select("quantity", "discount", "flag", "shipped"), "prepare").log_table().select("step", "status")


@query("flow_full")
def _(spark, sf):
    return flow.summary(flow.Flow().run(table(spark, sf, "part"), "full"))


@query("flow_automl")
def _(spark, sf):
    run = flow.Flow(target="quality", key=["doc_id"]).run(_labelled(spark, sf), ["analyze", "deduplicate", "automl"])
    return run.results["automl"].select("rank", "model")


@query("flow_plugin", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled FROM orders")
def _(spark, sf):
    f = flow.Flow()
    f.register("double", lambda df: df.select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("doubled")))
    return f.run(table(spark, sf, "orders"), ["double"]).df


@query("flow_log")
def _(spark, sf):
    f = flow.Flow()
    f.register("broken", lambda df: df.select("no_such_column"))
    return f.run(table(spark, sf, "region"), ["broken", "deduplicate"]).log_table().select("step", "status")
