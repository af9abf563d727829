"""Model catalogs, metrics, validation, search, ensembles and reports on MLlib."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scratch
from ..functions.columns import col, frame, nan_to_null, number, numeric_columns, text_columns, union_all
from . import advise
from .knn_models import KNeighbors

X, Y = "features", "label"

# ---- catalogs: name -> estimator from parameters ----

REGRESSORS: dict[str, Callable[..., object]] = {
    "random_forest": lambda **p: R.RandomForestRegressor(seed=42, **p),
    "gradient_boosting": lambda **p: R.GBTRegressor(seed=42, **p),
    "decision_tree": lambda **p: R.DecisionTreeRegressor(seed=42, **p),
    "linear": lambda **p: R.LinearRegression(**p),
    "ridge": lambda **p: R.LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.0, **p}),
    "lasso": lambda **p: R.LinearRegression(**{"regParam": 0.1, "elasticNetParam": 1.0, **p}),
    "elastic_net": lambda **p: R.LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.5, **p}),
    "huber": lambda **p: R.LinearRegression(**{"loss": "huber", **p}),
    "generalized_linear": lambda **p: R.GeneralizedLinearRegression(**p),
    "factorization": lambda **p: R.FMRegressor(seed=42, **p),
    "knn": lambda **p: KNeighbors("regression", **p),
}
CLASSIFIERS: dict[str, Callable[..., object]] = {
    "random_forest": lambda **p: C.RandomForestClassifier(seed=42, **p),
    "gradient_boosting": lambda **p: C.GBTClassifier(seed=42, **p),
    "decision_tree": lambda **p: C.DecisionTreeClassifier(seed=42, **p),
    "logistic": lambda **p: C.LogisticRegression(**p),
    "naive_bayes": lambda **p: C.NaiveBayes(modelType="gaussian", **p),
    "linear_svm": lambda **p: C.LinearSVC(**p),
    "factorization": lambda **p: C.FMClassifier(seed=42, **p),
    "mlp": lambda **p: C.MultilayerPerceptronClassifier(seed=42, **p),
    "knn": lambda **p: KNeighbors("classification", **p),
}
BINARY_ONLY = {"gradient_boosting", "linear_svm", "factorization"}

SPACE: dict[str, dict[str, Sequence]] = {
    "random_forest": {"numTrees": [10, 20, 50], "maxDepth": [3, 5, 8]},
    "gradient_boosting": {"maxIter": [10, 20], "maxDepth": [3, 5], "stepSize": [0.05, 0.1, 0.3]},
    "decision_tree": {"maxDepth": [3, 5, 8, 10], "minInstancesPerNode": [1, 5, 10]},
    "linear": {"regParam": [0.0, 0.01, 0.1]},
    "ridge": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "lasso": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "elastic_net": {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.2, 0.5, 0.8]},
    "huber": {"epsilon": [1.1, 1.35, 1.8]},
    "logistic": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    "naive_bayes": {"smoothing": [0.5, 1.0]},
    "linear_svm": {"regParam": [0.001, 0.01, 0.1]},
    "knn": {"k": [3, 5, 9, 15], "weights": ["uniform", "distance"]},
}


def catalog(spark: SparkSession) -> DataFrame:
    rows = [("regression", m) for m in REGRESSORS] + [("classification", m) for m in [*CLASSIFIERS, "lda", "qda"]]
    return frame(spark, rows, "task string, model string")


def make(name: str, task: str, n_features: int, n_classes: int, **params):
    if task == "regression":
        return REGRESSORS[name](featuresCol=X, labelCol=Y, **params)
    if name == "mlp":
        params.setdefault("layers", [n_features, max(4, n_features), n_classes])
    est = CLASSIFIERS[name](featuresCol=X, labelCol=Y, **params)
    if n_classes > 2 and name in BINARY_ONLY:
        est = C.OneVsRest(classifier=est, featuresCol=X, labelCol=Y)
    return est


# ---- preparation ----


@dataclass
class Prepared:
    df: DataFrame  # key?, features, label
    task: str
    names: list[str]
    labels: list[str]
    pipeline: PipelineModel


def prepare(df: DataFrame, target: str, columns: Sequence[str] | None = None, keep: Sequence[str] = (), task: str | None = None) -> Prepared:
    """Numeric features median-filled and scaled, label indexed, written once."""
    df = nan_to_null(df).filter(col(target).isNotNull())
    task = task or ("regression" if advise.detect_task(df, target) == "regression" else "classification")
    names = [c for c in (columns or numeric_columns(df)) if c != target and c not in keep]
    rows = df.select(*[number(c).alias(c) for c in names], *[col(k) for k in keep], col(target).alias("__t"))
    stages = [
        Imputer(strategy="median", inputCols=names, outputCols=[f"__n_{c}" for c in names]),
        VectorAssembler(inputCols=[f"__n_{c}" for c in names], outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol=X, withMean=True, withStd=True),
    ]
    labels: list[str] = []
    if task == "classification":
        rows = rows.withColumn("__t", F.col("__t").cast("string"))
        stages.append(StringIndexer(inputCol="__t", outputCol=Y, stringOrderType="alphabetAsc"))
    model = Pipeline(stages=stages).fit(rows)
    out = model.transform(rows)
    if task == "classification":
        labels = list(model.stages[-1].labels)
    else:
        out = out.withColumn(Y, F.col("__t").cast("double"))
    return Prepared(scratch.materialise(out.select(*[col(k) for k in keep], X, Y)), task, names, labels, model)


# ---- metrics ----


def confusion(pred: DataFrame, label: str = Y, prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(col(label).alias("truth"), col(prediction).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(pred: DataFrame, label: str = Y, prediction: str = "prediction") -> DataFrame:
    """accuracy, macro / weighted / micro F1, precision, recall and MCC from the confusion table."""
    cells = confusion(pred, label, prediction).collect()  # classes squared
    n = sum(r["n"] for r in cells) or 1
    classes = sorted({r["truth"] for r in cells} | {r["guess"] for r in cells})
    at = {(r["truth"], r["guess"]): r["n"] for r in cells}
    true = {c: sum(at.get((c, g), 0) for g in classes) for c in classes}
    said = {c: sum(at.get((t, c), 0) for t in classes) for c in classes}
    hit = {c: at.get((c, c), 0) for c in classes}
    prec = {c: hit[c] / said[c] if said[c] else 0.0 for c in classes}
    rec = {c: hit[c] / true[c] if true[c] else 0.0 for c in classes}
    f1 = {c: 2 * prec[c] * rec[c] / (prec[c] + rec[c]) if prec[c] + rec[c] else 0.0 for c in classes}
    right = sum(hit.values())
    k = len(classes) or 1
    top = right * n - sum(said[c] * true[c] for c in classes)
    down = ((n * n - sum(s * s for s in said.values())) * (n * n - sum(t * t for t in true.values()))) ** 0.5
    rows = [
        ("accuracy", right / n),
        ("f1_macro", sum(f1.values()) / k),
        ("f1_micro", right / n),
        ("f1_weighted", sum(f1[c] * true[c] for c in classes) / n),
        ("precision_macro", sum(prec.values()) / k),
        ("recall_macro", sum(rec.values()) / k),
        ("mcc", top / down if down else 0.0),
    ]
    return frame(pred.sparkSession, [(m, float(v)) for m, v in rows], "metric string, value double")


def regression_metrics(pred: DataFrame, label: str = Y, prediction: str = "prediction") -> DataFrame:
    y, p = number(label), number(prediction)
    e = y - p
    one = pred.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"),
        (F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))) * 100).alias("mape"),
    )
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rmse", "mae", "r2", "mape")])
    return one.select(F.inline(cells))


def log_loss(pred: DataFrame, label: str = Y, probability: str = "probability") -> float:
    p = F.get(vector_to_array(F.col(probability)), col(label).cast("int"))
    return pred.agg(F.avg(-F.ln(F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))))).first()[0]


def auc(pred: DataFrame, label: str = Y, score: str = "rawPrediction") -> float:
    """Area under the ROC curve over all distinct scores."""
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score, numBins=0).evaluate(pred)


def with_score(pred: DataFrame) -> DataFrame:
    """``pred`` with __score, how strongly each row is called class 1: probability, margin, or the class itself."""
    if "probability" in pred.columns:
        s = F.get(vector_to_array(F.col("probability")), 1)
    elif "rawPrediction" in pred.columns:
        s = F.get(vector_to_array(F.col("rawPrediction")), 1)
    else:
        s = number("prediction")
    return pred.withColumn("__score", F.coalesce(s.cast("double"), F.lit(0.0)))


def classification_report(pred: DataFrame, label: str = Y) -> DataFrame:
    """``classification_metrics``, for two classes also f1, precision, recall of class 1 and roc_auc, and log_loss from probabilities."""
    m = classification_metrics(pred, label)
    rows: list[tuple[str, float]] = []
    two = pred.filter(~col(label).isin(0.0, 1.0)).isEmpty() and pred.select(label).distinct().limit(3).count() == 2
    if two:
        at = {(r["truth"], r["guess"]): r["n"] for r in confusion(pred, label).collect()}  # four cells
        tp, fp, fn = at.get((1.0, 1.0), 0), at.get((0.0, 1.0), 0), at.get((1.0, 0.0), 0)
        rows += [("f1", 2 * tp / max(1, 2 * tp + fp + fn)), ("precision", tp / max(1, tp + fp)), ("recall", tp / max(1, tp + fn))]
        rows.append(("roc_auc", auc(with_score(pred), label, "__score")))
    if "probability" in pred.columns:
        rows.append(("log_loss", float(log_loss(pred, label) or 0.0)))
    return m.unionByName(frame(pred.sparkSession, [(k, float(v)) for k, v in rows], "metric string, value double"))


def score_of(pred: DataFrame, task: str) -> float:
    """The figure models are ranked by: R², for two classes the ROC area, for more the macro F1."""
    if task == "regression":
        return float(regression_metrics(pred).filter("metric = 'r2'").first()["value"] or 0.0)
    k = pred.select(Y).distinct().limit(3).count()
    if k == 2 and pred.filter(~col(Y).isin(0.0, 1.0)).isEmpty():
        return float(auc(with_score(pred), Y, "__score"))
    return float(classification_metrics(pred).filter("metric = 'f1_macro'").first()["value"] or 0.0)


# ---- linear and quadratic discriminants from class moments ----


@dataclass
class Discriminant:
    """LDA or QDA: one expression per class, no UDF."""

    names: list[str]
    terms: dict[float, Column]

    def transform(self, df: DataFrame) -> DataFrame:
        best = F.array_max(F.array(*[F.struct(e.alias("s"), F.lit(c).alias("c")) for c, e in self.terms.items()]))
        logs = F.array(*[self.terms[c] for c in sorted(self.terms)])
        out = df.withColumns({"prediction": best["c"], "__t": logs})
        parts = F.transform("__t", lambda t: F.exp(t - F.array_max("__t")))
        total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return out.withColumn("probability", array_to_vector(F.transform(parts, lambda x: x / total))).drop("__t")


def fit_discriminant(df: DataFrame, kind: str = "lda", features: str = X, label: str = Y, width: int | None = None) -> Discriminant:
    import numpy as np

    width = width or len(df.select(features).first()[0])
    v = vector_to_array(F.col(features))
    flat = df.select(col(label).alias("y"), *[v[i].alias(f"x{i}") for i in range(width)])
    aggs = [F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(width)]]
    aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(width) for j in range(i, width)]
    rows = flat.groupBy("y").agg(*aggs).collect()  # one row per class
    n = sum(r["n"] for r in rows)
    covs = {}
    for r in rows:
        c = np.zeros((width, width))
        for i in range(width):
            for j in range(i, width):
                c[i, j] = c[j, i] = r[f"c{i}_{j}"] or 0.0
        covs[r["y"]] = c
    pooled = sum(covs[r["y"]] * r["n"] for r in rows) / n
    terms = {}
    for r in rows:
        cov = (pooled if kind == "lda" else covs[r["y"]]) + 1e-9 * np.eye(width)
        inv = np.linalg.pinv(cov)
        d = [v[i] - float(r[f"m{i}"]) for i in range(width)]
        q = None
        for i in range(width):
            for j in range(i, width):
                t = d[i] * d[j] * float(inv[i, j] * (1 if i == j else 2))
                q = t if q is None else q + t
        sign, logdet = np.linalg.slogdet(cov)
        terms[float(r["y"])] = q * -0.5 + float(np.log(r["n"] / n) - 0.5 * logdet)
    return Discriminant([], terms)


# ---- validation ----


def fold_column(df: DataFrame, folds: int, key: Sequence[str], strategy: str = "kfold", label: str = Y, time_col: str | None = None, seed: int = 42) -> DataFrame:
    if strategy == "stratified":
        return advise.stratified_folds(df, label, key, folds, seed)
    if strategy == "time":
        return advise.time_folds(df, time_col, folds, tie=key)
    return advise.k_folds(df, key, folds, seed)


def cross_validate(prep: Prepared, name: str, key: Sequence[str], folds: int = 3, strategy: str = "kfold", params: Mapping | None = None, repeats: int = 1, time_col: str | None = None) -> DataFrame:
    """(model, repeat, fold, train_score, score); time folds train on earlier folds only."""
    rows = []
    spark = prep.df.sparkSession
    for rep in range(repeats):
        data = scratch.materialise(fold_column(prep.df, folds, key, strategy, Y, time_col, 42 + rep))
        for f in range(1 if strategy == "time" else 0, folds):
            train = data.filter(F.col("fold") < f) if strategy == "time" else data.filter(F.col("fold") != f)
            test = data.filter(F.col("fold") == f)
            if name in ("lda", "qda"):
                model = fit_discriminant(train, name, width=len(prep.names))
            else:
                model = make(name, prep.task, len(prep.names), max(len(prep.labels), 2), **dict(params or {})).fit(train)
            rows.append((name, rep, f, score_of(model.transform(train), prep.task), score_of(model.transform(test), prep.task)))
    return frame(spark, rows, "model string, repeat int, fold int, train_score double, score double")


def random_search(prep: Prepared, name: str, key: Sequence[str], trials: int = 4, folds: int = 2, seed: int = 42) -> DataFrame:
    """(model, params, mean, std) of randomly drawn parameters, best first."""
    rng = random.Random(seed)
    space = SPACE.get(name, {})
    tried, parts = set(), []
    for _ in range(trials):
        p = {k: rng.choice(list(v)) for k, v in space.items()}
        tag = repr(sorted(p.items()))
        if tag in tried:
            continue
        tried.add(tag)
        cv = cross_validate(prep, name, key, folds, params=p)
        parts.append(cv.groupBy("model").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std")).withColumn("params", F.lit(tag)))
    return union_all(parts).orderBy(F.desc("mean"), "params")


def joint_search(prep: Prepared, names: Sequence[str], key: Sequence[str], trials: int = 2, folds: int = 2) -> DataFrame:
    """Model and parameters together: the best draw over several models."""
    return union_all([random_search(prep, n, key, trials, folds) for n in names]).orderBy(F.desc("mean"), "model")


def nested_cv(prep: Prepared, name: str, key: Sequence[str], outer: int = 3, trials: int = 2) -> DataFrame:
    """Outer score with the parameters chosen inside each outer training part."""
    data = scratch.materialise(advise.k_folds(prep.df, key, outer, seed=7).withColumnRenamed("fold", "outer"))
    rows = []
    for f in range(outer):
        train, test = data.filter(F.col("outer") != f).drop("outer"), data.filter(F.col("outer") == f)
        best = random_search(Prepared(train, prep.task, prep.names, prep.labels, prep.pipeline), name, key, trials).first()
        params = dict(eval_params(best["params"]))
        model = make(name, prep.task, len(prep.names), max(len(prep.labels), 2), **params).fit(train)
        rows.append((name, f, best["params"], best["mean"], score_of(model.transform(test), prep.task)))
    return frame(prep.df.sparkSession, rows, "model string, fold int, params string, inner_score double, outer_score double")


def eval_params(text: str) -> list[tuple[str, object]]:
    import ast

    return ast.literal_eval(text)


def learning_curve(prep: Prepared, name: str, key: Sequence[str], shares: Sequence[float] = (0.2, 0.5, 1.0)) -> DataFrame:
    """(share, train_score, score, diagnosis) at growing training sizes."""
    data = scratch.materialise(advise.split_random(prep.df, key, 0.2, seed=3).withColumn("u", advise._hash_unit(key, 9)))
    test = data.filter("is_test")
    rows = []
    for s in shares:
        train = data.filter((~F.col("is_test")) & (F.col("u") < s))
        model = make(name, prep.task, len(prep.names), max(len(prep.labels), 2)).fit(train)
        a, b = score_of(model.transform(train), prep.task), score_of(model.transform(test), prep.task)
        rows.append((float(s), a, b, "overfit" if a - b > 0.15 else "underfit" if b < 0.6 else "good"))
    return frame(prep.df.sparkSession, rows, "share double, train_score double, score double, diagnosis string")


def leaderboard(cv: DataFrame, seconds: Mapping[str, float] | None = None) -> DataFrame:
    """(rank, model, mean, std, overfit, seconds) best first."""
    g = cv.groupBy("model").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.avg(F.col("train_score") - F.col("score")).alias("gap")
    )
    took = F.lit(None).cast("double")
    for m, s in (seconds or {}).items():
        took = F.when(F.col("model") == m, float(s)).otherwise(took)
    w = Window.orderBy(F.desc("mean"), "model")  # one row per model
    return g.select(F.row_number().over(w).alias("rank"), "model", "mean", "std", (F.col("gap") > 0.15).alias("overfit"), took.alias("seconds"))


# ---- ensembles ----


def _model_output(pred: DataFrame, name: str, classes: int) -> DataFrame:
    """A model's answer in one column p_<name>: the number, or the probability of every class (a sure 1 where it has none)."""
    if not classes:
        return pred.withColumnRenamed("prediction", f"p_{name}")
    if "probability" in pred.columns:
        p = vector_to_array(F.col("probability"))
    else:
        p = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == F.col("prediction")).cast("double"))
    return pred.withColumn(f"p_{name}", p).drop("prediction", "rawPrediction", "probability")


def soft_vote(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the mean of the models' class probabilities and the likeliest class (ties: the smallest)."""
    k = len(columns)
    mean = F.col(columns[0])
    for c in columns[1:]:
        mean = F.zip_with(mean, F.col(c), lambda a, b: a + b)
    out = df.withColumn("__p", F.transform(mean, lambda x: x / k))
    first = F.array_position("__p", F.array_max("__p")) - 1
    return out.withColumns({"prediction": first.cast("double"), "probability": array_to_vector(F.col("__p"))}).drop("__p")


def voting(prep: Prepared, names: Sequence[str], train: DataFrame, test: DataFrame) -> DataFrame:
    """Mean prediction for numbers, likeliest class by mean probability for classes."""
    classes = 0 if prep.task == "regression" else max(len(prep.labels), 2)
    out = test
    for n in names:
        model = make(n, prep.task, len(prep.names), max(len(prep.labels), 2)).fit(train)
        out = _model_output(model.transform(out), n, classes)
    if prep.task == "regression":
        cols = [F.col(f"p_{n}") for n in names]
        return out.withColumn("prediction", sum(cols[1:], cols[0]) / len(cols))
    return soft_vote(out, [f"p_{n}" for n in names])


def stacking(prep: Prepared, names: Sequence[str], key: Sequence[str], train: DataFrame, test: DataFrame, folds: int = 3) -> DataFrame:
    """Out-of-fold answers of the base models (numbers, or class probabilities) feed a ridge or logistic model."""
    classes = 0 if prep.task == "regression" else max(len(prep.labels), 2)
    data = scratch.materialise(advise.k_folds(train, key, folds, seed=11))
    parts = []
    for f in range(folds):
        part = data.filter(F.col("fold") == f)
        for n in names:
            m = make(n, prep.task, len(prep.names), max(len(prep.labels), 2)).fit(data.filter(F.col("fold") != f))
            part = _model_output(m.transform(part), n, classes)
        parts.append(part)
    meta = scratch.materialise(union_all(parts))
    out = test
    for n in names:
        m = make(n, prep.task, len(prep.names), max(len(prep.labels), 2)).fit(train)
        out = _model_output(m.transform(out), n, classes)

    def flat(df: DataFrame) -> DataFrame:  # the last class's probability says nothing new
        if not classes:
            return df
        return df.withColumns({f"p_{n}_{k}": F.get(f"p_{n}", k) for n in names for k in range(classes - 1)})

    inputs = [f"p_{n}_{k}" for n in names for k in range(classes - 1)] if classes else [f"p_{n}" for n in names]
    meta, out = flat(meta), flat(out)
    va = VectorAssembler(inputCols=inputs, outputCol="meta")
    top = R.LinearRegression(featuresCol="meta", labelCol=Y, regParam=0.01) if prep.task == "regression" else C.LogisticRegression(featuresCol="meta", labelCol=Y)
    return top.fit(va.transform(meta)).transform(va.transform(out))


# ---- warm start, importance, the whole run ----


def shape_key(df: DataFrame) -> Column:
    return F.sha2(F.lit(",".join(df.columns)), 256)


def remember(df: DataFrame, results: DataFrame) -> DataFrame:
    """Rows (table_key, model, params, score) for a table of past searches."""
    return results.select(shape_key(df).alias("table_key"), "model", "params", F.col("mean").alias("score"))


def warm_start(df: DataFrame, store: DataFrame) -> DataFrame:
    """Best known parameters per model for tables of the same columns."""
    return store.filter(F.col("table_key") == shape_key(df)).groupBy("model").agg(
        F.max_by("params", "score").alias("params"), F.max("score").alias("score")
    )


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """``df`` with a text column replaced by how many rows hold its value; null stays null."""
    per = df.filter(col(column).isNotNull()).groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).cast("double").alias("__n"))
    return df.join(per, col(column) == F.col("__v"), "left").withColumn(column, F.col("__n")).drop("__v", "__n")


def feature_importance(df: DataFrame, target: str, columns: Sequence[str] | None = None, trees: int = 50) -> DataFrame:
    """(feature, importance, share, rank) from a forest over the whole table.

    Text with up to 100 values is indexed; text with more stands as the count of its
    value, so no column is left out.
    """
    df = nan_to_null(df).filter(col(target).isNotNull())
    task = advise.detect_task(df, target)
    texts = [c for c in text_columns(df) if c != target and (columns is None or c in columns)]
    nums = [c for c in numeric_columns(df) if c != target and (columns is None or c in columns)]
    many: list[str] = []
    if texts:  # a forest splits on categories, of which it takes a limited number
        row = df.agg(*[F.countDistinct(col(c)).alias(c) for c in texts]).first()
        many = [c for c in texts if row[c] > 100]
        texts = [c for c in texts if row[c] <= 100]
    for c in many:
        df = value_frequency(df, c)
    nums += many
    rows = df.select(*[number(c).alias(c) for c in nums], *[F.coalesce(col(c), F.lit("")).alias(c) for c in texts], col(target).cast("string").alias("__t") if task != "regression" else number(target).alias(Y))
    stages: list = []
    if nums:
        stages.append(Imputer(strategy="median", inputCols=nums, outputCols=[f"__n_{c}" for c in nums]))
    stages += [StringIndexer(inputCol=c, outputCol=f"__n_{c}", handleInvalid="keep") for c in texts]
    names = [*nums, *texts]
    stages.append(VectorAssembler(inputCols=[f"__n_{c}" for c in names], outputCol=X))
    if task != "regression":
        stages.append(StringIndexer(inputCol="__t", outputCol=Y, stringOrderType="alphabetAsc"))
        stages.append(C.RandomForestClassifier(featuresCol=X, labelCol=Y, numTrees=trees, seed=42, maxBins=256))
    else:
        stages.append(R.RandomForestRegressor(featuresCol=X, labelCol=Y, numTrees=trees, seed=42, maxBins=256))
    imp = Pipeline(stages=stages).fit(rows).stages[-1].featureImportances.toArray()
    total = float(imp.sum()) or 1.0
    order = sorted(zip(names, imp), key=lambda p: (-p[1], p[0]))
    return frame(df.sparkSession, [(n, float(v), float(v) / total, i + 1) for i, (n, v) in enumerate(order)], "feature string, importance double, share double, rank int")


def permutation_importance(prep: Prepared, model, key: Sequence[str]) -> DataFrame:
    """Loss of score when one feature is replaced by the value of another, hashed row."""
    spark = prep.df.sparkSession
    base = score_of(model.transform(prep.df), prep.task)
    v = vector_to_array(F.col(X))
    w = scratch.materialise(prep.df.withColumn("v", v))
    n = w.count()
    from pyspark.ml.functions import array_to_vector

    from ..functions import values

    numbered = scratch.materialise(values.with_position(w, [*key], "p"))
    donor = values.with_position(w.withColumn("h", advise._hash_order(key, 5)), ["h", *key], "p").select("p", F.col("v").alias("dv"))
    mixed = scratch.materialise(numbered.join(donor, "p"))
    rows = []
    for i, name in enumerate(prep.names):
        swapped = F.transform(F.col("v"), lambda x, j: F.when(j == i, F.get(F.col("dv"), j)).otherwise(x))  # noqa: B023
        s = score_of(model.transform(mixed.withColumn(X, array_to_vector(swapped))), prep.task)
        rows.append((name, base - s))
    return frame(spark, rows, "feature string, loss double").withColumn("n_rows", F.lit(n))


def build_pipeline(df: DataFrame, target: str, model: str = "random_forest") -> Pipeline:
    """An unfitted MLlib pipeline: numbers imputed and scaled, text one-hot, then the model."""
    task = "regression" if advise.detect_task(df, target) == "regression" else "classification"
    nums = [c for c in numeric_columns(df) if c != target]
    texts = [c for c in text_columns(df) if c != target]
    stages: list = []
    parts = []
    if nums:
        stages += [
            Imputer(strategy="median", inputCols=nums, outputCols=[f"{c}_filled" for c in nums]),
            VectorAssembler(inputCols=[f"{c}_filled" for c in nums], outputCol="numbers_raw"),
            StandardScaler(inputCol="numbers_raw", outputCol="numbers", withMean=True),
        ]
        parts.append("numbers")
    if texts:
        stages += [
            StringIndexer(inputCols=texts, outputCols=[f"{c}_index" for c in texts], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_index" for c in texts], outputCols=[f"{c}_hot" for c in texts]),
        ]
        parts += [f"{c}_hot" for c in texts]
    stages.append(VectorAssembler(inputCols=parts, outputCol=X))
    if task == "classification":
        stages.append(StringIndexer(inputCol=target, outputCol=Y, stringOrderType="alphabetAsc"))
        stages.append(make(model, task, 0, 2))
    else:
        est = make(model, task, 0, 2)
        est.setLabelCol(target)
        stages.append(est)
    return Pipeline(stages=stages)


@dataclass
class AutoML:
    task: str
    board: DataFrame
    best: str
    model: object
    prepared: Prepared
    metrics: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Predictions for new rows with the same feature columns."""
        rows = nan_to_null(df)
        names = self.prepared.names
        stages = self.prepared.pipeline.stages[:3]  # impute, assemble, scale
        out = rows.withColumns({c: number(c) for c in names})
        for s in stages:
            out = s.transform(out)
        out = self.model.transform(out)
        if self.task == "classification":
            names_ = F.array(*[F.lit(v) for v in self.prepared.labels])
            out = out.withColumn("predicted", F.get(names_, F.col("prediction").cast("int")))
        return out


def run_automl(df: DataFrame, target: str, key: Sequence[str], models: Sequence[str] | None = None, folds: int = 3, columns: Sequence[str] | None = None) -> AutoML:
    """Detect the task, cross-validate several models, refit the best, report held-out metrics."""
    prep = prepare(df, target, columns, keep=key)
    prep.df = scratch.materialise(advise.split_random(prep.df, key, 0.2, seed=1))
    train, test = prep.df.filter(~F.col("is_test")).drop("is_test"), prep.df.filter("is_test").drop("is_test")
    inner = Prepared(train, prep.task, prep.names, prep.labels, prep.pipeline)
    names = list(models or (["ridge", "random_forest", "gradient_boosting"] if prep.task == "regression" else ["logistic", "random_forest", "naive_bayes"]))
    parts, seconds = [], {}
    for n in names:
        t0 = time.time()
        parts.append(cross_validate(inner, n, key, folds, "stratified" if prep.task == "classification" else "kfold"))
        seconds[n] = round(time.time() - t0, 3)
    board = leaderboard(union_all(parts), seconds)
    best = board.orderBy("rank").first()["model"]
    width = len(prep.names)
    model = fit_discriminant(train, best, width=width) if best in ("lda", "qda") else make(best, prep.task, width, max(len(prep.labels), 2)).fit(train)
    pred = model.transform(test)
    metrics = regression_metrics(pred) if prep.task == "regression" else classification_report(pred)
    return AutoML(prep.task, board, best, model, prep, metrics, seconds)
