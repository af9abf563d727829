"""Imputers that learn from the other columns, and how to compare imputers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scratch
from ..functions.columns import col, frame, kinds, nan_to_null, number, numeric_columns, one_row, text_columns, union_all
from . import clean, impute
from .neighbours import nearest

MAX_CLASSES = 100
BINS = 128
CELLS_FROM = 2_000_000  # rows from which trees learn from counted cells


def impute_knn(df: DataFrame, key: str, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Distance-weighted mean (text: weighted vote) of the k nearest rows that have the missing cell's column.

    Rows and donors may both have gaps: the distance uses the columns that both have,
    sqrt(d / common · sum of squares) for d columns. Numbers are scaled to unit
    variance among the donors of the column that is filled, text counts 0 if equal and 1 if not.
    All gaps of all patterns are one search. A donor at distance 0 outweighs all others; text
    ties go to the smallest value. Cells without any donor take the mean, text the mode.
    """
    df = nan_to_null(df)
    num = [c for c in (columns or numeric_columns(df)) if c != key and c in numeric_columns(df)]
    text = [c for c in (columns or text_columns(df)) if c != key and c in text_columns(df)]
    names = [*num, *text]
    holes = [c for c in clean.columns_with_nulls(df) if c in names]
    if not holes:
        return df
    code = lambda c: F.xxhash64(col(c)).bitwiseAND(F.lit((1 << 52) - 1))  # noqa: E731  # exact as a double
    v = F.array(*[number(c).cast("double") for c in num], *[F.when(col(c).isNotNull(), code(c)).cast("double") for c in text])
    rows = scratch.materialise(df.select(col(key).cast("long").alias("rid"), v.alias("v"), *[col(c).alias(f"__t_{c}") for c in text if c in holes]))
    wanted = [names.index(c) for c in holes]
    spread = one_row(rows, {f"s{t}_{j}": F.stddev_pop(F.when(F.col("v")[t].isNotNull(), F.col("v")[j])) for t in wanted for j in range(len(num))})
    scales = np.ones((len(names), len(names)))
    for t in wanted:
        scales[t, : len(num)] = [spread[f"s{t}_{j}"] or 1.0 for j in range(len(num))]
    for t in set(range(len(names))) - set(wanted):
        scales[t] = scales[wanted[0]]
    gone = F.filter(F.array(*[F.lit(t) for t in wanted]), lambda t: F.get("v", t).isNull())
    some = F.exists("v", lambda x: x.isNotNull())
    ask = rows.where(some).select(F.col("rid").alias("lid"), "v", F.explode(gone).alias("target"))
    is_text = [False] * len(num) + [True] * len(text)
    nn = scratch.materialise(nearest(ask, rows.where(some).select("rid", "v"), k, True, is_text, scales))
    zero = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("lid", "target"))  # k rows each
    w = F.when(F.col("z") == 1, (F.col("dist") == 0).cast("double")).otherwise(1 / F.nullif(F.col("dist"), F.lit(0.0)))
    near = nn.withColumn("z", zero).withColumn("w", w)
    for_one = lambda t, e: F.sum(F.when(F.col("target") == t, e))
    means = [
        (for_one(t, F.col("value") * F.col("w")) / F.nullif(for_one(t, F.col("w")), F.lit(0.0))).alias(f"__f_{names[t]}") for t in wanted if t < len(num)
    ]
    out = df
    lid = col(key).cast("long")
    if means:
        got = near.where(F.col("target") < len(num)).groupBy(F.col("lid").alias("__k")).agg(*means)
        out = out.join(got, lid == F.col("__k"), "left").drop("__k")
    for t in wanted:
        if t < len(num):
            continue
        c = names[t]
        votes = near.where(F.col("target") == t).join(rows.select("rid", col(f"__t_{c}").alias("x")), "rid").groupBy("lid", "x").agg(F.sum("w").alias("s"))
        best = votes.groupBy(F.col("lid").alias("__k")).agg(F.min(F.struct(-F.col("s"), "x"))["x"].alias(f"__f_{c}"))
        out = out.join(best, lid == F.col("__k"), "left").drop("__k")
    picked = [
        (F.coalesce(number(c), F.col(f"__f_{c}")) if c in num else F.coalesce(col(c), F.col(f"__f_{c}"))).alias(c) if c in holes else col(c)
        for c in df.columns
    ]
    return impute.impute_simple(out.select(*picked), "mean")


def _with_count(df: DataFrame, column: str) -> DataFrame:
    """``df`` with __n_<column>: how many rows hold the column's value (0 for null)."""
    name = f"__n_{column}"
    if name in df.columns:
        return df
    per = df.groupBy(col(column).alias("__v")).agg(F.count(F.lit(1)).cast("double").alias(name))
    return df.join(per, col(column) == F.col("__v"), "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop("__v")


def _conditional_mode(df: DataFrame, column: str, given: Sequence[str]) -> DataFrame:
    """Missing cells of a text column take the commonest value among rows that agree in ``given`` (the first column of it).

    Ties go to the smallest value; where no row agrees, the earlier fill stays.
    """
    if not given:
        return df
    known = df.filter(~F.col(f"__m_{column}"))
    counts = known.groupBy(col(given[0]).alias("__g"), col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy("__g").agg(F.min(F.struct(-F.col("__n"), "__v"))["__v"].alias("__b"))  # one row per class, at most MAX_CLASSES
    out = df.join(F.broadcast(best), col(given[0]) == F.col("__g"), "left")
    return out.withColumn(column, F.when(F.col(f"__m_{column}"), F.coalesce("__b", col(column))).otherwise(col(column))).drop("__g", "__b")


Learner = Callable[[str, str], object]


def _cuts(df: DataFrame, names: Sequence[str]) -> dict[str, list[float]]:
    """Where to cut numeric columns into at most ``BINS`` bins: between all values if they are few, else at quantiles of all rows.

    A column without values is left out.
    """
    probs = [i / BINS for i in range(1, BINS)]
    aggs = {}
    for c in names:
        aggs[f"n_{c}"] = F.approx_count_distinct(number(c), 0.02)
        aggs[f"q_{c}"] = F.percentile_approx(number(c), probs, 4_096)
    got = one_row(df, aggs)
    few = [c for c in names if got[f"n_{c}"] < BINS * 1.2]
    sets = one_row(df, {c: F.collect_set(number(c)) for c in few}) if few else {}  # about BINS values a column
    out = {}
    for c in names:
        values = sorted(sets.get(c, ()))
        if c in sets and len(values) <= BINS:
            cuts = [a + (b - a) / 2 for a, b in zip(values[:-1], values[1:])]
        else:
            cuts = [float(x) for x in got[f"q_{c}"] or ()]
        cuts = sorted({x for x in cuts if np.isfinite(x)})
        if got[f"n_{c}"]:
            out[c] = cuts
    return out


def _binned(df: DataFrame, cuts: Mapping[str, Sequence[float]]) -> DataFrame:
    """``df`` with __b_<column>, the bin of each column's value."""
    for c, x in cuts.items():
        cut = Bucketizer(splits=[-np.inf, *(x or [0.0]), np.inf], inputCol="__v", outputCol="__o", handleInvalid="keep")
        df = cut.transform(df.withColumn("__v", number(c))).withColumn(f"__b_{c}", F.col("__o") + F.lit(0.0))  # a plain number, no class
        df = df.drop("__v", "__o")
    return df


def _counted(train: DataFrame, by: Sequence[str], target: str, is_number: bool, n: int, most: float) -> DataFrame | None:
    """Equal rows of ``by`` as one, with how many they are (__w) and the mean of the target (__y); a text target is one of ``by``.

    ``most`` is the largest number of such cells by the numbers of bins and classes. None if there may be too many for it to pay.
    """
    if most > n / 8 and train.agg(F.approx_count_distinct(F.struct(*[col(c) for c in by]), 0.02)).first()[0] > n / 8:
        return None
    aggs = [F.count(F.lit(1)).cast("double").alias("__w")]
    if is_number:
        aggs.append(F.avg(number(target)).alias("__y"))
    return scratch.materialise(train.groupBy(*[col(c) for c in by]).agg(*aggs))


def _forest(cells: DataFrame, stages: list, classify: Learner) -> Callable[[DataFrame], DataFrame]:
    """A forest of counted cells: each tree takes a cell as often as drawing its rows with replacement would.

    A row is drawn a Poisson number of times, so a cell of n rows is with mean n. Trees vote by the shares of
    their leaves, as in one forest. What is returned adds ``prediction``.
    """
    forest = classify("__x", "__y")
    names = cells.columns
    ready = Pipeline(stages=stages).fit(cells)
    trees = []
    for t in range(forest.getNumTrees()):
        seed = forest.getSeed() + t

        def draw(batches, seed=seed):
            for b in batches:
                at = b.schema.names.index("__w")
                if b.num_rows:  # the written cells come in the same batches again
                    rng = np.random.default_rng([seed, b.column(b.schema.names.index("__k"))[0].as_py() & (2**63 - 1)])
                    b = b.set_column(at, "__w", pa.array(rng.poisson(b.column(at).to_numpy()).astype(float)))
                yield b

        key = F.xxhash64(*[col(c) for c in names if c != "__w"])
        keyed = cells.withColumn("__k", key)
        drawn = scratch.materialise(keyed.mapInArrow(draw, keyed.schema).drop("__k").where("__w > 0"))
        one = classify("__x", "__y").setNumTrees(1).setSeed(seed).setBootstrap(False).setWeightCol("__w")
        one = one.setFeatureSubsetStrategy("sqrt" if forest.getNumTrees() > 1 and forest.getFeatureSubsetStrategy() == "auto" else forest.getFeatureSubsetStrategy())
        trees.append(one.fit(ready.transform(drawn)))

    def predict(df: DataFrame) -> DataFrame:
        df = ready.transform(df)
        for t, tree in enumerate(trees):
            df = tree.setRawPredictionCol("").setPredictionCol("").setProbabilityCol(f"__p{t}").transform(df)
        shares = [vector_to_array(F.col(f"__p{t}")) for t in range(len(trees))]
        votes = shares[0]
        for x in shares[1:]:
            votes = F.zip_with(votes, x, lambda a, b: a + b)
        return df.withColumn("__v", votes).withColumn("prediction", (F.array_position("__v", F.array_max("__v")) - 1).cast("double"))

    return predict


def _iterate(
    df: DataFrame, columns: Sequence[str] | None, regress: Learner, classify: Learner, rounds: int, initial: str = "mean", trees: bool = False
) -> DataFrame:
    """Fill every gap from a model of the other columns, round after round.

    Missing cells are remembered by flag columns, so predictions replace only
    them; each filled column is written out, so the passes of the next fit do not repeat the models before it.
    With ``trees``, learners see bins only, so rows that fall into the same bins are counted once and learnt from as
    one weighted row, if the table is large and that leaves an eighth of the rows at most.
    """
    df = nan_to_null(df)
    usable = [c for c, k in kinds(df).items() if k in ("numeric", "text") and (columns is None or c in columns)]
    holes = [c for c in clean.columns_with_nulls(df) if c in usable]
    if not holes:
        return df
    num = set(numeric_columns(df))
    classes = {}
    if any(c not in num for c in usable):
        aggs = {c: F.approx_count_distinct(col(c)) for c in usable if c not in num}
        row = df.agg(*[a.alias(c) for c, a in aggs.items()]).first()
        classes = {c: row[c] for c in aggs}
    # Text with more classes than a tree takes is a feature by how often its value occurs.
    wide = [c for c in usable if c not in num and classes[c] > MAX_CLASSES]
    work = df.withColumns({f"__m_{c}": col(c).isNull() for c in holes})
    start = clean.fill(work, {**clean.fill_values(df, initial, [c for c in holes])})
    work = scratch.materialise(start)
    n = work.count() if trees else 0
    cuts = _cuts(df, [c for c in usable if c in num]) if n >= CELLS_FROM else {}
    for _ in range(rounds):
        for c in holes:
            inputs = [f for f in usable if f != c]
            if not inputs:
                continue
            if c in wide:
                work = scratch.materialise(_conditional_mode(work, c, [f for f in inputs if f not in num and f not in wide]))
                continue
            stages: list = []
            cols = []
            for f in inputs:
                if f in num:
                    cols.append(f)
                elif f in wide:
                    work = _with_count(work, f)
                    cols.append(f"__n_{f}")
                else:
                    stages.append(StringIndexer(inputCol=f, outputCol=f"__i_{f}", handleInvalid="keep", stringOrderType="alphabetAsc"))
                    cols.append(f"__i_{f}")
            cells = None
            if n >= CELLS_FROM:
                numbers = [f for f in cols if not f.startswith("__i_")]
                here = {f: cuts[f] if f in num else x for f, x in {**cuts, **_cuts(work, [f for f in numbers if f not in num])}.items() if f in numbers}
                texts = [f for f in inputs if f not in num and f not in wide]
                if set(here) == set(numbers):
                    binned = _binned(work, here)
                    by = [*[f"__b_{f}" for f in numbers], *texts, *([] if c in num else [c])]
                    most = float(np.prod([len(x) + 1 for x in here.values()], dtype=float) * np.prod([classes[f] * 1.2 + 1 for f in [*texts, c] if f in classes], dtype=float))
                    cells = _counted(binned.filter(~F.col(f"__m_{c}")), by, c, c in num, n, most)
            if cells is not None:
                work, cols = binned, [f"__b_{f}" if f in numbers else f for f in cols]
            stages.append(VectorAssembler(inputCols=cols, outputCol="__x", handleInvalid="keep"))
            train = work.filter(~F.col(f"__m_{c}"))
            if c in num and cells is not None:
                model = Pipeline(stages=[*stages, regress("__x", "__y").setWeightCol("__w")]).fit(cells)
                work = model.transform(work).withColumn(c, F.when(F.col(f"__m_{c}"), F.col("prediction")).otherwise(number(c)))
            elif c in num:
                train = train.withColumn("__y", number(c))
                model = Pipeline(stages=[*stages, regress("__x", "__y")]).fit(train)
                work = model.transform(work).withColumn(c, F.when(F.col(f"__m_{c}"), F.col("prediction")).otherwise(number(c)))
            else:
                known = train if cells is None else cells
                indexer = StringIndexer(inputCol=c, outputCol="__y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(known)
                labels = indexer.labels
                if cells is None:
                    predict = Pipeline(stages=[*stages, classify("__x", "__y")]).fit(indexer.transform(train)).transform
                else:
                    predict = _forest(indexer.transform(cells), stages, classify)
                names = F.array(*[F.lit(v) for v in labels])
                at = F.least(F.col("prediction").cast("int"), F.lit(len(labels) - 1))
                work = predict(work).withColumn(c, F.when(F.col(f"__m_{c}"), F.get(names, at)).otherwise(col(c)))
            work = scratch.materialise(work.select(*[col(x) for x in df.columns], *[f"__m_{x}" for x in holes]))
    return work.select(*[col(x) for x in df.columns])


def impute_mice(df: DataFrame, columns: Sequence[str] | None = None, rounds: int = 3) -> DataFrame:
    return _iterate(
        df,
        columns,
        lambda x, y: LinearRegression(featuresCol=x, labelCol=y, solver="normal", regParam=1e-6),
        lambda x, y: LogisticRegression(featuresCol=x, labelCol=y, maxIter=20),
        rounds,
    )


def impute_missforest(df: DataFrame, columns: Sequence[str] | None = None, rounds: int = 2, trees: int = 20, seed: int = 42) -> DataFrame:
    return _iterate(
        df,
        columns,
        lambda x, y: RandomForestRegressor(featuresCol=x, labelCol=y, numTrees=trees, seed=seed, maxBins=128),
        lambda x, y: RandomForestClassifier(featuresCol=x, labelCol=y, numTrees=trees, seed=seed, maxBins=128),
        rounds,
    )


def impute_gbt(df: DataFrame, columns: Sequence[str] | None = None, trees: int = 20, seed: int = 42) -> DataFrame:
    """Gradient boosting per column; text with more than two values uses a forest."""

    def classify(x: str, y: str):
        return RandomForestClassifier(featuresCol=x, labelCol=y, numTrees=trees, seed=seed, maxBins=128)

    return _iterate(df, columns, lambda x, y: GBTRegressor(featuresCol=x, labelCol=y, maxIter=trees, seed=seed, maxBins=BINS), classify, 1, trees=True)


METHODS: dict[str, Callable[..., DataFrame]] = {
    "mean": lambda df, **k: impute.impute_simple(df, "mean"),
    "median": lambda df, **k: impute.impute_simple(df, "median"),
    "mode": lambda df, **k: impute.impute_simple(df, "mode"),
    "min": lambda df, **k: impute.impute_simple(df, "min"),
    "max": lambda df, **k: impute.impute_simple(df, "max"),
    "zero": lambda df, **k: impute.impute_simple(df, "zero"),
    "constant": lambda df, value=0, **k: impute.impute_constant(df, value),
    "drop": lambda df, **k: impute.impute_drop(df),
    "ffill": lambda df, order=(), **k: impute.impute_ffill(df, order),
    "bfill": lambda df, order=(), **k: impute.impute_bfill(df, order),
    "interpolate": lambda df, order=(), **k: impute.impute_interpolate(df, order),
    "timeseries": lambda df, time=None, tie=(), **k: impute.impute_timeseries(df, time, tie=tie),
    "group": lambda df, group=None, **k: impute.impute_group(df, group),
    "random": lambda df, key=(), **k: impute.impute_random(df, list(clean.columns_with_nulls(df)), key),
    "knn": lambda df, key=(), **k: impute_knn(df, key[0]),
    "mice": lambda df, **k: impute_mice(df),
    "missforest": lambda df, **k: impute_missforest(df),
    "gbt": lambda df, **k: impute_gbt(df),
}
NOT_BUILT = {"autoencoder", "attention", "diffusion", "language_model", "image", "multimodal"}


def impute_by_name(df: DataFrame, strategy: str, **options) -> DataFrame:
    """Run one imputer by name (see ``METHODS``); ``smart`` chooses one."""
    if strategy == "smart":
        strategy = impute.choose_imputer(df)
        if strategy == "timeseries":
            times = [c for c, k in kinds(df).items() if k == "datetime"]
            if times and not options.get("time"):
                options["time"] = times[0]
            elif not options.get("time"):
                strategy = "median"
    if strategy == "ensemble":
        return impute_ensemble(df, options["key"][0])
    if strategy not in METHODS:
        raise ValueError(f"imputer not available: {strategy}")
    return METHODS[strategy](df, **options)


def impute_smart(df: DataFrame, **options) -> DataFrame:
    return impute_by_name(df, "smart", **options)


def impute_ensemble(df: DataFrame, key: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted mean of several imputers for numbers, weighted vote for text."""
    df = nan_to_null(df)
    weights = dict(weights or {"mean": 1.0, "median": 1.0, "mice": 2.0})
    holes = list(clean.columns_with_nulls(df))
    num = set(numeric_columns(df))
    out = df
    for m in weights:
        part = impute_by_name(df, m, key=[key]).select(col(key), *[col(c).alias(f"{c}__{m}") for c in holes])
        out = out.join(part, key)
    total = sum(weights.values())
    made: dict[str, Column] = {}
    for c in holes:
        if c in num:
            terms = [number(f"{c}__{m}") * (w / total) for m, w in weights.items()]
            made[c] = F.coalesce(number(c), sum(terms[1:], terms[0]))
        else:
            votes = F.array(*[F.struct(col(f"{c}__{m}").alias("v"), F.lit(float(w)).alias("w")) for m, w in weights.items()])
            score = lambda x: F.aggregate(F.filter(votes, lambda y: y["v"] == x["v"]), F.lit(0.0), lambda a, y: a + y["w"])  # noqa: B023, E731
            ranked = F.transform(votes, lambda x: F.struct((-score(x)).alias("s"), x["v"].alias("v")))
            made[c] = F.coalesce(col(c), F.array_min(ranked)["v"])
    return out.withColumns(made).select(*[col(c) for c in df.columns])


# ---- comparing imputers ----


def evaluate_imputer(df: DataFrame, strategy: str, key: str, columns: Sequence[str] | None = None, share: float = 0.1, trials: int = 2, seed: int = 42, **options) -> DataFrame:
    """(strategy, trial, column, n, rmse, mae): hide a hashed share of the complete
    rows' cells, impute, and compare with what was hidden."""
    df = nan_to_null(df)
    names = [c for c in (columns or numeric_columns(df)) if c != key]
    full = df.na.drop("any", subset=names).select(col(key), *[col(c) for c in names])
    parts = []
    for t in range(trials):
        hide = lambda c: F.pmod(F.xxhash64(F.lit(seed + t), F.lit(c), col(key)), F.lit(10_000)) < int(share * 10_000)  # noqa: B023, E731
        holed = full.select(col(key), *[F.when(~hide(c), col(c)).alias(c) for c in names])
        done = impute_by_name(holed, strategy, key=[key], **options).select(col(key), *[number(c).alias(f"__{c}") for c in names])
        both = full.join(done, key)
        cells = F.array(
            *[F.struct(F.lit(c).alias("column"), F.when(hide(c), number(c) - F.col(f"__{c}")).alias("e")) for c in names]
        )
        err = both.select(F.inline(cells)).filter("e is not null").groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae")
        )
        parts.append(err.select(F.lit(strategy).alias("strategy"), F.lit(t).alias("trial"), "column", "n", "rmse", "mae"))
    return union_all(parts)


def compare_imputers(df: DataFrame, key: str, strategies: Sequence[str] = ("mean", "median", "mode"), columns: Sequence[str] | None = None, trials: int = 2, **options) -> DataFrame:
    """Average RMSE and MAE per imputer, best first."""
    runs = union_all([evaluate_imputer(df, s, key, columns, trials=trials, **options) for s in strategies])
    return runs.groupBy("strategy").agg(F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae")).orderBy("rmse", "strategy")


def available(spark) -> DataFrame:
    return frame(spark, [(m, True) for m in [*METHODS, "smart", "ensemble"]] + [(m, False) for m in sorted(NOT_BUILT)], "strategy string, built boolean")
