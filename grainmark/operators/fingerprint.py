"""Table fingerprints: compute, store, compare, recommend, follow over time."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..functions.columns import (
    col,
    corr,
    count_if,
    frame,
    kinds,
    nan_to_null,
    number,
    numeric_columns,
    of_kind,
    one_row,
    text_columns,
)
from . import advise, impute, profile, relate

FINGERPRINT = (
    "source string, fingerprint string, created_at timestamp, columns array<string>, entropy array<double>, "
    "moments array<array<double>>, correlation_hash string, mutual_information array<double>, schema_hash string, "
    "missing_mechanism string, missing_pattern_hash string, cardinality array<long>, outlier_density double, "
    "duplicate_ratio double, n_rows long, n_columns int, redundancy double, target string, task string, "
    "class_balance double, separability double, has_temporal boolean, temporal_columns array<string>, ml_score long"
)


def mutual_information(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, bits) of every pair of text columns, from joint counts."""
    cells = relate.contingency(df, columns)
    key = ["col_a", "col_b"]
    tot = cells.groupBy(*key).agg(F.sum("n").alias("t"))
    ra = cells.groupBy(*key, "a").agg(F.sum("n").alias("ra"))
    rb = cells.groupBy(*key, "b").agg(F.sum("n").alias("rb"))
    n, t = F.col("n").cast("double"), F.col("t")
    bits = n / t * F.log2(n * t / (F.col("ra").cast("double") * F.col("rb")))
    return cells.join(ra, [*key, "a"]).join(rb, [*key, "b"]).join(tot, key).groupBy(*key).agg(F.sum(bits).alias("bits"))


def fingerprint(df: DataFrame, source: str, target: str | None = None, created_at: str | None = None) -> DataFrame:
    """One row; every field is measured on the whole table."""
    df = nan_to_null(df)
    spark = df.sparkSession
    num, text = numeric_columns(df), text_columns(df)
    facts = {r["column"]: r for r in values.value_summary(df).collect()}  # one row per column
    n = next(iter(facts.values()))["n_rows"] if facts else 0
    aggs: dict[str, Column] = {}
    for c in num:
        for k, f in (("m", F.avg), ("s", F.stddev_samp), ("g", F.skewness), ("k", F.kurtosis)):
            aggs[f"{k}|{c}"] = f(number(c))
    for a, b in combinations(num, 2):
        aggs[f"r|{a}|{b}"] = corr(number(a), number(b))
    got = one_row(df, aggs) if aggs else {}
    pairs = [(a, b, got[f"r|{a}|{b}"]) for a, b in combinations(num, 2)]
    known = [abs(r) for *_, r in pairs if r is not None]
    mi = {(r["col_a"], r["col_b"]): r["bits"] for r in mutual_information(df, text).collect()} if len(text) > 1 else {}
    lim = profile.fences(df) if num else {}
    n_out = one_row(df, {c: count_if((number(c) < lo) | (number(c) > hi)) for c, (lo, hi, _) in lim.items()}) if lim else {}
    dup = profile.duplicate_rows(df).first()[0]
    if target is None:
        target = advise.detect_target(df).first()["recommended"]
    task = "classification" if facts[target]["n_distinct"] <= 20 or target in text else "regression"
    tf = facts[target]
    balance = tf["least_n"] / tf["top_n"] if task == "classification" and tf["top_n"] else 1.0
    strongest = [abs(r) for a, b, r in pairs if target in (a, b) and r is not None]
    times = of_kind(df, "datetime")
    score = advise.readiness_grade(advise.ml_readiness(df)).first()["score"]
    holes = ",".join(f"{c}:{facts[c]['n_missing'] * 20 // max(n, 1)}" for c in df.columns)
    corr_text = ",".join(f"{a}~{b}:{0.0 if r is None else round(r, 1) + 0.0:.1f}" for a, b, r in pairs)
    schema_text = ",".join(f"{f.name}:{kinds(df)[f.name]}" for f in df.schema.fields)
    mech = impute.missing_mechanism(df).first()["mechanism"]
    row = (
        source,
        list(df.columns),
        [float(facts[c]["entropy"] or 0.0) for c in df.columns],
        [[None if got[f"{k}|{c}"] is None else float(got[f"{k}|{c}"]) for k in "msgk"] for c in num],
        corr_text,
        [float(mi.get(p, 0.0)) for p in combinations(text, 2)],
        schema_text,
        mech,
        holes,
        [int(facts[c]["n_distinct"]) for c in df.columns],
        sum(n_out.values()) / max(n * max(len(num), 1), 1),
        dup / max(n, 1),
        n,
        len(df.columns),
        sum(r > 0.8 for r in known) / len(known) if known else 0.0,
        target,
        task,
        float(balance),
        max(strongest, default=0.0),
        bool(times),
        times,
        int(score),
    )
    raw = frame(
        spark,
        [row],
        "source string, columns array<string>, entropy array<double>, moments array<array<double>>, corr_text string, "
        "mutual_information array<double>, schema_text string, missing_mechanism string, holes string, cardinality array<long>, "
        "outlier_density double, duplicate_ratio double, n_rows long, n_columns int, redundancy double, target string, task string, "
        "class_balance double, separability double, has_temporal boolean, temporal_columns array<string>, ml_score long",
    )
    when = F.lit(created_at).cast("timestamp") if created_at else F.current_timestamp()
    out = (
        raw.withColumn("created_at", when)
        .withColumn("correlation_hash", F.sha2("corr_text", 256))
        .withColumn("schema_hash", F.sha2("schema_text", 256))
        .withColumn("missing_pattern_hash", F.sha2("holes", 256))
        .withColumn(
            "fingerprint",
            F.sha2(
                F.concat_ws("|", "schema_hash", "correlation_hash", "missing_pattern_hash", "n_rows", F.array_join(F.col("cardinality").cast("array<string>"), ",")),
                256,
            ),
        )
    )
    names = [p.split()[0] for p in FINGERPRINT.split(", ")]
    return out.select(*names)


def entropies(df: DataFrame) -> DataFrame:
    """(column, entropy, n_distinct): the part of the fingerprint that SQL can state."""
    return values.value_summary(nan_to_null(df)).select("column", "entropy", "n_distinct")


def _similar(a: str, b: str) -> Column:
    s = F.when(F.col(f"{a}.correlation_hash") == F.col(f"{b}.correlation_hash"), 1.0).otherwise(0.5)
    t = F.when(F.col(f"{a}.schema_hash") == F.col(f"{b}.schema_hash"), 1.0).otherwise(0.7)
    return (s + t) / 2


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """(statistical, structural, similarity, differences, verdict) of two fingerprints."""
    both = a.alias("a").crossJoin(b.alias("b"))  # one row each
    sim = _similar("a", "b")
    diffs = F.array_compact(
        F.array(
            F.when(F.col("a.schema_hash") != F.col("b.schema_hash"), "schema"),
            F.when(F.col("a.task") != F.col("b.task"), "task"),
        )
    )
    return both.select(
        F.when(F.col("a.correlation_hash") == F.col("b.correlation_hash"), 1.0).otherwise(0.5).alias("statistical"),
        F.when(F.col("a.schema_hash") == F.col("b.schema_hash"), 1.0).otherwise(0.7).alias("structural"),
        sim.alias("similarity"),
        F.array_join(diffs, ",").alias("differences"),
        F.when(sim > 0.8, "similar").otherwise("drifted").alias("verdict"),
    )


def find_similar(store: DataFrame, probe: DataFrame, k: int | None = 5, min_similarity: float = 0.5, task: str | None = None) -> DataFrame:
    """The ``k`` stored fingerprints most like a probe (None: all that are alike enough), the probe itself left out."""
    one = probe.limit(1)
    pool = store if task is None else store.filter(F.col("task") == task)
    both = pool.alias("s").join(F.broadcast(one).alias("p"), F.col("s.fingerprint") != F.col("p.fingerprint"))
    out = both.select(F.col("s.fingerprint"), F.col("s.source"), F.col("s.task"), _similar("s", "p").alias("similarity"))
    out = out.filter(F.col("similarity") >= min_similarity)
    return out if k is None else out.orderBy(F.desc("similarity"), "fingerprint").limit(k)


def collapse(store: DataFrame, counted: str | None = None) -> DataFrame:
    """First sighting per fingerprint, with the best score seen; ``counted`` names a column for the number of sightings."""
    rest = [c for c in store.columns if c not in ("fingerprint", "ml_score")]
    g = store.groupBy("fingerprint").agg(
        F.min_by(F.struct(*rest), "created_at").alias("__r"), F.max("ml_score").alias("ml_score"), F.count(F.lit(1)).alias("__n")
    )
    n = [F.col("__n").alias(counted)] if counted else []
    return g.select(*[F.col("__r")[c].alias(c) if c in rest else F.col(c) for c in store.columns], *n)


def save(fp: DataFrame, path: str) -> None:
    fp.write.mode("append").parquet(path)


# ---- what worked before ----


def outcome(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 65, "good").otherwise("poor")


def recommend(similar: DataFrame, records: DataFrame) -> DataFrame:
    """Best past strategy: (strategy, weight, confidence, n_used, parameters).

    ``records`` holds (fingerprint, strategy, parameters, ml_score); every use
    weighs score/100 times similarity, poor outcomes do not count.
    """
    good = records.withColumn("outcome", outcome(F.col("ml_score"))).filter("outcome != 'poor'")
    used = good.join(similar.select("fingerprint", "similarity"), "fingerprint")
    w = F.col("ml_score") / 100.0 * F.col("similarity")
    per = used.groupBy("strategy").agg(
        F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n_used"), F.max_by("parameters", "ml_score").alias("parameters")
    )
    total = per.agg(F.sum("weight").alias("t"))
    return (
        per.crossJoin(F.broadcast(total))  # one row
        .withColumn("confidence", F.round(F.col("weight") / F.nullif(F.col("t"), F.lit(0.0)), 3))
        .drop("t")
        .orderBy(F.desc("weight"), "strategy")
        .limit(1)
    )


def strategy_rules(fp: DataFrame) -> DataFrame:
    """Preparation settings that follow from each fingerprint."""
    mech = F.col("missing_mechanism")
    return fp.select(
        "source",
        F.when(mech.isin("NONE", "MCAR"), "mean").when(mech == "MAR", "median").otherwise("mode").alias("missing_strategy"),
        (F.col("duplicate_ratio") > 0).alias("remove_duplicates"),
        (F.col("redundancy") < 0.8).alias("scale"),
        F.lit(True).alias("encode"),
        ((F.col("task") == "classification") & (F.col("class_balance") < 0.7)).alias("handle_imbalance"),
        (F.col("outlier_density") > 0.05).alias("treat_outliers"),
        (F.col("has_temporal") | (F.col("n_columns") < 10)).alias("feature_engineering"),
    )


def select_strategy(fp: DataFrame, learned: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """The rules, overridden by what was learned when that is confident enough."""
    rules = strategy_rules(fp)
    best = learned.select(F.col("strategy").alias("learned"), F.col("confidence").alias("__c"), "parameters")
    out = rules.join(F.broadcast(best), F.lit(True), "left")  # at most one learned row
    sure = F.coalesce(F.col("__c") >= min_confidence, F.lit(False))
    return out.select(
        *[c for c in rules.columns if c != "missing_strategy"],
        F.when(sure, F.col("learned")).otherwise(F.col("missing_strategy")).alias("missing_strategy"),
        F.when(sure, "learned").otherwise("rules").alias("decided_by"),
        F.when(sure, F.col("__c")).otherwise(0.5).alias("confidence"),
    )


def evolution(store: DataFrame) -> DataFrame:
    """Every version of every source beside the one before it."""
    w = Window.partitionBy("source").orderBy("created_at")
    prev = lambda c: F.lag(c).over(w)
    base = store.select(
        "source",
        "created_at",
        "fingerprint",
        "schema_hash",
        "correlation_hash",
        "task",
        "separability",
        F.row_number().over(w).alias("version"),
        *[prev(c).alias(f"prev_{c}") for c in ("fingerprint", "schema_hash", "correlation_hash", "task", "separability")],
    )
    sim = (
        F.when(F.col("correlation_hash") == F.col("prev_correlation_hash"), 1.0).otherwise(0.5)
        + F.when(F.col("schema_hash") == F.col("prev_schema_hash"), 1.0).otherwise(0.7)
    ) / 2
    first = F.col("prev_fingerprint").isNull()
    same = F.col("fingerprint") == F.col("prev_fingerprint")
    trend = (
        F.when(first, "new")
        .when(same | (sim >= 0.95), "stable")
        .when(sim >= 0.75, "minor_drift")
        .when(sim >= 0.5, "moderate_drift")
        .otherwise("major_drift")
    )
    step = F.col("separability") - F.col("prev_separability")
    return base.select(
        "source",
        "version",
        "fingerprint",
        F.when(~first, sim).alias("similarity"),
        trend.alias("trend"),
        F.when(step > 0.1, "improving").when(step < -0.1, "degrading").when(~first, "stable").alias("ml_trend"),
    )
