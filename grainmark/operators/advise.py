"""Advice before training: readiness, target, split, imbalance, findings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.columns import (
    col,
    count_if,
    frame,
    kinds,
    nan_to_null,
    numeric_columns,
    text_columns,
)
from . import privacy, profile, relate

# Words in column names and their meaning.
CLASS_HINTS = [
    "target", "label", "class", "category", "type", "status",
    "output", "result", "y", "flag", "churn", "fraud", "spam",
    "survived", "approved", "diagnosis", "outcome",
]
REGRESSION_HINTS = [
    "price", "cost", "salary", "revenue", "sales", "amount",
    "value", "score", "rate", "total", "count", "quantity",
    "age", "weight", "height", "duration", "distance",
]
TIME_HINTS = ["date", "time", "year", "month", "day", "timestamp"]
ID_HINTS = ["id", "uuid", "key", "token"]
LEAK_HINTS = ["result", "outcome", "label", "target", "status_final", "approved"]


def _has(name: str, hints: Sequence[str]) -> bool:
    return any(h in name.lower() for h in hints)


def _facts(df: DataFrame) -> dict[str, dict]:
    rows = values.value_summary(df).select("column", "n_rows", "n_missing", "n_distinct").collect()
    return {r["column"]: r.asDict() for r in rows}  # one row per column


@dataclass
class Measured:
    """What several kinds of advice rest on: facts of each column, columns with outliers, duplicate rows."""

    facts: dict[str, dict]
    n_out: int
    n_duplicates: int


def measured(df: DataFrame, k: float = 1.5) -> Measured:
    """Value counts are written once; facts and fences are read off them."""
    df = nan_to_null(df)
    counts = values.written_counts(df)
    rows = values.value_summary(df, counts=counts).select("column", "n_rows", "n_missing", "n_distinct").collect()  # one row per column
    n_out = profile._outlying(df, counts, k).count() if numeric_columns(df) else 0
    return Measured({r["column"]: r.asDict() for r in rows}, n_out, profile.duplicate_rows(df).first()[0])


def ml_readiness(df: DataFrame, k: float = 1.5, known: Measured | None = None) -> DataFrame:
    """(check, status, points, max_points, measured): six checks worth 100 points. ``known`` is ``measured(df, k)``, if at hand."""
    df = nan_to_null(df)
    spark = df.sparkSession
    known = known or measured(df, k)
    facts, n_out = known.facts, known.n_out
    n = next(iter(facts.values()))["n_rows"] if facts else 0
    num, text = numeric_columns(df), text_columns(df)
    missing = 100 * sum(f["n_missing"] for f in facts.values()) / max(n * len(df.columns), 1)
    dup = 100 * known.n_duplicates / max(n, 1)
    useless = sum(
        1 for c, f in facts.items() if f["n_distinct"] <= 1 or (f["n_distinct"] == n and c not in num)
    )

    def graded(value: float, steps: Sequence[tuple[float, float, str]], otherwise: tuple[float, str]):
        for limit, share, status in steps:
            if value <= limit:
                return share, status
        return otherwise

    share_out = n_out / len(num) if num else (1.0 if n_out else 0.0)
    table = [
        ("size", 20, float(n), graded(-n, [(-1000, 1, "pass"), (-200, 0.7, "warn"), (-50, 0.4, "warn")], (0, "fail"))),
        ("missing", 25, missing, graded(missing, [(0, 1, "pass"), (5, 0.85, "pass"), (15, 0.6, "warn"), (30, 0.3, "warn")], (0, "fail"))),
        ("outliers", 15, float(n_out), graded(share_out, [(0, 1, "pass"), (0.25, 0.7, "warn"), (0.5, 0.4, "warn")], (0.1, "fail"))),
        ("duplicates", 10, dup, graded(dup, [(0, 1, "pass"), (5, 0.7, "warn")], (0, "fail"))),
        ("useless", 15, float(useless), graded(useless, [(0, 1, "pass"), (1, 0.5, "warn")], (0, "fail"))),
        (
            "types",
            15,
            float(len(text)),
            (1, "pass") if not text and not num else graded(len(text), [(0, 0.8, "pass"), (2, 0.6, "warn")], (0.3, "warn")),
        ),
    ]
    rows = [(name, status, int(top * share), top, float(v)) for name, top, v, (share, status) in table]
    return frame(spark, rows, "check string, status string, points int, max_points int, measured double")


def readiness_grade(checks: DataFrame) -> DataFrame:
    s = F.col("score")
    grade = F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("F")
    return checks.agg(
        F.sum("points").alias("score"),
        count_if(F.col("status") == "fail").alias("n_fail"),
        count_if(F.col("status") == "warn").alias("n_warn"),
    ).withColumn("grade", grade)


def target_scores(df: DataFrame) -> DataFrame:
    """(column, score, n_distinct, task) for every column, best first.

    The points come from position, name, cardinality and missing share, so one
    exchange of value counts is all the data work.
    """
    df = nan_to_null(df)
    facts, num = _facts(df), set(numeric_columns(df))
    names = df.columns
    rows = []
    for i, c in enumerate(names):
        f = facts[c]
        n, d = max(f["n_rows"], 1), f["n_distinct"]
        is_num = c in num
        s = 30 if i == len(names) - 1 else -20 if i == 0 else 0
        s += 40 * _has(c, CLASS_HINTS) + 35 * _has(c, REGRESSION_HINTS)
        s += 35 * (d == 2)
        if d <= 10:
            s += 25
        elif d / n >= 0.95:
            s -= 15 if is_num else 30
        s += 15 * (is_num and d > 20)
        s -= 20 * (f["n_missing"] / n > 0.1)
        if d <= 10:
            task = "classification"
        elif _has(c, REGRESSION_HINTS):
            task = "regression"
        elif _has(c, CLASS_HINTS):
            task = "classification"
        else:
            task = "regression" if is_num and d > 20 else "unknown"
        rows.append((c, s, d, task, i))
    rows.sort(key=lambda r: (-r[1], r[4]))
    return frame(df.sparkSession, [r[:4] for r in rows], "column string, score int, n_distinct long, task string")


def detect_target(df: DataFrame) -> DataFrame:
    """One row: recommended column, task, confidence, score."""
    best = target_scores(df).limit(2).collect()
    top = best[0]
    gap = top["score"] - (best[1]["score"] if len(best) > 1 else 0)
    conf = (
        "high" if gap >= 30 or top["score"] >= 60 else "medium" if gap >= 15 or top["score"] >= 35 else "low"
    )
    return frame(
        df.sparkSession,
        [(top["column"], top["task"], conf, top["score"])],
        "recommended string, task string, confidence string, score int",
    )


def detect_task(df: DataFrame, target: str, max_classes: int = 20) -> str:
    """binary, multiclass or regression."""
    y = nan_to_null(df).select(col(target))
    kind = kinds(y)[target]
    d = y.agg(F.count_distinct(col(target))).first()[0]
    if d == 2:
        return "binary"
    if kind in ("text", "boolean") or d <= max_classes:
        return "multiclass"
    return "regression"


def _classes(df: DataFrame, target: str) -> DataFrame:
    return (
        nan_to_null(df)
        .filter(col(target).isNotNull())
        .groupBy(col(target).cast("string").alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def advise_split(df: DataFrame, target: str, task: str = "auto") -> DataFrame:
    """One row: task, test share, folds, stratify, time columns."""
    df = nan_to_null(df)
    per = _classes(df, target).agg(F.count(F.lit(1)).alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    n = df.count()
    if task == "auto":
        task = "classification" if kinds(df)[target] == "text" or per["d"] <= 20 else "regression"
    size, folds = 0.1, 5
    for limit, s, f in ((50, 0.2, 3), (200, 0.2, 5), (1000, 0.2, 5), (10_000, 0.15, 5)):
        if n < limit:
            size, folds = s, f
            break
    stratify = False
    if task == "classification" and per["lo"]:
        stratify = per["hi"] / per["lo"] > 3
        if per["lo"] < folds:
            folds = max(2, int(per["lo"]))
    times = [c for c in df.columns if _has(c, TIME_HINTS)]
    strategy = "time" if times else "stratified" if stratify else "random"
    return frame(
        df.sparkSession,
        [(task, strategy, size, folds, stratify, ",".join(times))],
        "task string, strategy string, test_size double, cv_folds int, stratify boolean, time_columns string",
    )


# ---- applying a split ----


def _hash_order(key: Sequence[str], seed: int) -> Column:
    """A repeatable shuffle: SHA-256 of seed and row key (any engine can redo it)."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in key]), 256)


def _hash_unit(key: Sequence[str], seed: int) -> Column:
    """The first 52 bits of the hash as a number in [0, 1): decided row by row."""
    return F.conv(F.substring(_hash_order(key, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def split_random(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``; each row decides alone, so no exchange is needed."""
    return df.withColumn("is_test", _hash_unit(key, seed) < test_size)


def split_stratified(df: DataFrame, target: str, key: Sequence[str], test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Exactly round(test_size · n_c) test rows in every class.

    The hash cut of each class is found from counts of hash prefixes, so a
    class of any size is never sorted in one task.
    """
    h = df.withColumn("__h", _hash_order(key, seed))
    placed = values.with_position(h, [target, "__h"], "__p")
    sizes = placed.groupBy(col(target).alias("__c")).agg(F.min("__p").alias("__first"), F.count(F.lit(1)).alias("__n"))
    joined = placed.join(sizes, col(target).eqNullSafe(F.col("__c")))
    test = (F.col("__p") - F.col("__first")) < F.round(F.col("__n") * F.lit(test_size))
    return joined.withColumn("is_test", test).select(*[col(c) for c in df.columns], "is_test")


def split_by_time(df: DataFrame, time: str, test_size: float = 0.2, tie: Sequence[str] = ()) -> DataFrame:
    """The latest ``test_size`` share of rows is the test part."""
    placed = values.with_position(df, [time, *tie], "__p")
    n = placed.count()
    return placed.withColumn("is_test", F.col("__p") >= F.lit(n - round(n * test_size))).drop("__p")


def k_folds(df: DataFrame, key: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.floor(_hash_unit(key, seed) * folds).cast("int"))


def stratified_folds(df: DataFrame, target: str, key: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Folds that keep class shares: positions within a class are dealt in turn."""
    h = df.withColumn("__h", _hash_order(key, seed))
    placed = values.with_position(h, [target, "__h"], "__p")
    return placed.withColumn("fold", F.pmod("__p", F.lit(folds)).cast("int")).drop("__p", "__h")


def time_folds(df: DataFrame, time: str, folds: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """Consecutive equal blocks in time order: train on earlier folds, test on the next."""
    placed = values.with_position(df, [time, *tie], "__p")
    n = max(placed.count(), 1)
    return placed.withColumn("fold", F.floor(F.col("__p") * folds / F.lit(n)).cast("int")).drop("__p")


# ---- imbalance ----


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    per = _classes(df, target)
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).select(  # the total is one row
        "class", "n", F.round(F.col("n") * 100.0 / F.col("t"), 2).alias("pct")
    )


def detect_imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: ratio, severity and the recommended strategy."""
    agg = _classes(df, target).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.sum("n").alias("n_rows"),
        F.min("n").alias("minority"),
        F.max("n").alias("majority"),
    )
    r = F.col("ratio")
    severity = (
        F.when(r < 1.5, "none").when(r < 3, "mild").when(r < 10, "moderate").when(r < 100, "severe").otherwise("extreme")
    )
    advice = (
        F.when(r < 1.5, "none")
        .when(F.col("minority") < 6, "class_weights")
        .when(r >= 10, "smote_tomek")
        .when(r >= 3, "smote")
        .otherwise("class_weights")
    )
    warn = F.array_join(
        F.array_compact(
            F.array(
                F.when(r >= 1.5, "imbalanced"),
                F.when(F.col("minority") < 10, "tiny_minority"),
                F.when(F.col("n_rows") < 100, "small_table"),
            )
        ),
        ",",
    )
    return (
        agg.withColumn("ratio", F.round(F.col("majority") / F.col("minority"), 2))
        .withColumn("severity", severity)
        .withColumn("recommended", advice)
        .withColumn("warnings", warn)
    )


def imbalance_strategies(df: DataFrame, target: str) -> DataFrame:
    """(strategy, recommended) that the class sizes allow."""
    r = detect_imbalance(df, target).first()
    ratio, low, n = r["ratio"], r["minority"], r["n_rows"]
    rows = []
    if low >= 6:
        rows += [("smote", ratio >= 3), ("adasyn", ratio >= 5), ("smote_tomek", ratio >= 10)]
    rows += [("class_weights", ratio < 10 or low < 6), ("under_sampling", n > 1000 and ratio < 20)]
    return frame(df.sparkSession, rows, "strategy string, recommended boolean")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    per = _classes(df, target)
    total = per.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return per.crossJoin(F.broadcast(total)).select(  # the total is one row
        "class", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight")
    )


def with_class_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    w = class_weights(df, target).select(F.col("class").alias("__c"), F.col("weight").alias(name))
    return df.join(w, col(target).cast("string") == F.col("__c")).drop("__c")


def under_sample(df: DataFrame, target: str, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest, chosen by hash order."""
    h = nan_to_null(df).filter(col(target).isNotNull()).withColumn("__h", _hash_order(key, seed))
    placed = values.with_position(h, [target, "__h"], "__p")
    sizes = placed.groupBy(col(target).alias("__c")).agg(F.min("__p").alias("__first"), F.count(F.lit(1)).alias("__n"))
    low = sizes.agg(F.min("__n")).first()[0]
    joined = placed.join(sizes, col(target) == F.col("__c"))
    return joined.filter((F.col("__p") - F.col("__first")) < F.lit(low)).select(*[col(c) for c in df.columns])


# ---- findings ----


def _is_id(column: str, f: dict) -> bool:
    """``id_columns`` from a column's facts."""
    return _has(column, ID_HINTS) and (f["n_distinct"] + (f["n_missing"] > 0)) / f["n_rows"] >= 0.98


def _is_wide(f: dict) -> bool:
    """``high_cardinality_text`` from a column's facts."""
    return f["n_distinct"] / f["n_rows"] >= 0.4 and f["n_distinct"] > 30


def id_columns(df: DataFrame) -> DataFrame:
    """Columns that are at least 98 % unique and named like an identifier."""
    s = values.value_summary(nan_to_null(df))
    named = [c for c in df.columns if _has(c, ID_HINTS)]
    d = F.col("n_distinct") + F.when(F.col("n_missing") > 0, 1).otherwise(0)
    return s.filter(F.col("column").isin(named) & (d / F.col("n_rows") >= 0.98)).select("column")


def high_cardinality_text(df: DataFrame) -> DataFrame:
    texts = text_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long")
    s = values.value_summary(nan_to_null(df), texts)
    big = (F.col("n_distinct") / F.col("n_rows") >= 0.4) & (F.col("n_distinct") > 30)
    return s.filter(big).select("column", "n_distinct")


def leakage_hints(df: DataFrame) -> DataFrame:
    """(column, reason): identifiers and names that tell the outcome."""
    ids = id_columns(df).select("column", F.lit("identifier").alias("reason"))
    names = [(c, "outcome_name") for c in df.columns if _has(c, LEAK_HINTS)]
    return ids.unionByName(frame(df.sparkSession, names, "column string, reason string"))


def analyst_report(df: DataFrame, risk_profile: str = "balanced") -> DataFrame:
    """Ranked findings: (rank, severity, finding, confidence, measured, action)."""
    df = nan_to_null(df)
    known = measured(df)
    facts, dups, n_out = known.facts, known.n_duplicates, known.n_out
    n = next(iter(facts.values()))["n_rows"] if facts else 0
    p = len(df.columns)
    gaps = sum(f["n_missing"] for f in facts.values())
    pii = privacy.privacy_report(df).first()
    ids = [c for c, f in facts.items() if _is_id(c, f)]
    texts = [c for c in text_columns(df) if c in facts and _is_wide(facts[c])]
    leaks = len(ids) + sum(_has(c, LEAK_HINTS) for c in df.columns)
    score = readiness_grade(ml_readiness(df, known=known)).first()["score"]
    rels = relate.detect_relationships(df, 0.5).count()
    out: list[tuple] = []

    def add(when: bool, severity: str, finding: str, confidence: int, measured: float, action: str) -> None:
        if when:
            out.append((severity, finding, confidence, float(measured), action))

    pct = 100.0 * gaps / max(n * p, 1)
    add(n < 50, "high", "very small table", 94, n, "collect more rows")
    add(50 <= n < 300, "medium", "limited rows", 86, n, "validate carefully")
    add(gaps > 0, "high" if pct > 15 else "medium", "missing cells", 93, pct, "impute per column and keep a log")
    add(dups > 0, "medium", "duplicate rows", 96, dups, "drop duplicates before splitting")
    add(n_out > 0, "high" if n_out >= max(3, p // 4) else "medium", "outliers", 84, n_out, "cap or scale the affected columns only")
    add(pii["risk_level"] != "low", pii["risk_level"], "personal data", 89, pii["affected_columns"], "hash or mask before sharing")
    add(bool(ids), "high", "identifier columns", 81, len(ids), "leave identifiers out of the features")
    add(bool(texts), "medium", "high-cardinality text", 78, len(texts), "frequency or target encoding")
    add(leaks > 0, "high", "possible leakage", 72, leaks, "check availability at prediction time")
    add(score < 60, "high", "low readiness", 90, score, "fix the failing checks")
    add(60 <= score < 80, "medium", "moderate readiness", 82, score, "fix the warnings")
    add(rels > 0, "low", "related columns", 75, rels, "review related columns")
    add(not out, "low", "healthy table", 70, 0, "none")
    rank = {"high": 0, "medium": 1, "low": 2}
    out.sort(key=lambda r: (rank[r[0]], -r[2]))
    rows = [(i + 1, *r) for i, r in enumerate(out)]
    return frame(
        df.sparkSession,
        rows,
        "rank int, severity string, finding string, confidence int, measured double, action string",
    ).withColumn("risk_profile", F.lit(risk_profile))


def analyst_risk(findings: DataFrame) -> DataFrame:
    c = findings.agg(
        count_if(F.col("severity") == "high").alias("n_high"), count_if(F.col("severity") == "medium").alias("n_medium")
    )
    h, m = F.col("n_high"), F.col("n_medium")
    return c.withColumn(
        "overall_risk", F.when(h >= 2, "high").when((h == 1) | (m >= 2), "medium").otherwise("low")
    )
