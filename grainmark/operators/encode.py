"""Encoding advice and the encoders it recommends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.columns import col, frame, nan_to_null, number, numeric_columns, one_row, text_columns
from .features import label_codes

LOW, MEDIUM, HIGH = 10, 50, 200

# Ordered scales and yes/no word pairs.
ORDINAL_SCALES = [
    ["low", "medium", "high"],
    ["small", "medium", "large", "xlarge"],
    ["none", "low", "medium", "high", "critical"],
    ["never", "rarely", "sometimes", "often", "always"],
    ["very bad", "bad", "neutral", "good", "very good"],
    ["strongly disagree", "disagree", "neutral", "agree", "strongly agree"],
    ["bronze", "silver", "gold", "platinum"],
    ["junior", "mid", "senior", "lead", "principal"],
    ["beginner", "intermediate", "advanced", "expert"],
    ["daily", "weekly", "monthly", "quarterly", "yearly"],
    ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"],
    ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"],
    ["q1", "q2", "q3", "q4"],
    ["xs", "s", "m", "l", "xl", "xxl"],
]
BOOLEAN_PAIRS = [
    ["true", "false"],
    ["yes", "no"],
    ["1", "0"],
    ["y", "n"],
    ["t", "f"],
    ["on", "off"],
]


def _bins(c: Column) -> Column:
    return F.when(c <= LOW, "low").when(c <= MEDIUM, "medium").when(c <= HIGH, "high").otherwise("very_high")


def _known(df: DataFrame, names: Sequence[str], form, words: set[str]) -> dict[str, set[str]]:
    """Which of the ``words`` each column holds in a given form; none for columns that hold anything else.

    One pass, at most ``words`` kept per column and task.
    """
    held = {}
    for i, c in enumerate(names):
        v = form(col(c).cast("string"))
        known = v.isin(sorted(words))
        held[f"w{i}"], held[f"o{i}"] = F.collect_set(F.when(known, v)), F.bool_or(~known)
    got = one_row(df, held) if held else {}
    return {c: set() if got[f"o{i}"] else set(got[f"w{i}"]) for i, c in enumerate(names)}


def encoding_profile(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: distinct, cardinality class, entropy, count ratio,
    boolean-like and ordinal flags, and η² against a numeric target."""
    df = nan_to_null(df)
    names = [c for c in (columns or text_columns(df)) if c != target]
    s = values.value_summary(df, names)
    # Levels of a scale are told apart trimmed and lower-cased, the two of a pair lower-cased.
    levels = _known(df, names, lambda c: F.lower(F.trim(c)), {x for o in ORDINAL_SCALES for x in o})
    raw = _known(df, names, F.lower, {x for p in BOOLEAN_PAIRS for x in p})
    rows = []
    for c in names:
        fit = next((o for o in ORDINAL_SCALES if len(levels[c]) >= 2 and levels[c] <= set(o)), None)
        scale = " < ".join(x for x in fit if x in levels[c]) if fit else None
        is_bool = bool(raw[c]) and any(raw[c] <= set(p) for p in BOOLEAN_PAIRS)
        rows.append((c, is_bool, fit is not None, scale))
    marks = frame(df.sparkSession, rows, "column string, is_boolean boolean, is_ordinal boolean, ordinal_scale string")
    eta = eta_squared(df, names, target) if target and target in numeric_columns(df) else None
    out = s.join(F.broadcast(marks), "column").select(  # one row per column
        "column",
        "n_rows",
        "n_missing",
        "n_distinct",
        _bins(F.col("n_distinct")).alias("cardinality"),
        "entropy",
        F.when(F.col("n_distinct") < 2, 1.0).otherwise(F.col("top_n") / F.col("least_n")).alias("imbalance"),
        "is_boolean",
        "is_ordinal",
        "ordinal_scale",
    )
    if eta is None:
        return out.withColumn("target_corr", F.lit(None).cast("double"))
    return out.join(F.broadcast(eta), "column", "left")


def eta_squared(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Between-group share of the target's variance, all columns in one exchange."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("v")) for c in names])
    rows = df.select(number(target).alias("y"), F.inline(cells)).filter("y is not null and v is not null")
    per = rows.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("w"))
    n, m = F.col("n"), F.col("m")
    tot = per.groupBy("column").agg(
        (F.sum(n * m) / F.sum("n")).alias("mean"), F.sum(n * F.col("w")).alias("within")
    )
    between = per.join(F.broadcast(tot), "column").groupBy("column").agg(  # one row per column
        F.sum(n * (m - F.col("mean")) * (m - F.col("mean"))).alias("b"), F.max("within").alias("within")
    )
    whole = F.col("b") + F.col("within")
    return between.select("column", F.when(whole > 0, F.col("b") / whole).otherwise(0.0).alias("target_corr"))


def advise_encoding(df: DataFrame, target: str | None = None, model_type: str = "tree", columns: Sequence[str] | None = None) -> DataFrame:
    """(column, strategy, risk, warnings) from the encoding profile."""
    p = encoding_profile(df, target, columns)
    n = F.col("n_distinct")
    tree = model_type in ("tree", "boosting")
    strategy = (
        F.when(F.col("is_boolean"), "binary")
        .when(F.col("is_ordinal"), "ordinal")
        .when(n <= LOW, "one_hot")
        .when(n <= MEDIUM, "label" if tree else "binary_code")
        .when(n <= HIGH, F.when(F.round("target_corr", 4) > 0.05, "target").otherwise("frequency"))
        .otherwise("hash")
    )
    risk = (
        F.when(F.col("strategy").isin("binary", "ordinal", "one_hot", "label"), "low")
        .when(F.col("strategy") == "hash", "high")
        .otherwise("medium")
    )
    ratio = n / F.col("n_rows")
    warn = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("imbalance") > 20, "severe_imbalance"),
                F.when(F.col("n_missing") > 0, "fill_missing_first"),
                F.when(n > MEDIUM, F.when(ratio > 0.9, "id_like").when(ratio > 0.5, "very_sparse").otherwise("manageable")),
            )
        ),
        ",",
    )
    return p.withColumn("strategy", strategy).select("column", "n_distinct", "cardinality", "strategy", risk.alias("risk"), warn.alias("warnings"))


def encoding_summary(advice: DataFrame) -> DataFrame:
    return advice.groupBy("strategy").agg(F.count(F.lit(1)).alias("n_columns"))


# ---- encoders ----


def one_hot(df: DataFrame, column: str, drop_first: bool = False, limit: int = HIGH) -> DataFrame:
    """One 0/1 column per value; beyond ``limit`` values one sparse vector column ``<column>_vector`` instead.

    The vector has a place per value in alphabetical order; a null is all zeros.
    """
    seen = df.filter(col(column).isNotNull()).select(col(column).cast("string").alias("v")).distinct()
    levels = sorted(r["v"] for r in seen.limit(limit + 1).collect())  # bounded by limit + 1
    if len(levels) > limit:
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import OneHotEncoder, StringIndexer

        index, vector, text = f"__i_{column}", f"{column}_vector", f"__s_{column}"
        codes = StringIndexer(inputCol=text, outputCol=index, handleInvalid="keep", stringOrderType="alphabetAsc")
        hot = OneHotEncoder(inputCols=[index], outputCols=[vector], dropLast=True)  # the last place is the null's
        work = df.withColumn(text, col(column).cast("string"))
        out = Pipeline(stages=[codes, hot]).fit(work).transform(work)
        return out.drop(column, text, index)
    keep = levels[1:] if drop_first else levels
    out = df.withColumns({f"{column}_{v}": F.coalesce((col(column).cast("string") == v).cast("int"), F.lit(0)) for v in keep})
    return out.drop(column)


def ordinal(df: DataFrame, column: str, scale: Sequence[str]) -> DataFrame:
    m = F.create_map(*[F.lit(x) for i, v in enumerate(scale) for x in (v, i)])
    return df.withColumn(column, F.element_at(m, F.lower(F.trim(col(column)))))


def binary_code(df: DataFrame, column: str) -> DataFrame:
    """Bits of the 1-based label code, highest first, as 0/1 columns."""
    codes = label_codes(df, [column]).select(F.col("value").alias("__v"), (F.col("code") + 1).alias("__c"))
    most = codes.agg(F.max("__c")).first()[0] or 1
    width = most.bit_length()
    joined = df.join(codes, col(column).cast("string") == F.col("__v"), "left")  # Spark picks the join by size
    bits = {
        f"{column}_{i}": F.coalesce(F.shiftright("__c", width - 1 - i).bitwiseAND(F.lit(1)), F.lit(0)).cast("int")
        for i in range(width)
    }
    return joined.withColumns(bits).drop("__v", "__c", column)


def target_mean(df: DataFrame, column: str, target: str, smoothing: float = 0.0) -> DataFrame:
    """Replace a value by the target's mean among its rows, pulled to the global mean by ``smoothing``."""
    y = number(target)
    g = one_row(df, {"m": F.avg(y)})["m"]
    per = df.groupBy(col(column).alias("__v")).agg(
        ((F.sum(y) + F.lit(smoothing) * F.lit(g)) / (F.count(y) + F.lit(smoothing))).alias("__m")
    )
    joined = df.join(per, col(column).eqNullSafe(F.col("__v")), "left")
    return joined.withColumn(f"{column}_target", F.coalesce("__m", F.lit(g))).drop("__v", "__m")


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Share of rows that hold the value."""
    n = df.count()
    per = df.filter(col(column).isNotNull()).groupBy(col(column).alias("__v")).agg((F.count(F.lit(1)) / F.lit(n)).alias("__f"))
    return df.join(per, col(column) == F.col("__v"), "left").withColumn(f"{column}_freq", F.col("__f")).drop("__v", "__f")


def hashed(df: DataFrame, column: str, buckets: int = 16) -> DataFrame:
    """Sixteen 0/1 bucket columns by a stable hash: no pass over the data at all."""
    b = F.pmod(F.xxhash64(col(column).cast("string")), F.lit(buckets)).cast("int")
    cols = {f"{column}_h{i}": F.coalesce(((b == i) & col(column).isNotNull()).cast("int"), F.lit(0)) for i in range(buckets)}
    return df.withColumns(cols).drop(column)
