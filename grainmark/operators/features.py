"""Feature engineering, scaling and table preparation."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scratch, values
from ..functions.columns import (
    col,
    frame,
    nan_to_null,
    number,
    numeric_columns,
    of_kind,
    one_row,
    text_columns,
)
from . import clean


def parsed_dates(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Turn text columns into timestamps when at least ``share`` of them parse."""
    df = nan_to_null(df)
    texts = text_columns(df)
    if not texts:
        return df
    aggs: dict[str, Column] = {}
    for c in texts:
        aggs[f"n:{c}"] = F.count(col(c))
        aggs[f"ok:{c}"] = F.count(F.try_to_timestamp(col(c)))
    got = one_row(df, aggs)
    dates = [c for c in texts if got[f"n:{c}"] and got[f"ok:{c}"] / got[f"n:{c}"] >= share]
    return df.withColumns({c: F.try_to_timestamp(col(c)) for c in dates}) if dates else df


def date_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or of_kind(df, "datetime"))
    out: dict[str, Column] = {}
    for c in names:
        d = col(c)
        out[f"{c}_year"] = F.year(d)
        out[f"{c}_month"] = F.month(d)
        out[f"{c}_day"] = F.dayofmonth(d)
        out[f"{c}_day_of_week"] = F.weekday(d)
        out[f"{c}_is_weekend"] = (F.weekday(d) >= 5).cast("int")
    return df.withColumns(out) if out else df


def numeric_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``log1p`` of strictly positive columns and the square of every column."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    if not names:
        return df
    low = one_row(df, {c: F.min(number(c)) for c in names})
    out: dict[str, Column] = {}
    for c in names:
        if low[c] is not None and low[c] > 0:
            out[f"{c}_log"] = F.log1p(number(c))
        out[f"{c}_squared"] = number(c) * number(c)
    return df.withColumns(out)


def interactions(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Products of all pairs of numeric columns (of the first ``limit``)."""
    names = list(columns or numeric_columns(df))
    pairs = list(combinations(names, 2))[:limit]
    return df.withColumns({f"{a}_x_{b}": number(a) * number(b) for a, b in pairs}) if pairs else df


def text_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = list(columns or text_columns(df))
    out: dict[str, Column] = {}
    for c in names:
        t = F.coalesce(col(c), F.lit(""))
        out[f"{c}_length"] = F.length(t)
        out[f"{c}_word_count"] = F.regexp_count(t, F.lit(r"\S+"))
    return df.withColumns(out) if out else df


def engineer_features(
    df: DataFrame, dates: bool = True, numeric: bool = True, interact: bool = True, text: bool = True
) -> DataFrame:
    """All families together, each computed from the original columns."""
    base = parsed_dates(df) if dates else nan_to_null(df)
    nums, texts = numeric_columns(base), text_columns(base)
    out = base
    if dates:
        out = date_features(out, of_kind(base, "datetime"))
    if numeric:
        out = numeric_features(out, nums)
    if interact:
        out = interactions(out, nums)
    if text:
        out = text_features(out, texts)
    return out


# ---- scaling ----


def standard_scale(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """(x − mean) / sample std; constant columns stay as they are."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    got = one_row(df, {f"{m}{c}": f(number(c)) for c in names for m, f in (("m", F.avg), ("s", F.stddev_samp))})
    return df.withColumns(
        {c: F.round((number(c) - got[f"m{c}"]) / got[f"s{c}"], digits) for c in names if (got[f"s{c}"] or 0) > 0}
    )


def minmax_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    got = one_row(df, {f"{m}{c}": f(number(c)) for c in names for m, f in (("lo", F.min), ("hi", F.max))})
    return df.withColumns(
        {
            c: (number(c) - got[f"lo{c}"]) / ((got[f"hi{c}"] - got[f"lo{c}"]) or 1.0)
            for c in names
            if got[f"lo{c}"] is not None
        }
    )


def robust_scale(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x − median) / IQR."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    q = values.quantiles(df, {c: number(c) for c in names}, [0.25, 0.5, 0.75])
    return df.withColumns(
        {c: (number(c) - m) / ((hi - lo) or 1.0) for c, (lo, m, hi) in q.items() if lo is not None}
    )


SCALERS = {"standard": standard_scale, "minmax": minmax_scale, "robust": robust_scale}


# ---- preparation ----


def useless_columns(df: DataFrame) -> dict[str, str]:
    """Constant columns and text columns in which every row differs."""
    df = nan_to_null(df)
    texts = set(text_columns(df))
    out: dict[str, str] = {}
    for r in values.value_summary(df).select("column", "n_rows", "n_distinct").collect():  # one row per column
        if r["n_distinct"] <= 1:
            out[r["column"]] = "constant"
        elif r["n_distinct"] == r["n_rows"] and r["column"] in texts:
            out[r["column"]] = "all_unique"
    return out


def drop_useless(df: DataFrame) -> DataFrame:
    return df.drop(*useless_columns(df))


def label_codes(df: DataFrame, columns: Sequence[str], by: str = "value") -> DataFrame:
    """(column, value, code): codes from 0 in alphabetical or frequency order.

    Codes are exact positions in a range partitioned table of distinct values,
    so a column with very many of them is still numbered in parallel.
    """
    counts = values.value_counts(df, columns).filter(values.has_value())
    counts = counts.select("column", values.value_text(df, columns).alias("value"), (-F.col("n")).alias("less"))
    order = ["column", "value"] if by == "value" else ["column", "less", "value"]
    placed = values.with_position(counts, order, "place")
    first = placed.groupBy("column").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "column").select(  # one row per column
        "column", "value", (F.col("place") - F.col("first")).cast("int").alias("code")
    )


def label_encode(df: DataFrame, columns: Sequence[str] | None = None, by: str = "value") -> DataFrame:
    """Replace text by codes; nulls stay null."""
    names = list(columns or text_columns(df))
    if not names:
        return df
    codes = label_codes(df, names, by)
    return encode_with(df, names, codes)


# Maps of up to this many values ride along as a literal; larger ones are joined.
SMALL_MAP = 1_000


def encode_with(df: DataFrame, names: Sequence[str], codes: DataFrame) -> DataFrame:
    size = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = [c for c in names if size.get(c, 0) <= SMALL_MAP]
    out = df
    if small:
        maps: dict[str, dict[str, int]] = {c: {} for c in small}
        for r in codes.filter(F.col("column").isin(small)).collect():  # at most SMALL_MAP per column
            maps[r["column"]][r["value"]] = r["code"]
        for c in small:
            pairs = [F.lit(x) for v, k in maps[c].items() for x in (v, k)]
            m = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,int>")
            out = out.withColumn(c, F.element_at(m, col(c).cast("string")))
    for c in names:
        if c in small:
            continue
        one = codes.filter(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias("__c"))
        joined = out.join(one, col(c).cast("string") == F.col("__v"), "left")
        out = joined.withColumn(c, F.col("__c")).drop("__v", "__c")
    return out


def prepare_for_ml(
    df: DataFrame, missing_strategy: str = "median", scale: bool = True, encode: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Deduplicate, fill, drop useless columns, encode and scale; returns (table, log)."""
    df = nan_to_null(df)
    spark = df.sparkSession
    log: list[tuple] = []
    n0 = df.count()
    out = scratch.materialise(clean.remove_duplicates(df))  # every later step reads it again
    n1 = out.count()
    log.append(("duplicates_removed", None, n0 - n1, None))
    if missing_strategy == "drop":
        out = out.na.drop("any")
        log.append(("rows_dropped", None, n1 - out.count(), None))
    else:
        holes = clean.columns_with_nulls(out)
        if holes:
            repl = clean.fill_values(out, missing_strategy, list(holes))
            repl = {c: ("unknown" if v is None and c in text_columns(out) else v) for c, v in repl.items()}
            out = clean.fill(out, repl)
            log += [("filled", c, n, str(repl[c])) for c, n in holes.items()]
    useless = useless_columns(out)
    out = out.drop(*useless)
    log += [("dropped", c, None, why) for c, why in useless.items()]
    if encode:
        texts = text_columns(out)
        out = label_encode(out, texts)
        log += [("encoded", c, None, None) for c in texts]
    if scale:
        nums = numeric_columns(out)
        out = standard_scale(out, nums)
        log += [("scaled", c, None, None) for c in nums]
    return out, frame(spark, log, "step string, column string, n long, detail string")
