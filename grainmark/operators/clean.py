"""Duplicate removal, missing-value strategies, safe repair and clipping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import digests, scratch, values
from ..functions.columns import col, constant, count_if, frame, kinds, nan_to_null, number, numeric_columns, one_row
from . import profile


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One of each row, nulls equal; rows that occur once stay where they are."""
    return digests.distinct_rows(df)


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column (smallest on ties), one small row each.

    Counts meet in one exchange over all columns, so neither a hot value nor a
    huge number of distinct values lands in a single buffer.
    """
    if not names:
        return {}
    text = values.value_text(df, names).alias("text")
    rows = values.value_summary(df, names).select("column", "i", "d", text).collect()
    out: dict[str, object] = {}
    for r in rows:
        k = kinds(df)[r["column"]]
        if r["text"] is None:
            out[r["column"]] = None
        elif k == "numeric":
            out[r["column"]] = r["i"] if r["i"] is not None else r["d"]
        else:
            out[r["column"]] = r["text"]
    return out


def fill_values(df: DataFrame, strategy: str, columns: Sequence[str] | None = None) -> dict[str, object]:
    """The replacement each column would get under a strategy."""
    df = nan_to_null(df)
    names = list(columns or df.columns)
    num = [c for c in names if c in numeric_columns(df)]
    other = [c for c in names if c not in num]
    if strategy == "mean":
        got: dict[str, object] = dict(one_row(df, {c: F.round(F.avg(number(c)), 4) for c in num})) if num else {}
    elif strategy == "median":
        got = {c: q[0] for c, q in values.quantiles(df, {c: number(c) for c in num}, [0.5]).items()}
    elif strategy in ("min", "max"):
        f = F.min if strategy == "min" else F.max
        got = dict(one_row(df, {c: f(number(c)) for c in num})) if num else {}
    elif strategy == "mode":
        got, other = {}, names
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    got.update(modes(df, other))
    return got


def fill(df: DataFrame, replacements: Mapping[str, object]) -> DataFrame:
    """Replace missing cells by literals.

    Whole-number columns that get a fractional replacement become double, as
    they would in the source data model.
    """
    out = []
    for f in df.schema.fields:
        c, v = col(f.name), replacements.get(f.name)
        if v is None:
            out.append(c)
            continue
        if isinstance(f.dataType, T.NumericType):
            fractional = float(v) != int(float(v)) if not isinstance(v, str) else False
            kind = "double" if fractional and isinstance(f.dataType, T.IntegralType) else f.dataType
            out.append(F.coalesce(c.cast(kind), F.lit(v).cast(kind)).alias(f.name))
        else:
            out.append(F.coalesce(c, F.lit(str(v)).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def handle_missing(df: DataFrame, strategy: str = "drop", fill_value: object = None) -> DataFrame:
    """drop, mean, median, mode or fill, applied to every column with nulls."""
    df = nan_to_null(df)
    if strategy == "drop":
        return df.na.drop("any")
    if strategy == "fill":
        out = []
        for f in df.schema.fields:
            v = F.lit(fill_value)
            if isinstance(f.dataType, T.NumericType) and isinstance(fill_value, (int, float)):
                v = v.cast(f.dataType)
            elif not isinstance(f.dataType, T.NumericType):
                v = F.lit(str(fill_value)).cast(f.dataType)
            else:
                v = F.lit(fill_value).try_cast(f.dataType)
            out.append(F.coalesce(col(f.name), v).alias(f.name))
        return df.select(*out)
    holes = columns_with_nulls(df)
    return fill(df, fill_values(df, strategy, list(holes))) if holes else df


def columns_with_nulls(df: DataFrame) -> dict[str, int]:
    """Null counts of the columns that have any; only those need statistics."""
    n = one_row(df, {c: count_if(col(c).isNull()) for c in df.columns})
    return {c: int(n[c]) for c in df.columns if n[c]}


def fill_log(df: DataFrame, strategy: str = "mean", fill_value: object = None) -> DataFrame:
    """(column, strategy, n_filled, replacement) for columns that had nulls."""
    df = nan_to_null(df)
    num = set(numeric_columns(df))
    holes = columns_with_nulls(df)
    if strategy == "fill":
        repl: dict[str, object] = {c: fill_value for c in holes}
    elif strategy == "drop":
        repl = {c: None for c in holes}
    else:
        repl = fill_values(df, strategy, list(holes)) if holes else {}
    rows = []
    for c in holes:
        used = strategy if c in num or strategy in ("fill", "drop", "mode") else "mode"
        rows.append((c, used, holes[c], None if repl[c] is None else str(repl[c])))
    return frame(df.sparkSession, rows, "column string, strategy string, n_filled long, replacement string")


def apply_safe_fixes(
    df: DataFrame, violations: DataFrame | None = None, missing_strategy: str = "median", max_missing: float = 0.60
) -> tuple[DataFrame, DataFrame]:
    """Drop duplicates and constants, fill flagged columns; returns (table, actions)."""
    df = nan_to_null(df)
    spark = df.sparkSession
    actions: list[tuple] = []
    flagged = (
        [r["column"] for r in violations.filter("kind = 'missing'").select("column").collect()]
        if violations is not None
        else []
    )
    out = scratch.materialise(remove_duplicates(df))  # every later step reads it again
    before, after = df.count(), out.count()
    if before != after:
        actions.append(("drop_duplicates", None, None, before - after))
    # constants and null counts of the deduplicated table, in one pass
    facts = one_row(
        out,
        {
            **{f"same:{c}": constant(out, c) for c in out.columns},
            **{f"na:{c}": count_if(col(c).isNull()) for c in out.columns},
        },
    )
    flat = [c for c in out.columns if facts[f"same:{c}"]]
    for c in flat:
        actions.append(("drop_constant_column", c, None, after))
    out = out.drop(*flat)
    num = set(numeric_columns(out))
    todo: dict[str, str] = {}
    for c in flagged:
        if c not in out.columns:
            continue
        na = int(facts[f"na:{c}"])
        if after and na / after > max_missing:
            actions.append(("skip_high_missing_column", c, None, na))
        elif na:
            todo[c] = missing_strategy if c in num else "mode"
            actions.append(("fill_missing", c, todo[c], na))
    repl: dict[str, object] = {}
    for s in set(todo.values()):
        names = [c for c, x in todo.items() if x == s]
        if s == "mean":
            repl.update(one_row(out, {c: F.avg(number(c)) for c in names}))
        else:
            repl.update(fill_values(out, s, names))
    out = fill(out, {c: ("unknown" if v is None else v) for c, v in repl.items()})
    return out, frame(spark, actions, "action string, column string, strategy string, n long")


def repair_audit(before: DataFrame, after: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: shapes before and after with the list of actions taken."""
    b = profile.shape(before).select(F.col("n_rows").alias("rows_before"), F.col("n_columns").alias("columns_before"))
    a = profile.shape(after).select(F.col("n_rows").alias("rows_after"), F.col("n_columns").alias("columns_after"))
    acts = actions.agg(F.collect_list(F.struct("action", "column", "strategy", "n")).alias("actions"))
    return b.crossJoin(a).crossJoin(acts).withColumn("made_at", F.current_timestamp())


def cap_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    lim = profile.fences(df, columns, k)
    out = nan_to_null(df)
    return out.withColumns(
        {
            c: F.when(number(c).isNotNull(), F.least(F.greatest(number(c), F.lit(lo)), F.lit(hi)))
            for c, (lo, hi, _) in lim.items()
        }
    )


def drop_outliers(df: DataFrame, flag: str = "is_outlier") -> DataFrame:
    """Remove the rows a detector flagged (see ``outliers``)."""
    return df.filter(~F.coalesce(F.col(flag), F.lit(False))).drop(flag)
