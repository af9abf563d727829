"""Table contracts and declared column rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..functions.columns import (
    col,
    count_if,
    frame,
    kinds,
    nan_to_null,
    number,
    numeric_columns,
    one_row,
    text_columns,
    union_all,
)
from . import profile

# Named patterns, words that read as yes/no, the look of a number.
PATTERNS = {
    "email": r"^[\w\.-]+@[\w\.-]+\.\w{2,}$",
    "phone": r"^\+?[\d\s\-\(\)]{7,15}$",
    "url": r"^https?://[\w\.-]+\.[a-z]{2,}",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "zipcode": r"^\d{5}(-\d{4})?$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "y", "n", "t", "f"]
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def looks_numeric(c: Column) -> Column:
    return c.rlike(NUMERIC_TEXT)


def evaluate_contracts(
    df: DataFrame, max_missing_ratio: float = 0.35, max_unique_text_ratio: float = 0.95
) -> DataFrame:
    """Violations as (level, kind, column, value)."""
    df = nan_to_null(df)
    schema = "level string, kind string, column string, value double"
    if not df.columns:
        return frame(df.sparkSession, [("high", "schema", None, 0.0)], schema)
    s = values.value_summary(df)
    ratio = F.col("n_missing") / F.col("n_rows")
    distinct = F.col("n_distinct") + F.when(F.col("n_missing") > 0, 1).otherwise(0)
    unique = distinct / F.col("n_rows")
    is_text = F.col("column").isin(text_columns(df))

    def row(level: Column, kind: str, value: Column) -> Column:
        return F.struct(level.alias("level"), F.lit(kind).alias("kind"), value.cast("double").alias("value"))

    found = F.array_compact(
        F.array(
            F.when(
                ratio > max_missing_ratio,
                row(F.when(ratio > 0.6, "high").otherwise("medium"), "missing", ratio),
            ),
            F.when(distinct <= 1, row(F.lit("medium"), "constant", distinct)),
            F.when(
                is_text & (unique >= max_unique_text_ratio) & (distinct > 25),
                row(F.lit("medium"), "high_cardinality_text", unique),
            ),
        )
    )
    per_column = s.select("column", F.inline(found)).select("level", "kind", "column", "value")
    none = F.lit(None).cast("string").alias("column")
    copies = (
        profile.duplicate_rows(df)
        .filter("n_duplicates > 0")
        .select(
            F.lit("medium").alias("level"),
            F.lit("duplicates").alias("kind"),
            none,
            F.col("n_duplicates").cast("double").alias("value"),
        )
    )
    empty = (
        df.agg(F.count(F.lit(1)).alias("n"))
        .filter("n = 0")
        .select(F.lit("high").alias("level"), F.lit("schema").alias("kind"), none, F.lit(0.0).alias("value"))
    )
    return union_all([per_column, copies, empty])


def contract_risk(violations: DataFrame) -> DataFrame:
    """Overall risk and counts by level of a violations table."""
    counts = violations.agg(
        count_if(F.col("level") == "high").alias("n_high"),
        count_if(F.col("level") == "medium").alias("n_medium"),
        F.count(F.lit(1)).alias("n_total"),
    )
    risk = F.when(F.col("n_high") > 0, "high").when(F.col("n_medium") > 0, "medium").otherwise("low")
    return counts.withColumn("overall_risk", risk)


@dataclass
class Rule:
    """What one column must look like."""

    dtype: str = "any"  # numeric, text, date, boolean or any
    required: bool = False
    unique: bool = False
    min_val: float | None = None
    max_val: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    allowed_values: Sequence[str] | None = None
    forbidden_values: Sequence[str] | None = None
    pattern: str | None = None
    nullable_pct: float | None = None
    # a boolean Column that is true for good rows, or a function of the table
    # that returns error texts
    custom: Column | Callable[[DataFrame], list[str]] | None = None

    def __post_init__(self) -> None:
        for name in ("allowed_values", "forbidden_values"):
            words = getattr(self, name)
            if words is not None:
                setattr(self, name, [str(w).strip().lower() for w in words])

    def to_dict(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "custom"}

    @classmethod
    def from_dict(cls, d: Mapping) -> Rule:
        return cls(**{k: v for k, v in d.items() if k != "custom"})


def schema_to_dict(schema: Mapping[str, Rule]) -> dict[str, dict]:
    return {c: r.to_dict() for c, r in schema.items()}


def schema_from_dict(d: Mapping[str, Mapping]) -> dict[str, Rule]:
    return {c: Rule.from_dict(r) for c, r in d.items()}


def _bad_cells(df: DataFrame, c: str, r: Rule) -> dict[str, Column]:
    """Per check the condition a bad (non-null) cell meets."""
    x, is_num = col(c), c in numeric_columns(df)
    text = x.cast("string")
    bad: dict[str, Column] = {}
    if r.dtype == "numeric":
        bad["type"] = F.lit(False) if is_num else ~looks_numeric(text)
    elif r.dtype == "date":
        bad["type"] = F.lit(False) if kinds(df)[c] == "datetime" else F.try_to_timestamp(text).isNull()
    elif r.dtype == "boolean":
        bad["type"] = ~F.lower(text).isin(BOOLEAN_WORDS)
    if is_num:
        if r.min_val is not None:
            bad["min"] = number(c) < r.min_val
        if r.max_val is not None:
            bad["max"] = number(c) > r.max_val
    if r.min_length is not None:
        bad["min_length"] = F.length(text) < r.min_length
    if r.max_length is not None:
        bad["max_length"] = F.length(text) > r.max_length
    plain = F.lower(F.trim(text))
    if r.allowed_values is not None:
        bad["allowed"] = ~plain.isin(list(r.allowed_values))
    if r.forbidden_values is not None:
        bad["forbidden"] = plain.isin(list(r.forbidden_values))
    if r.pattern is not None:
        bad["pattern"] = ~text.rlike("^(?:" + PATTERNS.get(r.pattern, r.pattern) + ")")
    if isinstance(r.custom, Column):
        bad["custom"] = ~r.custom
    return {k: x.isNotNull() & F.coalesce(v, F.lit(True)) for k, v in bad.items()}


def validate_schema(df: DataFrame, schema: Mapping[str, Rule]) -> DataFrame:
    """Every check as (column, check, outcome, n_bad).

    All cell checks of all columns share one aggregate; uniqueness adds one
    exchange over the columns that ask for it.
    """
    df = nan_to_null(df)
    present = {c: r for c, r in schema.items() if c in df.columns}
    aggs: dict[str, Column] = {"n": F.count(F.lit(1))}
    for c, r in present.items():
        aggs[f"null\u0000{c}"] = count_if(col(c).isNull())
        for k, cond in _bad_cells(df, c, r).items():
            aggs[f"{k}\u0000{c}"] = count_if(cond)
    got = one_row(df, aggs)
    asked = [c for c, r in present.items() if r.unique]
    extra: dict[str, int] = {}
    if asked:
        for row in values.value_summary(df, asked).collect():  # one row per column
            gone = 1 if row["n_missing"] else 0
            extra[row["column"]] = row["n_rows"] - row["n_distinct"] - gone
    rows: list[tuple] = []
    for c, r in schema.items():
        if c not in present:
            rows.append((c, "present", "missing", 0))
            continue
        na, n = got[f"null\u0000{c}"], max(got["n"], 1)
        if r.nullable_pct is not None:
            rows.append((c, "nullable_pct", "error" if na / n > r.nullable_pct else "passed", na))
        elif r.required:
            rows.append((c, "required", "error" if na else "passed", na))
        if r.unique:
            rows.append((c, "unique", "error" if extra[c] else "passed", extra[c]))
        is_num = c in numeric_columns(df)
        for k in _bad_cells(df, c, r):
            n_bad = got[f"{k}\u0000{c}"]
            outcome = "error" if n_bad else "passed"
            if k == "type" and r.dtype == "numeric" and not is_num and not n_bad:
                outcome = "warning"  # text that could be cast
            rows.append((c, k, outcome, n_bad))
        if (r.min_val is not None or r.max_val is not None) and not is_num:
            rows.append((c, "range", "warning", 0))
        if r.custom is not None and not isinstance(r.custom, Column):
            try:
                errors = r.custom(df.select(col(c)))
                rows.append((c, "custom", "error" if errors else "passed", len(errors or [])))
            except Exception:  # a broken user rule is a warning, not a failure
                rows.append((c, "custom", "warning", 0))
    return frame(df.sparkSession, rows, "column string, check string, outcome string, n_bad long")


def schema_status(checks: DataFrame) -> DataFrame:
    """pass, fail or missing per column."""
    out = F.col("outcome")
    return checks.groupBy("column").agg(
        F.when(F.max((out == "missing").cast("int")) == 1, "missing")
        .when(F.max((out == "error").cast("int")) == 1, "fail")
        .otherwise("pass")
        .alias("status"),
        count_if(out == "error").alias("n_errors"),
        count_if(out == "warning").alias("n_warnings"),
        count_if(out == "passed").alias("n_passed"),
    )


def schema_verdict(df: DataFrame, schema: Mapping[str, Rule], checks: DataFrame) -> DataFrame:
    """One row: columns passed and failed, warnings, coverage, valid."""
    uncovered = [c for c in df.columns if c not in schema]
    status = schema_status(checks)
    bare = [(c,) for c in schema]
    full = frame(df.sparkSession, bare, "column string").join(status, "column", "left")
    return full.agg(
        count_if(F.coalesce("status", F.lit("pass")) == "pass").alias("n_passed"),
        count_if(F.col("status").isin("fail", "missing")).alias("n_failed"),
        F.coalesce(F.sum("n_warnings"), F.lit(0)).alias("n_warnings"),
    ).select(
        "*",
        F.lit(round(len(schema) / max(len(df.columns), 1) * 100, 1)).alias("coverage"),
        F.array_join(F.array(*[F.lit(c) for c in uncovered]).cast("array<string>"), ",").alias("uncovered"),
        (F.col("n_failed") == 0).alias("valid"),
    )


def violation_examples(df: DataFrame, schema: Mapping[str, Rule], limit: int = 5) -> DataFrame:
    """The first few distinct bad values of every failing check."""
    df = nan_to_null(df)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(k).alias("check"),
            F.when(cond, col(c).cast("string")).alias("value"),
        )
        for c, r in schema.items()
        if c in df.columns
        for k, cond in _bad_cells(df, c, r).items()
    ]
    bad = df.select(F.inline(F.array(*cells))).filter("value is not null")
    counts = bad.groupBy("column", "check", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column", "check").orderBy("value")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("place")


def duplicate_examples(df: DataFrame, column: str, limit: int = 3) -> DataFrame:
    """Duplicate count of a column that should be unique, and its first repeats."""
    df = nan_to_null(df)
    again = df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return again.filter("value is not null").orderBy("value").limit(limit)


def not_in_table(df: DataFrame, column: str, lookup: DataFrame, key: str) -> DataFrame:
    """Rows whose value is absent from a (possibly large) table of allowed values."""
    norm = F.lower(F.trim(col(column).cast("string")))
    good = lookup.select(F.lower(F.trim(col(key).cast("string"))).alias("__k")).distinct()
    return df.filter(col(column).isNotNull()).join(good, norm == F.col("__k"), "left_anti")


def infer_schema(df: DataFrame, max_allowed: int = 20) -> dict[str, Rule]:
    """A starting rule per column, read from the whole table."""
    df = nan_to_null(df)
    num, kind = set(numeric_columns(df)), kinds(df)
    unparsed = {
        c: count_if(col(c).isNotNull() & F.try_to_timestamp(col(c)).isNull()) for c in text_columns(df)
    }
    bad = one_row(df, unparsed) if unparsed else {}
    facts = {r["column"]: r for r in values.value_summary(df).collect()}  # one row per column
    out: dict[str, Rule] = {}
    low: list[str] = []
    for c in df.columns:
        f = facts[c]
        r = Rule(required=f["n_missing"] == 0, unique=f["n_distinct"] == f["n_rows"] and f["n_rows"] > 1)
        if c in num:
            r.dtype = "numeric"
            if f["min"] is not None:
                r.min_val, r.max_val = round(f["min"], 4), round(f["max"], 4)
        elif kind[c] == "datetime" or (c in bad and bad[c] == 0):
            r.dtype = "date"
        else:
            r.dtype = "text"
            if f["n_distinct"] <= max_allowed:
                low.append(c)
        out[c] = r
    if low:
        rows = values.value_counts(df, low).filter(values.has_value())
        rows = rows.select("column", F.trim(values.value_text(df, low)).alias("v")).distinct()
        for r in rows.collect():  # at most max_allowed per column
            rule = out[r["column"]]
            rule.allowed_values = sorted([*(rule.allowed_values or []), r["v"].lower()])
    return out


def schema_table(df: DataFrame, schema: Mapping[str, Rule]) -> DataFrame:
    """An inferred or declared schema as rows."""
    rows = []
    for c, r in schema.items():
        d = asdict(r) if r.custom is None else r.to_dict()
        allowed = ",".join(d["allowed_values"]) if d["allowed_values"] is not None else None
        lo = None if d["min_val"] is None else float(d["min_val"])
        hi = None if d["max_val"] is None else float(d["max_val"])
        rows.append((c, d["dtype"], d["required"], d["unique"], lo, hi, allowed))
    return frame(
        df.sparkSession,
        rows,
        "column string, dtype string, required boolean, unique boolean, min_val double, max_val double, allowed string",
    )
