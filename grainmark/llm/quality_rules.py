"""Quality rules whose limits follow the data of each language and source.

Every document is measured once. Per (language, source) a mergeable KLL sketch of
each signal is kept; its quartiles give a fence (quartile, plus or minus
``reach`` quartile distances and the signal's ``slack``), and a document outside
any fence of its group is refused. Groups with fewer than ``min_rows`` documents
take the fence of their language, whose sketch is the merge of its sources'.

Sketches are combined before the shuffle, so a source that holds a third of all
rows is one small row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialise
from ..functions.ship import ship
from .packing import key_type
from .textbytes import SOLID, mix, row_counts, span_hashes, spans, text_slices, tidy, window_hashes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_capitals"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?")] = True
_LINE = np.ones(256, bool)
_LINE[10] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CHAR = np.ones(256, bool)
_CHAR[128:192] = False


@dataclass(frozen=True)
class Signal:
    """A quantity per document, what is added to its fences, and which sides are fenced."""

    name: str
    value: str
    slack: float
    low: bool = False


SIGNALS = (
    Signal("symbol_share", "n_symbols / greatest(word_chars, 1)", 0.03),
    Signal("mark_share", "n_marks / greatest(n_words, 1)", 0.3),
    Signal("capital_share", "n_capitals / greatest(word_chars, 1)", 0.2),
    Signal("repeat_share", "n_repeat_words / greatest(n_words, 1)", 0.3),
    Signal("dup_line_share", "n_dup_lines / greatest(n_lines, 1)", 0.6),
    Signal("word_length", "word_chars / greatest(n_words, 1)", 1.5, low=True),
)


def measures(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The MEASURES of each text, one array each."""
    n = len(off) - 1
    starts, ends, rows = spans(buf, off, SOLID)

    def per_row(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(mask[buf])))
        return c[off[1:]] - c[off[:-1]]

    n_words = row_counts(rows, n)
    chars = np.concatenate(([0], np.cumsum((_CHAR & SOLID)[buf])))
    word_chars = chars[off[1:]] - chars[off[:-1]]
    h, ok = window_hashes(span_hashes(buf, starts, ends), rows, 3)
    at = np.flatnonzero(ok)
    twice = _seen(h[at], rows[at])[0]
    hit = np.zeros(len(starts) + 2, bool)
    for k in range(3):
        hit[at[twice] + k] = True
    repeat = row_counts(rows, n, hit[: len(starts)])
    ls, le, lr = spans(buf, off, _LINE)
    solid = np.concatenate(([0], np.cumsum(SOLID[buf])))
    worded = solid[le] > solid[ls]
    ls, le, lr = ls[worded], le[worded], lr[worded]
    later = _seen(span_hashes(buf, ls, le), lr)[1]
    return [n_words, word_chars, per_row(_SYMBOL), row_counts(lr, n, later), repeat, row_counts(lr, n), per_row(_MARKS), per_row(_UPPER)]


def _seen(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its row, occurred earlier in its row) for each hash."""
    key = h ^ mix(rows.astype(np.uint64) + np.uint64(1))
    _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return count[which] > 1, first[which] != np.arange(len(key))


def measure(docs: DataFrame, *, key: str, text: str, groups: tuple[str, str]) -> DataFrame:
    """key, g0, g1 (the group, as text) and the MEASURES, all long. Null texts measure 0."""
    kind = key_type(docs, key)
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(3)):
                part = [b.column(i).slice(lo, hi - lo) for i in range(3)]
                yield pa.RecordBatch.from_arrays(part + [pa.array(m.astype(np.int64)) for m in measures(buf, off)], names=["key", "g0", "g1", *MEASURES])

    schema = T.StructType(
        [T.StructField("key", kind), T.StructField("g0", T.StringType()), T.StructField("g1", T.StringType())]
        + [T.StructField(m, T.LongType()) for m in MEASURES]
    )
    rows = docs.select(F.col(key).alias("key"), *(F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), schema)


def base_failed() -> Column:
    """Too short to judge, or more than half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def sketches(measured: DataFrame, k: int = 400) -> DataFrame:
    """One row per group: g0, g1, n and a KLL sketch of each signal, over documents that pass the base rules."""
    rows = measured.where(~base_failed()).select("g0", "g1", *(F.expr(f"cast({s.value} as double)").alias(s.name) for s in SIGNALS))
    return rows.groupBy("g0", "g1").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(s.name, k).alias(s.name) for s in SIGNALS))


def merge(tables: DataFrame, by: list[str]) -> DataFrame:
    """Sketch rows (of several runs, or of several groups) merged by the given columns."""
    return tables.groupBy(*by).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(s.name).alias(s.name) for s in SIGNALS))


def fences(sketched: DataFrame, *, reach: float, min_rows: int) -> DataFrame:
    """g0, g1, and <signal>_low / <signal>_high, from the group's sketch or its language's."""
    # A language whose documents all fail the base rules has no group and no fence.
    whole = merge(sketched, ["g0"]).select(F.col("g0").alias("p0"), *(F.col(s.name).alias(f"p_{s.name}") for s in SIGNALS))
    both = sketched.join(whole, sketched["g0"].eqNullSafe(whole["p0"]))
    cols = []
    for s in SIGNALS:
        sketch = F.when(F.col("n") >= min_rows, F.col(s.name)).otherwise(F.col(f"p_{s.name}"))
        q1, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        cols.append((q3 + F.lit(reach) * (q3 - q1) + F.lit(s.slack)).alias(f"{s.name}_high"))
        if s.low:
            cols.append((q1 - F.lit(reach) * (q3 - q1) - F.lit(s.slack)).alias(f"{s.name}_low"))
    return both.select("g0", "g1", *cols)


def judge(measured: DataFrame, limits: DataFrame, broadcast_rows: int = 50_000) -> DataFrame:
    """``measured`` with base_failed and kept.

    The limits, one row per group, are broadcast up to ``broadcast_rows`` rows (under
    10 MB) and joined by a shuffle that splits hot groups beyond.
    """
    limits = materialise(limits.withColumnsRenamed({"g0": "l0", "g1": "l1"}))
    small = limits.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = measured.join(F.broadcast(limits) if small else limits, measured["g0"].eqNullSafe(F.col("l0")) & measured["g1"].eqNullSafe(F.col("l1")), "left")
    inside = F.lit(True)
    for s in SIGNALS:
        inside &= F.expr(f"{s.value} <= {s.name}_high")
        if s.low:
            inside &= F.expr(f"{s.value} >= {s.name}_low")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    groups: tuple[str, str] = ("lang", "source"),
    reach: float = 4.0,
    min_rows: int = 100,
) -> DataFrame:
    """key, the MEASURES, base_failed and kept, one row per document.

    Null texts have no words and fail the base rules. Null groups are groups of their
    own. Equal keys and repeated rows are judged each for itself. Other columns are
    ignored; an empty table gives an empty result.
    """
    measured = materialise(measure(docs, key=key, text=text, groups=groups))
    limits = fences(materialise(sketches(measured)), reach=reach, min_rows=min_rows)
    return judge(measured, limits).select(F.col("key").alias(key), *MEASURES, "base_failed", "kept")
