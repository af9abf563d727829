"""Ranks of several columns at once, and levels of encodings in one pass."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmark.functions import values
from grainmark.operators import encode, stats


@pytest.fixture(params=[0, 200_000])
def sent(request, monkeypatch):
    monkeypatch.setattr(stats, "RANKS_SENT", request.param)


def test_ranks_equal_average_ranks(spark, sent):
    """A value in half of the rows, ties, both zeros, and a column without ties."""
    rows = [(float(i % 2 and i), -0.0 if i % 3 else 0.0, float((i * 37) % 101), i // 7) for i in range(101)]
    df = spark.createDataFrame(rows, "hot double, zeros double, `own.name` double, steps int")
    names = df.columns
    got = stats.ranked(df, names).toPandas()[names]
    want = pd.DataFrame(rows, columns=names).rank()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
    assert stats.ranked(df.limit(0), names).count() == 0


def test_all_columns_are_ranked_in_one_exchange(spark, monkeypatch):
    asked = []
    runs = values.value_runs
    monkeypatch.setattr(values, "value_runs", lambda *a, **k: asked.append(1) or runs(*a, **k))
    df = spark.range(300).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (-F.col("id")).cast("double").alias("c"))
    r = {(x["col_a"], x["col_b"]): x["r"] for x in stats.spearman(df).collect()}
    assert len(asked) == 1 and r["a", "c"] == pytest.approx(-1)


def test_levels_are_known_words_only(spark):
    rows = [("Yes", " low ", "a", None, "q1", "yes"), ("no", "HIGH", "b", None, "q1", " no"), (None, "Medium", "c", None, None, "no"), ("NO", "low", "yes", None, "q1", "yes")]
    df = spark.createDataFrame(rows, "pair string, scale string, free string, gone string, single string, blank string")
    got = {r["column"]: (r["is_boolean"], r["is_ordinal"], r["ordinal_scale"]) for r in encode.encoding_profile(df).collect()}
    assert got["pair"] == (True, False, None)
    assert got["scale"] == (False, True, "low < medium < high")
    assert got["free"] == got["gone"] == got["single"] == got["blank"] == (False, False, None)
