"""Associations between text columns without exchanging their texts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainmark.operators import relate


def cramers_v(a, b):
    ok = a.notna() & b.notna()
    t = pd.crosstab(a[ok], b[ok]).to_numpy().astype(float)
    n, k = t.sum(), min(t.shape)
    want = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / n
    return 0.0 if k <= 1 else float(np.sqrt(((t - want) ** 2 / want).sum() / (n * (k - 1))))


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(8)
    n = 900
    pdf = pd.DataFrame({"id": [f"id{i}" for i in range(n)], "one": "x", "few": r.choice(list("abc"), n), "skew": np.where(r.random(n) < 0.97, "p", r.choice(list("qrstuvw"), n))})
    pdf["same"] = pdf["few"].str.upper()
    pdf["many"] = [f"m{i}" for i in r.integers(0, 300, n)]
    pdf["gaps"] = pdf["few"].where(r.random(n) < 0.8)
    pdf["empty"] = None
    return pdf


def test_v_of_all_pairs(spark, texts):
    df = spark.createDataFrame(texts.astype(object).where(texts.notna(), None).values.tolist(), ", ".join(f"{c} string" for c in texts))
    got = {(r["col_a"], r["col_b"]): (r["v"], r["n"]) for r in relate.cramers_v_pairs(df).collect()}
    names = [c for c in texts if c != "empty"]
    assert set(got) == set(combinations(names, 2))
    for (a, b), (v, n) in got.items():
        assert v == pytest.approx(cramers_v(texts[a], texts[b]), abs=1e-9), (a, b)
        assert n == (texts[a].notna() & texts[b].notna()).sum()


def test_bound_holds_and_prunes(spark, texts, monkeypatch):
    whole = ["few", "skew", "same", "many"]
    df = spark.createDataFrame(texts[["id", *whole]])
    freq = relate.frequencies(df, whole)
    for a, b in combinations(whole, 2):
        assert relate.largest_v(freq[a], freq[b]) >= cramers_v(texts[a], texts[b]) - 1e-9
    r = np.random.default_rng(9)
    for _ in range(200):  # any two complete columns
        a, b = (pd.Series(r.choice(r.integers(1, 9), 60, p=None).astype(str)) if r.random() < 0.5 else pd.Series((r.exponential(size=60) * 3).astype(int).astype(str)) for _ in range(2))
        fa, fb = (np.array(sorted((f, k, f * k) for f, k in x.value_counts().value_counts().items()), float) for x in (a, b))
        assert relate.largest_v(fa, fb) >= cramers_v(a, b) - 1e-9
    seen = []
    keep = relate.joint_counts
    monkeypatch.setattr(relate, "joint_counts", lambda df, pairs: seen.append(list(pairs)) or keep(df, pairs))
    strong = relate.cramers_v_pairs(df, least=0.5)
    pairs = {(r["col_a"], r["col_b"]) for r in strong.where("v >= 0.5").collect()}
    assert pairs == {(a, b) for a, b in combinations(["id", *whole], 2) if cramers_v(texts[a], texts[b]) >= 0.5}
    assert not any("id" in p for p in seen[0]) and ("few", "skew") not in seen[0]


def test_long_texts_are_not_exchanged(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("id", F.col("doc_id").cast("string"))
    counted = relate.joint_counts(df, [("text", "lang"), ("source", "lang")])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Exchange" in line or "HashAggregate" in line:
            assert "text" not in line and "string" not in line, line
    got = {(r["col_a"], r["col_b"]): r["v"] for r in relate.cramers_v_pairs(df, ["id", "text", "lang", "source"]).collect()}
    pdf = df.select("id", "text", "lang", "source").toPandas()
    for (a, b), v in got.items():
        assert v == pytest.approx(cramers_v(pdf[a], pdf[b]), abs=1e-9)
