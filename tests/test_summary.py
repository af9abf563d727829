"""Value counts by kind: summaries, commonest long texts, quantiles and the report read off them."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmark.functions import values
from grainmark.operators import profile

LONG = "a text that is much longer than the digest which stands for it, "


@pytest.fixture
def table(spark):
    """Long texts: all different, tied at two, with gaps, always missing; numbers of each kind."""
    rows = [
        (i, float(i % 5) if i % 4 else None, i % 2 == 0, f"s{i % 3}", f"{LONG}{i:03}", f"{LONG}{i // 2:03}" if i < 90 else None, None, f"{i}.5")
        for i in range(100)
    ]
    df = spark.createDataFrame(rows, "id long, x double, even boolean, short string, `long.one` string, twice string, gone string, wide string")
    return df.withColumn("wide", F.col("wide").cast("decimal(30,2)")).repartition(5)


@pytest.mark.parametrize("sent", [0, 100_000])
def test_summary_equals_counting(spark, table, monkeypatch, sent):
    monkeypatch.setattr(values, "TIES_SENT", sent)
    assert set(values.typed_counts(table)) == {"i", "d", "s", "t"}
    got = {r["column"]: r for r in values.value_summary(table).collect()}
    for c in table.columns:
        cells = [r[0] for r in table.select(f"`{c}`").collect()]
        have = [v for v in cells if v is not None]
        n = {v: have.count(v) for v in have}
        r = got[c]
        assert (r["n_rows"], r["n_missing"], r["n_distinct"]) == (100, 100 - len(have), len(n))
        assert (r["top_n"], r["least_n"]) == ((max(n.values()), min(n.values())) if n else (None, None))
        if n:
            assert r["entropy"] == pytest.approx(-sum(k / len(have) * math.log2(k / len(have)) for k in n.values()), abs=1e-9)
    assert got["long.one"]["s"] == f"{LONG}000" and got["twice"]["s"] == f"{LONG}000"
    assert got["short"]["s"] == "s0" and got["x"]["d"] == 0.0 and got["gone"]["s"] is None
    assert values.value_summary(table.limit(0)).count() == 0


def test_long_texts_are_not_exchanged(table):
    plan = values.typed_counts(table, ["long.one", "twice"])["t"]._jdf.queryExecution().optimizedPlan().toString()
    head = plan.splitlines()[0]
    assert head.startswith("Aggregate [c") and "long.one" not in head and "twice" not in head


@pytest.mark.parametrize("small", [0, 5_000_000])
def test_quantiles_of_counts(spark, small):
    x = np.round(np.random.default_rng(5).normal(size=501), 1)
    df = spark.createDataFrame([(float(v), int(10 * v)) for v in x], "a double, b int")
    counts = values.typed_counts(df)
    for slot, want in (("d", x), ("i", np.trunc(10 * x + 1e-9 * np.sign(x)))):
        r = values.count_quantiles(counts[slot], [0.0, 0.25, 0.6, 1.0], small).first()
        assert r["n"] == 501
        if slot == "d":
            assert r["q"] == pytest.approx(np.quantile(want, [0.0, 0.25, 0.6, 1.0]))


def test_report_equals_its_parts(spark, table):
    """Sections read off the counts equal the operators that read rows, wide decimals and empty tables too."""
    extra = spark.createDataFrame([(10**6, 500.0, True, "s0", LONG, LONG, None, 9999.0)], "id long, x double, even boolean, short string, `long.one` string, twice string, gone string, wide double")
    df = table.unionByName(extra.withColumn("wide", F.col("wide").cast("decimal(30,2)")))
    for d in (df, df.limit(0), df.select("short")):
        got = {(r["section"], r["column"], r["metric"]): r["value"] for r in profile.full_report(d).collect()}
        far = {r["column"]: r for r in profile.iqr_outlier_report(d).collect()}
        assert {k[1] for k in got if k[0] == "outliers"} == set(far)
        for c, r in far.items():
            assert [got["outliers", c, m] for m in ("n_outliers", "lower", "upper")] == pytest.approx([r["n_outliers"], r["lower"], r["upper"]])
        assert {k[1]: v for k, v in got.items() if k[0] == "missing"} == {r["column"]: r["n_missing"] for r in profile.missing_values(d).collect()}
