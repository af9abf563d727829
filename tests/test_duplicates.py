"""Duplicates by digest: the rows themselves are exchanged only where they may repeat."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmark.functions import digests
from grainmark.operators import clean, profile

NAN = float("nan")
SCHEMA = "a long, b string, c double, d array<string>, m map<string,int>, s struct<x:int,y:string>"
ROWS = [
    (1, "x", 0.0, ["p"], {"k": 1}, (1, None)),
    (1, "x", -0.0, ["p"], {"k": 1}, (1, None)),
    (None, "x", 1.0, None, None, None),
    (1, None, 1.0, None, None, None),
    (None, None, NAN, [None, "1"], {}, (None, "1")),
    (None, None, NAN, ["1", None], {}, (None, "1")),
    (None, None, NAN, ["1", None], {}, (None, "1")),
    (2, "", None, [], None, (1, "1")),
    (2, None, None, [], None, (1, "1")),
    (2, "", None, [], None, (1, "1")),
]


def told(rows):
    """Rows as Spark compares them: NaN stands for missing, both zeros are one."""

    def cell(x):
        return (None if x != x else x + 0.0) if isinstance(x, float) else x

    return Counter(repr(tuple(cell(x) for x in r)) for r in rows)


@pytest.fixture(params=[True, False])
def both_ways(request, monkeypatch):
    monkeypatch.setattr(digests, "NARROW", 10**6 if request.param else 0)


@pytest.mark.parametrize("maps", [True, False])
def test_odd_rows(spark, both_ways, maps):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    df = df if maps else df.withColumn("m", F.to_json("m"))
    want = told(tuple(r) for r in df.collect())
    got = told(tuple(r) for r in clean.remove_duplicates(df).collect())
    assert set(got.values()) == {1} and len(got) == len(want) == 7
    assert profile.duplicate_rows(df).first()[0] == 3
    assert sorted(r["n_copies"] for r in profile.list_duplicates(df).collect()) == [2, 2, 2]
    none = df.where("a = 9")
    assert clean.remove_duplicates(none).count() == 0 and profile.duplicate_rows(none).first()[0] == 0 and profile.list_duplicates(none).count() == 0


@pytest.mark.parametrize("words", [2, 1 << 10])
def test_hot_row_and_a_full_bitmap(spark, words, monkeypatch):
    monkeypatch.setattr(digests, "NARROW", 0)
    monkeypatch.setattr(digests, "_LEAST_WORDS", words)
    monkeypatch.setattr(digests, "_MOST_WORDS", words)
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.floor(F.col("id") / F.when(F.col("id") < 900, 2).otherwise(1))).alias("k"), F.lit("text").alias("t"))
    got = clean.remove_duplicates(df)
    assert got.count() == got.distinct().count() == df.distinct().count()
    assert profile.duplicate_rows(df).first()[0] == 30_000 - got.count()
    copies = {r["k"]: r["n_copies"] for r in profile.list_duplicates(df).collect()}
    want = {r["k"]: r["count"] for r in df.groupBy("k").count().where("count > 1").collect()}
    assert copies == want


def test_plan_exchanges_no_row_that_occurs_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("doc_id")
    twice = df.union(df.limit(5))
    marked = digests.may_repeat(twice)
    assert 5 <= marked.where("__may").select(F.count("*")).first()[0] <= 40
    counted = profile.duplicate_rows(twice)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in counted.splitlines() if "Exchange" in x or "HashAggregate" in x]
    assert lines and not any("text" in x for x in lines)
    plan = clean.remove_duplicates(twice)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("Aggregate") == 1
    assert clean.remove_duplicates(twice).count() == df.distinct().count()
