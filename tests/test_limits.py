"""Inputs beyond what used to be a limit, and landing that never loses a table."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from grainmark.operators import automl, encode, impute, impute_models, outlier_models, outliers, profile, stats
from grainmark.sources import catalog, landing, names, readers


@pytest.mark.parametrize("mode", ["replace", "append", "skip", "upsert", "ignore"])
def test_an_unreadable_table_survives(spark, tmp_path, mode):
    path = str(tmp_path / "t")
    os.makedirs(path)
    broken = os.path.join(path, "part-0.parquet")
    with open(broken, "wb") as f:
        f.write(b"PAR1 not a table PAR1")
    fresh = spark.range(3).withColumnRenamed("id", "k")
    if mode in ("replace", "append"):
        with pytest.raises(Exception):  # noqa: B017
            landing.land_table(fresh, path, mode, ["k"])
    else:
        with pytest.raises(Exception):  # noqa: B017
            landing.land_table(fresh, path, mode, ["k"]).collect()
    assert os.path.exists(broken)


def test_keys_that_repeat_or_are_null(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k long, v string")
    new = spark.createDataFrame([(1, "z"), (1, "y"), (None, "n"), (4, "q"), (4, "p")], "k long, v string")
    landing.land_table(old, path)
    got = landing.land_table(new, path, "upsert", ["k"]).collect()
    assert sorted((r["k"] or 0, r["v"]) for r in got) == [(0, "n"), (1, "y"), (3, "c"), (4, "p")]
    landing.land_table(old, path)
    got = landing.land_table(new, path, "ignore", ["k"]).collect()
    assert sorted((r["k"] or 0, r["v"]) for r in got) == [(0, "b"), (1, "a"), (3, "c"), (4, "p")]
    assert [f for f in os.listdir(tmp_path) if f != "t"] == []


def test_one_hot_of_300_values(spark):
    df = spark.range(900).select("id", F.format_string("v%03d", F.col("id") % 300).alias("c")).union(spark.sql("select 900L, null"))
    out = encode.one_hot(df, "c")
    rows = {r["id"]: r["c_vector"] for r in out.collect()}
    assert out.columns == ["id", "c_vector"] and rows[7].size == 300
    assert all(list(v.indices) == ([i % 300] if i < 900 else []) for i, v in rows.items())


def test_levels_are_counted_trimmed_and_lowered(spark):
    df = spark.range(400).select(F.concat(F.element_at(F.array(*map(F.lit, ["Low", "medium", "HIGH"])), (F.col("id") % 3 + 1).cast("int")), F.repeat(F.lit(" "), (F.col("id") % 60).cast("int"))).alias("c"))
    r = encode.encoding_profile(df).first()
    assert r["is_ordinal"] and r["n_distinct"] == 60


def test_the_separator_shows_late(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("a;b,c\n" + "1;2,x\n" * 250 + "1;2\n" * 4000)
    assert readers.sniff_separator(spark, str(path), "UTF-8") == ";"


def test_many_classes_stay_features(spark):
    df = spark.range(600).select(F.concat(F.lit("t"), F.floor(F.col("id") / 4)).alias("t"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    got = {r["feature"] for r in automl.feature_importance(df, "y", trees=3).collect()}
    assert got == {"t", "x"}


def test_text_with_many_classes_is_a_feature_and_is_filled(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 90 == 5, None).otherwise(F.format_string("t%03d", (F.col("id") % 3) * 100 + F.col("id") % 120)).alias("wide"),
        F.element_at(F.array(*map(F.lit, ["a", "b", "c"])), (F.col("id") % 3 + 1).cast("int")).alias("g"),
        F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 3).cast("double")).alias("x"),
    )
    got = impute_models.impute_gbt(df, rounds=1) if "rounds" in impute_models.impute_gbt.__code__.co_varnames else impute_models.impute_gbt(df)
    assert got.count() == 900 and got.filter("wide is null or x is null").isEmpty()
    filled = got.filter("wide is not null").join(df.filter("wide is not null").select("wide", "g").distinct(), ["wide", "g"], "left_anti")
    assert filled.isEmpty()  # a fill comes from rows of the same g


def test_choices_do_not_depend_on_size(spark):
    few = spark.range(60).select(F.col("id").cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b"))
    many = spark.range(6000).select(F.col("id").cast("double").alias("a"), (F.col("id") * 7 % 11).cast("double").alias("b"))
    assert outliers.choose_method(few) == outliers.choose_method(many)
    hole = lambda d: d.withColumn("b", F.when(F.col("a") % 9 != 0, F.col("b")))
    assert impute.choose_imputer(hole(few)) == impute.choose_imputer(hole(many))
    votes = [stats.normality_report(d, ["b"]).first()["tests"] for d in (few, many)]
    assert votes[0] == votes[1]
    got = {r["column"]: r["statistic"] for r in stats.shapiro(many.select("a")).collect()}
    assert got == {"a": None}


def test_whole_by_default(spark):
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(30)])
    assert profile.column_summary(wide).count() == 30
    assert len(catalog.template_query(wide, "columns").columns) == 30
    spark.range(20_000).createOrReplaceTempView("twenty_k")
    assert catalog.guarded_sql(spark, "SELECT id FROM twenty_k").count() == 20_000
    assert catalog.guarded_sql(spark, "SELECT id FROM (SELECT id FROM twenty_k LIMIT 100) WHERE 'LIMIT 5' <> ''", limit=7).count() == 7


def test_reserved_words():
    assert names.clean_name("exclusive") == "exclusive" and names.clean_name("select") == "select_col" and len(names.RESERVED) == len(set(names.RESERVED))


def test_spline_blocks_meet(spark):
    df = spark.range(700).select(
        "id",
        (F.col("id") / 230).cast("int").alias("g"),
        F.when(F.col("id") % 3 != 1, F.sin(F.col("id") * 0.3) * 5 + F.pmod(F.col("id") * 7919, F.lit(13))).alias("v"),
    )
    for group in ([], ["g"]):
        whole, cut = (
            {r["id"]: r["v"] for r in impute.impute_spline(df, ["id"], ["v"], group, True, block_rows=n).collect()} for n in (10_000, 103)
        )
        assert set(whole) == set(range(700))
        assert all(abs(whole[i] - cut[i]) < 1e-9 for i in whole)


def test_forest_with_one_value_in_most_rows(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 10 != 0, 5.0).otherwise(F.pmod(F.col("id") * 31, F.lit(101)) / 10.0).alias("x"), F.when(F.col("id") % 10 != 0, 1.0).otherwise(F.pmod(F.col("id") * 17, F.lit(97)) / 50.0).alias("y"))
    got = outlier_models.isolation_forest(df, ["x", "y"], trees=20, contamination=0.05)
    scores = got.groupBy(F.col("id") % 10 != 0).agg(F.avg("score").alias("s"), F.max("is_outlier").alias("o")).collect()
    common = next(r for r in scores if r[0])
    rare = next(r for r in scores if not r[0])
    assert common["s"] < 0.5 < rare["s"] and not common["o"]
