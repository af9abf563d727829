"""Advice of several kinds rests on one set of value counts."""

from pyspark.sql import functions as F

from grainmark.operators import advise, profile


def _table(spark):
    return spark.range(400).selectExpr(
        "id AS row_id", "CASE WHEN id % 50 = 0 THEN 9000.0D ELSE CAST(id % 9 AS DOUBLE) END AS a", "CASE WHEN id % 7 > 0 THEN concat('t', id) END AS words", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS label"
    )


def test_counts_and_duplicates_once(spark, monkeypatch):
    seen = []
    for module, name in ((advise.values, "typed_counts"), (profile, "duplicate_rows"), (profile, "iqr_outlier_report")):
        fn = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, fn=fn, name=name, **k: seen.append((name, len(df.columns))) or fn(df, *a, **k))
    monkeypatch.setattr(advise.relate, "detect_relationships", lambda df, *_: df.limit(0))
    advise.analyst_report(_table(spark)).collect()
    assert seen.count(("typed_counts", 4)) == 1 and seen.count(("duplicate_rows", 4)) == 1 and ("iqr_outlier_report", 4) not in seen


def test_same_as_the_single_reports(spark):
    df = _table(spark)
    known = advise.measured(df)
    assert known.n_out == profile.iqr_outlier_report(df).count() == 1
    assert known.n_duplicates == 0 and known.facts["words"]["n_missing"] == 58
    assert [c for c, f in known.facts.items() if advise._is_id(c, f)] == [r[0] for r in advise.id_columns(df).collect()] == ["row_id"]
    assert [c for c in ("words", "label") if advise._is_wide(known.facts[c])] == [r[0] for r in advise.high_cardinality_text(df).collect()] == ["words"]
    got = {r["finding"]: r["measured"] for r in advise.analyst_report(df).collect()}
    assert got["identifier columns"] == 1 and got["possible leakage"] == 2 == advise.leakage_hints(df).count()


def test_no_rows(spark):
    df = _table(spark).where(F.lit(False))
    assert advise.ml_readiness(df).count() == 6 and advise.analyst_report(df).count() > 0
