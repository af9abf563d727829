"""Small literal tables with known facts."""

import pytest

from grainmark.operators import advise, clean, contracts, drift, features, impute, impute_models, profile, relate
from grainmark.plans import flow
from grainmark.sources import catalog, landing, names, readers

PEOPLE = [
    ("Alice", 25.0, 3000.0, "Algiers"),
    ("Bob", None, 4500.0, "Oran"),
    ("Carol", 31.0, None, "Algiers"),
    ("Dave", 28.0, 3800.0, None),
    ("Alice", 25.0, 3000.0, "Algiers"),
]
PRODUCTS = [("Laptop", 999, 5), ("Phone", 499, 10), ("Tablet", 299, 8), ("Watch", 199, 15), ("Keyboard", 79, 20)]
MIX = list(
    zip(
        [1.0, 2.0, None, 4.0, 5.0, 6.0, None, 8.0, 9.0, 10.0],
        [None, 1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, 8.0, 9.0],
        ["cat", "dog", "cat", None, "dog", "cat", "dog", "cat", None, "dog"],
    )
)


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "name string, age double, salary double, city string")


@pytest.fixture
def products(spark):
    return spark.createDataFrame(PRODUCTS, "product string, price long, quantity long")


@pytest.fixture
def mix(spark):
    return spark.createDataFrame(MIX, "A double, B double, C string")


def table(df, key=0):
    return {r[key]: r.asDict() for r in df.collect()}


def test_people_profile(people):
    miss = table(profile.missing_values(people))
    assert {c: r["n_missing"] for c, r in miss.items()} == {"name": 0, "age": 1, "salary": 1, "city": 1}
    assert profile.duplicate_rows(people).first()[0] == 1
    stats = table(profile.basic_stats(people))
    assert stats["name"]["n_distinct"] == 4 and stats["name"]["most_common"] == "Alice"
    assert profile.list_duplicates(people).first()["n_copies"] == 2


def test_people_cleaning(people):
    before = people.count()
    assert clean.remove_duplicates(people).count() == 4
    full = clean.handle_missing(people, "mode")
    assert sum(r["n_missing"] for r in profile.missing_values(full).collect()) == 0
    assert clean.handle_missing(people, "drop").count() < before
    assert people.count() == before


def test_people_readiness_and_preparation(people):
    checks = table(advise.ml_readiness(people))
    assert checks["size"]["status"] in ("warn", "fail")
    out, _log = features.prepare_for_ml(people, "mode")
    assert sum(r["n_missing"] for r in profile.missing_values(out).collect()) == 0
    assert all(t in ("double", "int", "bigint") for _, t in out.dtypes)


def test_products(products):
    assert profile.duplicate_rows(products).first()[0] == 0
    price = table(profile.basic_stats(products))["price"]
    assert price["kind"] == "numeric" and (price["min"], price["max"]) == (79.0, 999.0)
    grade = advise.readiness_grade(advise.ml_readiness(products)).first()
    assert 0 <= grade["score"] <= 100 and grade["grade"] in "ABCDF"
    strengths = [r["strength"] for r in relate.detect_relationships(products, 0.0).collect()]
    assert strengths == sorted(strengths, reverse=True) and strengths
    assert drift.detect_drift(products, products).count() == 0


def test_one_outlier(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 2, 3, 2, 2, 1000)], "value long")
    assert [r["column"] for r in profile.iqr_outlier_report(df).collect()] == ["value"]
    df = spark.createDataFrame([(v,) for v in (4, 4, 5)], "value long")
    assert profile.iqr_outlier_report(df).count() == 0


def test_drift_pair(spark):
    a = spark.createDataFrame([(v,) for v in range(1, 6)], "value long")
    b = spark.createDataFrame([(v,) for v in range(100, 600, 100)], "value long")
    d = drift.detect_drift(a, b)
    assert d.count() >= 1 and drift.drift_verdict(d, 1).first()["severity"] != "none"
    one = spark.createDataFrame([(1, 2), (3, 4)], "a long, b long")
    two = spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "a long, b long, c long")
    assert "schema:column_added" in [r["column"] for r in drift.detect_drift(one, two).collect()]


def test_missing_mix(mix):
    assert impute.analyze_missing(mix).first()["n_missing"] == 6
    mean = impute.impute_simple(mix, "mean")
    assert sum(r["n_missing"] for r in profile.missing_values(mean).collect()) == 0
    # a numeric constant is written as text into text columns
    const = impute.impute_constant(mix, 99)
    audit = table(impute.imputation_audit(mix, const))
    assert sum(r["n_filled"] for r in audit.values()) == 6 and audit["A"]["n_filled"] == 2
    assert const.filter("A = 99").count() == 2
    assert impute.missing_mechanism(mix).first()["mechanism"] in ("MCAR", "MAR", "NONE")


def test_imputer_names(mix):
    for name in ("median", "mode", "zero", "drop"):
        out = impute_models.impute_by_name(mix, name)
        assert sum(r["n_missing"] for r in profile.missing_values(out).collect()) == 0
    with pytest.raises(ValueError):
        impute_models.impute_by_name(mix, "diffusion")


def test_contracts_and_repair(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (2, 5, "b"), (2, 5, None)], "id long, const long, name string")
    found = {r["kind"] for r in contracts.evaluate_contracts(df, max_missing_ratio=0.2).collect()}
    assert {"duplicates", "constant", "missing"} <= found
    df = spark.createDataFrame([(1.0, 9, "a"), (1.0, 9, "a"), (2.0, 9, None), (None, 9, "b")], "x double, const long, cat string")
    out, actions = clean.apply_safe_fixes(df, contracts.evaluate_contracts(df, max_missing_ratio=0.2))
    assert "const" not in out.columns and actions.count() >= 1
    assert sum(r["n_missing"] for r in profile.missing_values(out).collect()) == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "a long, b string")
    assert [r["kind"] for r in contracts.evaluate_contracts(df).collect()] == ["schema"]
    assert profile.duplicate_rows(df).first()[0] == 0
    assert table(profile.null_rates(df))["a"]["null_rate"] is None


def test_latin1_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes("name;city\nJosé;Orán\nAna;Málaga\nToo;many;cells\nShort\n".encode("latin-1"))
    d = readers.read_csv_resilient(spark, str(p))
    rows = [tuple(r) for r in d.df.collect()]
    assert ("José", "Orán") in rows and ("Short", None) in rows and len(rows) == 3
    assert "name" in d.columns and d.warnings


def test_nested_json(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text('{\n "user": {"id": 1, "name": "Zoe"}\n}')
    d = readers.read_json_flat(spark, str(p))
    assert d.df.count() == 1 and all(c.startswith("user") for c in d.columns)


def test_large_csv_is_capped(spark):
    df = spark.range(2100).selectExpr("id AS a", "id * 2 AS b")
    got = readers.cap_rows(df, ["a"], max_rows=1000, sample_rows=500)
    assert got.df.count() == 500 and got.warnings
    assert readers.cap_rows(df, ["a"], max_rows=5000).df.count() == 2100


def test_list_cells(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (3, None)], "a long, b array<long>")
    assert table(profile.basic_stats(df))["b"]["n_distinct"] == 2
    m = spark.createDataFrame([({"k": 1},), ({"k": 1},)], "m map<string,int>")
    assert profile.duplicate_rows(m).first()[0] == 1


def test_names():
    assert names.dedupe_columns([" a", "a", "", "a "]) == ["a", "a_2", "unnamed", "a_3"]
    assert names.clean_column_names(["1 x", "select", "a-b", "a b", "--"]) == ["col_1_x", "select_col", "a_b", "a_b_1", "unnamed"]
    assert names.table_name("/tmp/9 lives.csv") == "t_9_lives"


@pytest.mark.parametrize("sql", ["DROP TABLE x", "SELECT 1; SELECT 2", "SELECT 1 -- x", "SELECT * FROM a WHERE DELETE", "SELECT " + "1" * 10_001])
def test_guard_refuses(sql):
    with pytest.raises(ValueError):
        catalog.check_sql(sql)


def test_guard_limits(spark):
    spark.range(50).createOrReplaceTempView("fifty")
    assert catalog.guarded_sql(spark, "SELECT id FROM fifty", limit=7).count() == 7
    assert catalog.guarded_sql(spark, "SELECT id FROM fifty LIMIT 9", limit=7).count() == 9


def test_custom_rule_forms(people):
    ok = contracts.validate_schema(people, {"age": contracts.Rule(custom=lambda df: [])})
    bad = contracts.validate_schema(people, {"age": contracts.Rule(custom=lambda df: ["too young"])})
    broken = contracts.validate_schema(people, {"age": contracts.Rule(custom=lambda df: 1 / 0)})
    assert [x.first()["outcome"] for x in (ok, bad, broken)] == ["passed", "error", "warning"]


def test_schema_round_trip(people):
    schema = contracts.infer_schema(people)
    again = contracts.schema_from_dict(contracts.schema_to_dict(schema))
    assert again == schema and schema["age"].dtype == "numeric" and not schema["age"].required


def test_upsert_and_ignore(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    for mode, want in (("upsert", {1: "a", 2: "B", 3: "C"}), ("ignore", {1: "a", 2: "b", 3: "C"})):
        path = str(tmp_path / mode)
        landing.land_table(old, path)
        assert {r["k"]: r["v"] for r in landing.land_table(new, path, mode, ["k"]).collect()} == want


def test_flow_goes_on_after_a_failure(people):
    f = flow.Flow()
    f.register("broken", lambda df: df.select("nothing"))
    run = f.run(people, ["broken", "deduplicate", "impute"])
    assert [s[2] for s in run.log] == ["failed", "ok", "ok"]
    assert run.df.count() == 4


def test_constant_columns_do_not_break_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.5)], "a double, b double, c double")
    pairs = {(r["col_a"], r["col_b"]): r["r"] for r in relate.pearson_pairs(df).collect()}
    assert set(pairs) == {("a", "c")} and pairs["a", "c"] > 0.99


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert profile.missing_values(df).first()["n_missing"] == 2
    assert clean.handle_missing(df, "mean").filter("x = 1.0").count() == 3
