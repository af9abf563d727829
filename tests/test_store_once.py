"""The store of fingerprints is collapsed and counted by one exchange."""

from grainmark.operators import fingerprint
from grainmark.workload import QUERIES


def test_the_store_needs_one_exchange_and_no_join(spark):
    plan = QUERIES["fingerprint_store"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    executed = QUERIES["fingerprint_store"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and executed.count("Exchange hashpartitioning") == 1


def test_collapse_counts_sightings(spark):
    store = spark.createDataFrame([("a", 2, 5, "y"), ("a", 1, 3, "x"), ("b", 9, 1, "z")], "fingerprint string, created_at int, ml_score int, source string")
    assert sorted(map(tuple, fingerprint.collapse(store, "n").collect())) == [("a", 1, 5, "x", 2), ("b", 9, 1, "z", 1)]
    assert fingerprint.collapse(store).columns == store.columns
