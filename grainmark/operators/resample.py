"""Synthetic minority rows and boundary cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scratch, values
from ..functions.columns import col, nan_to_null, number, numeric_columns, union_all
from .neighbours import knn


def _features(df: DataFrame, target: str, key: str, columns: Sequence[str] | None) -> list[str]:
    return [c for c in (columns or numeric_columns(df)) if c not in (target, key)]


def _synthesise(part: DataFrame, key: str, names: Sequence[str], target: str, label: object, counts: DataFrame, k: int, seed: int) -> DataFrame:
    """``counts`` (lid, m): how many new rows start from each minority row."""
    nn = scratch.materialise(knn(part, None, key, names, k).select("lid", "rid", "place"))
    have = nn.groupBy(F.col("lid")).agg(F.max("place").alias("k"))
    start = counts.join(have, "lid").filter("m > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    pick = F.pmod(F.xxhash64(F.lit(seed), "lid", "i"), F.col("k")).cast("int") + 1
    chosen = start.withColumn("place", pick).join(nn, ["lid", "place"])
    base = part.select(col(key).cast("long").alias("lid"), *[number(c).alias(f"a{i}") for i, c in enumerate(names)])
    other = part.select(col(key).cast("long").alias("rid"), *[number(c).alias(f"b{i}") for i, c in enumerate(names)])
    gap = F.pmod(F.xxhash64(F.lit(seed + 1), "lid", "i"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    both = chosen.join(base, "lid").join(other, "rid").withColumn("g", gap)
    made = [(F.col(f"a{i}") + F.col("g") * (F.col(f"b{i}") - F.col(f"a{i}"))).alias(c) for i, c in enumerate(names)]
    return both.select(*made, F.lit(label).alias(target), F.lit(True).alias("synthetic"))


def _shares(ids: DataFrame, need: int) -> DataFrame:
    """Spread ``need`` new rows evenly over the given starting rows (lid)."""
    placed = values.with_position(ids, ["lid"], "p")
    n = max(ids.count(), 1)
    return placed.select("lid", (F.lit(need // n) + (F.col("p") < need % n).cast("long")).alias("m"))


def smote(df: DataFrame, target: str, key: str, columns: Sequence[str] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """Every class grown to the size of the largest by points between neighbours."""
    df = nan_to_null(df)
    names = _features(df, target, key, columns)
    # Written once: the sizes, the neighbours and both ends of every new row are read off it.
    rows = scratch.materialise(df.na.drop("any", subset=[*names, target]).select(key, *names, target))
    sizes = {r[0]: r["n"] for r in rows.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    most = max(sizes.values())
    parts = [rows.select(*[number(c).alias(c) for c in names], col(target), F.lit(False).alias("synthetic"))]
    for label, n in sizes.items():
        if n == most or n < 2:
            continue
        part = rows.filter(col(target) == label)
        counts = _shares(part.select(col(key).cast("long").alias("lid")), most - n)
        parts.append(_synthesise(part, key, names, target, label, counts, min(k, n - 1), seed))
    return union_all(parts)


def adasyn(df: DataFrame, target: str, key: str, columns: Sequence[str] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """Like SMOTE, but rows surrounded by other classes start more new rows."""
    df = nan_to_null(df)
    names = _features(df, target, key, columns)
    rows = scratch.materialise(df.na.drop("any", subset=[*names, target]))
    sizes = {r[0]: r["n"] for r in rows.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    most = max(sizes.values())
    label_of = rows.select(col(key).cast("long").alias("rid"), col(target).alias("other"))
    parts = [rows.select(*[number(c).alias(c) for c in names], col(target), F.lit(False).alias("synthetic"))]
    for label, n in sizes.items():
        if n == most or n < 2:
            continue
        part = rows.filter(col(target) == label)
        # neighbours in the whole table: keys are unique, so a row is dropped from its own list
        nn = knn(part, rows, key, names, k + 1).filter("lid != rid")
        hard = nn.join(label_of, "rid").groupBy("lid").agg(F.avg((F.col("other") != F.lit(label)).cast("double")).alias("h"))
        hard = scratch.materialise(hard)
        total = hard.agg(F.sum("h")).first()[0] or 0.0
        if total == 0:
            counts = _shares(part.select(col(key).cast("long").alias("lid")), most - n)
        else:
            counts = hard.select("lid", F.round(F.col("h") / F.lit(total) * (most - n)).cast("long").alias("m"))
        parts.append(_synthesise(part, key, names, target, label, counts, min(k, n - 1), seed))
    return union_all(parts)


def tomek_links(df: DataFrame, target: str, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(lid, rid): mutual nearest neighbours of different classes, lid < rid."""
    df = nan_to_null(df)
    names = _features(df, target, key, columns)
    rows = df.na.drop("any", subset=[*names, target])
    nn = scratch.materialise(knn(rows, None, key, names, 1).select("lid", "rid"))
    back = nn.select(F.col("lid").alias("rid"), F.col("rid").alias("lid"))
    mutual = nn.join(back, ["lid", "rid"]).filter("lid < rid")
    label = rows.select(col(key).cast("long").alias("id"), col(target).alias("y"))
    a = label.select(F.col("id").alias("lid"), F.col("y").alias("ya"))
    b = label.select(F.col("id").alias("rid"), F.col("y").alias("yb"))
    return mutual.join(a, "lid").join(b, "rid").filter("ya != yb").select("lid", "rid")


def smote_tomek(df: DataFrame, target: str, key: str, columns: Sequence[str] | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE, then both rows of every Tomek link removed."""
    names = _features(nan_to_null(df), target, key, columns)
    grown = scratch.materialise(smote(df, target, key, names, k, seed))
    numbered = scratch.materialise(values.with_position(grown, [target, *names, "synthetic"], "__id"))
    links = tomek_links(numbered, target, "__id", names)
    ends = links.select(F.col("lid").alias("__id")).unionByName(links.select(F.col("rid").alias("__id")))
    return numbered.join(ends, "__id", "left_anti").drop("__id")
