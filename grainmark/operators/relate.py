"""Relationships between columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.columns import col, corr, frame, kinds, nan_to_null, number, numeric_columns, report, text_columns, union_all

PAIR = "col_a string, col_b string, method string, strength double, direction string, n long"


def _named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    look = F.array(*[F.lit(n) for n in names])
    at = F.split("pair", ",")
    return df.withColumn("col_a", look[at[0].cast("int")]).withColumn("col_b", look[at[1].cast("int")]).drop("pair")


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, r, n) over pairwise complete rows, all pairs in one pass."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    metrics = {}
    for i, j in combinations(range(len(names)), 2):
        a, b = number(names[i]), number(names[j])
        metrics[f"{i},{j}"] = {"r": corr(a, b), "n": F.count(a + b)}
    if not metrics:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double, n long")
    out = _named(report(df, metrics, label="pair"), names)
    return out.filter((F.col("n") >= 3) & F.col("r").isNotNull() & ~F.isnan("r")).select("col_a", "col_b", "r", "n")


def contingency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col_a, col_b, a, b, n): joint counts of every pair of text columns.

    One scan and one exchange with map-side combining for all pairs.
    """
    df = nan_to_null(df)
    names = list(columns or text_columns(df))
    cells = [
        F.struct(
            F.lit(a).alias("col_a"),
            F.lit(b).alias("col_b"),
            col(a).cast("string").alias("a"),
            col(b).cast("string").alias("b"),
        )
        for a, b in combinations(names, 2)
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, a string, b string, n long")
    rows = df.select(F.inline(F.array(*cells))).filter("a is not null and b is not null")
    return rows.groupBy("col_a", "col_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _digests(c: Column) -> list[Column]:
    """128 bits that stand for a value; null for null."""
    return [F.when(c.isNotNull(), F.xxhash64(c)), F.when(c.isNotNull(), F.xxhash64(F.lit(7), c))]


def _digested(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns h<i> and g<i>, the digests of the i-th name: what is exchanged does not grow with the texts."""
    return df.select(*[x.alias(f"{a}{i}") for i, c in enumerate(names) for a, x in zip("hg", _digests(col(c).cast("string")))])


def frequencies(df: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """Per column (frequency, values, rows): how many values are about so frequent and how many rows hold them.

    Frequencies stand for a 64th of an octave, by the smallest, so a column has a few
    thousand entries at most. Frequencies below 65 are exact.
    """
    df = nan_to_null(df)
    d = _digested(df, columns)
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"h{i}").alias("h"), F.col(f"g{i}").alias("g")) for i in range(len(columns))])
    per = d.select(F.inline(cells)).where("h is not null").groupBy("c", "h", "g").agg(F.count(F.lit(1)).alias("n"))
    step = F.floor(F.log2(F.col("n").cast("double")) * 64)
    rows = per.groupBy("c", step.alias("s")).agg(F.min("n").alias("f"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")).collect()
    out = {c: [] for c in columns}
    for r in rows:
        out[columns[r["c"]]].append((r["f"], r["k"], r["m"]))
    return {c: np.array(sorted(v), float).reshape(-1, 3) for c, v in out.items()}


def largest_v(a: np.ndarray, b: np.ndarray) -> float:
    """No two complete columns of these frequencies have a larger Cramér's V.

    With o rows in a cell of a row total x and a column total y, o <= min(x, y), so chi²/n + 1 =
    sum of o²/(x y) is at most the sum over rows of min(1/x, 1/y), which is largest if
    frequent values of both meet.
    """
    k = min(a[:, 1].sum(), b[:, 1].sum())
    if k <= 1:
        return 0.0
    cuts = np.union1d(np.cumsum(a[:, 2]), np.cumsum(b[:, 2]))
    size = np.diff(np.concatenate(([0], cuts)))
    x, y = (t[np.searchsorted(np.cumsum(t[:, 2]), cuts - 0.5), 0] for t in (a, b))
    most = (size / np.maximum(x, y)).sum() - 1
    return float(np.sqrt(min(1.0, max(0.0, most) / (k - 1))))


def joint_counts(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(col_a, col_b, a, b, n): joint counts of pairs of columns by the digests of their values."""
    df = nan_to_null(df)
    names = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(names)}
    cells = [
        F.struct(F.lit(k).alias("p"), *[F.col(f"{x}{at[c]}").alias(f"{x}{s}") for s, c in zip("ab", p) for x in "hg"]) for k, p in enumerate(pairs)
    ]
    rows = _digested(df, names).select(F.inline(F.array(*cells))).where("ha is not null and hb is not null")
    per = rows.groupBy("p", "ha", "ga", "hb", "gb").agg(F.count(F.lit(1)).alias("n"))
    look = [F.array(*[F.lit(p[s]) for p in pairs])[F.col("p")] for s in (0, 1)]
    return per.select(look[0].alias("col_a"), look[1].alias("col_b"), F.struct("ha", "ga").alias("a"), F.struct("hb", "gb").alias("b"), "n")


def chi_square(cells: DataFrame) -> DataFrame:
    """(col_a, col_b, n, chi2, n_a, n_b) from joint counts."""
    key = ["col_a", "col_b"]
    rows = cells.groupBy(*key, "a").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy(*key, "b").agg(F.sum("n").alias("col_n"))
    share = F.col("n") * F.col("n") / (F.col("row_n").cast("double") * F.col("col_n"))
    terms = cells.join(rows, [*key, "a"]).join(cols, [*key, "b"]).groupBy(*key).agg(
        F.sum("n").alias("n"), F.sum(share).alias("s")
    )
    n_a = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_a"))
    n_b = cols.groupBy(*key).agg(F.count(F.lit(1)).alias("n_b"))
    return (
        terms.join(n_a, key)
        .join(n_b, key)
        .select(*key, "n", (F.col("n") * (F.col("s") - 1)).alias("chi2"), "n_a", "n_b")
    )


def cramers_v_pairs(df: DataFrame, columns: Sequence[str] | None = None, least: float = 0.0) -> DataFrame:
    """(col_a, col_b, v, n) for every pair of text columns whose V can reach ``least``.

    The frequencies of each column's values come first. Pairs of complete columns that they
    bound below ``least`` are never counted jointly, nor are those they decide: a column of
    one value has V 0, one without repeats V 1.
    """
    df = nan_to_null(df)
    names = list(columns or text_columns(df))
    spark = df.sparkSession
    schema = "col_a string, col_b string, v double, n long"
    if len(names) < 2:
        return spark.createDataFrame([], schema)
    n = df.count()
    freq = frequencies(df, names)
    whole = {c for c in names if len(freq[c]) and freq[c][:, 2].sum() == n}
    known, open_ = [], []
    for a, b in combinations(names, 2):
        if not (len(freq[a]) and len(freq[b])):
            continue  # no complete row
        if a in whole and b in whole:
            k = min(freq[a][:, 1].sum(), freq[b][:, 1].sum())
            if k <= 1 or n in (freq[a][:, 1].sum(), freq[b][:, 1].sum()):
                known.append((a, b, 0.0 if k <= 1 else 1.0, n))
                continue
            if largest_v(freq[a], freq[b]) < least:
                continue
        open_.append((a, b))
    out = frame(spark, known, schema)
    if open_:
        x = chi_square(joint_counts(df, open_))
        k = F.least("n_a", "n_b")
        v = F.when((k <= 1) | (F.col("n") <= 1), 0.0).otherwise(
            F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("n") * (k - 1)))
        )
        out = out.unionByName(x.select("col_a", "col_b", v.alias("v"), "n"))
    return out.filter("n >= 3")


def point_biserial_pairs(df: DataFrame) -> DataFrame:
    """(col_a numeric, col_b binary text, r, n); text columns with two values only."""
    df = nan_to_null(df)
    texts = text_columns(df)
    empty = df.sparkSession.createDataFrame([], "col_a string, col_b string, r double, n long")
    if not texts:
        return empty
    s = values.value_summary(df, texts).filter("n_distinct = 2")
    top = {r["column"]: r["s"] for r in s.select("column", "s").collect()}  # one row per column
    nums = numeric_columns(df)
    if not top or not nums:
        return empty
    pairs = list(product(nums, top))
    metrics = {}
    for i, (a, b) in enumerate(pairs):
        x = F.when(col(b).isNotNull(), number(a))
        one, two = F.when(col(b) == top[b], number(a)), F.when(col(b) != top[b], number(a))
        n1, n2 = F.count(one), F.count(two)
        n = n1 + n2
        r = (F.avg(one) - F.avg(two)) / F.stddev_samp(x) * F.sqrt(n1 * n2 / (n * n))
        metrics[str(i)] = {
            "r": F.when((n1 == 0) | (n2 == 0) | (F.stddev_samp(x) == 0), 0.0).otherwise(F.abs(r)),
            "n": n,
        }
    look = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b")) for a, b in pairs])
    out = report(df, metrics, label="pair")
    return out.withColumn("p", look[F.col("pair").cast("int")]).filter("n >= 3").select("p.col_a", "p.col_b", "r", "n")


def detect_relationships(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All pairs whose strength reaches the threshold, strongest first."""

    def shaped(part: DataFrame, method: str, value: str, signed: bool) -> DataFrame:
        direction = (
            F.when(F.col(value) > 0, "positive").otherwise("negative") if signed else F.lit("association")
        )
        return part.select(
            "col_a",
            "col_b",
            F.lit(method).alias("method"),
            F.round(F.abs(value), 4).alias("strength"),
            direction.alias("direction"),
        )

    parts = [
        shaped(pearson_pairs(df), "pearson", "r", True),
        shaped(cramers_v_pairs(df, least=threshold - 1e-4), "cramers_v", "v", False),  # strengths are rounded
        shaped(point_biserial_pairs(df), "point_biserial", "r", False),
    ]
    out = union_all(parts).filter(F.col("strength") >= threshold)
    return out.orderBy(F.desc("strength"), "col_a", "col_b")


def network_nodes(df: DataFrame) -> DataFrame:
    df = nan_to_null(df)
    kind = F.create_map(
        *[F.lit(x) for c, k in kinds(df).items() for x in (c, "numeric" if k == "numeric" else "categorical")]
    )
    return values.value_summary(df).select(
        F.col("column").alias("id"),
        F.element_at(kind, F.col("column")).alias("type"),
        F.col("n_distinct").alias("n_unique"),
        "n_missing",
    )


def network_edges(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    e = detect_relationships(df, threshold)
    return e.select(
        F.col("col_a").alias("source"),
        F.col("col_b").alias("target"),
        "method",
        "strength",
        "direction",
        F.round(F.col("strength") * 10, 1).alias("weight"),
    )


def network_summary(edges: DataFrame) -> DataFrame:
    s = F.col("strength")
    return edges.agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.count(F.when(s >= 0.7, 1)).alias("strong"),
        F.count(F.when((s >= 0.5) & (s < 0.7), 1)).alias("moderate"),
        F.count(F.when(s < 0.5, 1)).alias("weak"),
    )


def strongest(edges: DataFrame, k: int = 5) -> DataFrame:
    return edges.orderBy(F.desc("strength"), "source", "target").limit(k)
