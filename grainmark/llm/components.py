"""Connected components by minimum labels and pointer jumping, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialise, temporary


def components(links: DataFrame) -> DataFrame:
    """(v, l): every end of ``links`` (a, b) with the smallest end of its component.

    A vertex with very many links only meets joins that Spark can split and minima
    that are combined before the shuffle. Rounds grow like the logarithm of the
    longest way through a component.
    """
    with temporary(links.sparkSession) as kept:
        both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
        known = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("l")))
        while True:
            # The smallest label around a vertex, then that label's own label.
            near = both.join(known.withColumnsRenamed({"v": "b", "l": "m"}), "b").groupBy(F.col("a").alias("v")).agg(F.min("m").alias("m"))
            lower = known.join(near, "v").select("v", F.least("l", "m").alias("k"), F.col("l").alias("was"))
            jump = known.select(F.col("v").alias("k"), F.col("l").alias("j"))
            new = materialise(lower.join(jump, "k").select("v", F.least("j", "k").alias("l"), "was"))
            known = new.select("v", "l")
            if not new.where("l != was").limit(1).count():
                kept.append(new)
                return known


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (v, l) after more ``links`` (a, b): only their components' graph is walked."""
    if labels is None:
        return components(links)
    a, b = (labels.select(F.col("v").alias(c), F.col("l").alias(f"l{c}")) for c in ("a", "b"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a != b")
    over = components(between)
    moved = over.select(F.col("v").alias("l"), F.col("l").alias("to"))
    old = labels.join(moved, "l", "left").select("v", F.coalesce("to", "l").alias("l"))
    fresh = over.join(labels.select("v"), "v", "left_anti")
    return materialise(old.unionByName(fresh))
