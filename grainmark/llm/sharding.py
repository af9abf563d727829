"""Shards by descending a weighted tree: region, then rack, then shard.

At each level a document draws -ln(u) / weight for every child of the node it has
reached, with u from a hash of its key and the child's name, and goes to the
smallest. A child's weight is the sum of its leaves. A changed weight moves
documents only into or out of the subtree it belongs to. A shard that is added as
a region of its own therefore takes documents only into itself.

Everything is a DataFrame expression. Slots inside a shard come from counts of
(shard, block) and their running sums, never from one window over a shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialise
from .names import free

#: Blocks of hash values in which slots are numbered; a shard's documents spread evenly over them.
BLOCKS = 4096


@dataclass(frozen=True)
class Leaf:
    """A shard, its place and its weight."""

    shard: int
    region: int
    rack: int
    weight: float = 1.0

    def path(self) -> tuple[str, str, str]:
        return f"region {self.region}", f"region {self.region} rack {self.rack}", f"region {self.region} rack {self.rack} shard {self.shard}"


def balanced(shards: int, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """Shards 0 … n-1 dealt evenly to ``racks`` racks in each of ``regions`` regions."""
    return [Leaf(s, s % regions, (s // regions) % racks) for s in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, the next number, as a region of its own."""
    return [*tree, Leaf(max(x.shard for x in tree) + 1, max(x.region for x in tree) + 1, 0, weight)]


def children(tree: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    """For each level, the weight of every child by its parent's name ('' for the top)."""
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for leaf in sorted(tree, key=lambda x: x.shard):
        if leaf.weight <= 0:
            continue
        names = ("", *leaf.path())
        for k in range(3):
            kids = levels[k].setdefault(names[k], {})
            kids[names[k + 1]] = kids.get(names[k + 1], 0.0) + leaf.weight
    return levels


def _draw(key: Column, child: Column, weight: Column) -> Column:
    """-ln(u) / weight, u from 52 bits of an MD5 of the key and the child's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / weight


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("null key"))


def descend(key: Column, tree: list[Leaf]) -> Column:
    """The shard number of a key (as text). Only the children of the reached node draw."""
    at: Column | None = None
    for kids in children(tree):
        table = {p: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in c.items())) for p, c in kids.items()}
        if at is None:
            options = table[""]
        else:
            pairs = [x for p, c in table.items() for x in (F.lit(p), c)]
            options = F.element_at(F.create_map(*pairs), at)
        draws = F.transform(options, lambda c: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
        at = F.array_min(draws)["name"]
    numbers = [x for leaf in tree for x in (F.lit(leaf.path()[2]), F.lit(leaf.shard))]
    return F.element_at(F.create_map(*numbers), at)


def assign(docs: DataFrame, tree: list[Leaf], *, key: str = "doc_id", shard: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row in a last column (with a leading underscore if the name is taken).

    Equal keys share a shard; so do all null keys.
    """
    return docs.withColumn(free(shard, docs.columns), descend(key_text(key), tree))


def place(docs: DataFrame, tree: list[Leaf], larger: list[Leaf], *, key: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """key, size, text_crc32, shard, slot, grown_shard for every row.

    size: UTF-8 bytes of the text plus 1 (a null text: 1, its crc32 that of no
    bytes). slot: gapless from 0 within a shard, by a hash block of key and text,
    then key, then text hash; repeated rows take neighbouring slots. Null keys are
    one key. Other columns are ignored; an empty table gives an empty result.
    """
    tie = F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    k = key_text(key)
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b""))).alias("text_crc32"),
        tie.alias("tie"),
        descend(k, tree).alias("shard"),
        descend(k, larger).alias("grown_shard"),
        (F.conv(F.substring(F.md5(F.concat(k, F.lit("|"), tie)), 1, 8), 16, 10).cast("long") % blocks).cast("int").alias("block"),
    )
    # Repeated rows become one row with a count, combined before the shuffle.
    same = materialise(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")))
    per = same.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(F.col("shard").alias("s"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "block").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x blocks rows are broadcast.
    placed = same.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(
        F.broadcast(base), (F.col("shard") == F.col("s")) & (F.col("block") == F.col("b"))
    )
    each = placed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    slot = F.col("base") + F.col("first") + F.col("copy") - 1
    return each.select(F.col("key").alias(key), "size", "text_crc32", "shard", slot.alias("slot"), "grown_shard")
