"""Rows told apart by 128-bit digests, so that whole rows need not be exchanged.

Rows that occur once, usually nearly all, never leave their task: only digests and counts
are exchanged. A bitmap of the repeated digests, of bounded size, marks the rows that may be
repeated; what it marks wrongly is only exchanged in vain. That takes a second pass over the
table, so narrow rows, not much larger than a digest with its count, are exchanged themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col
from .scratch import materialise

_BITS_EACH = 16  # bits of the bitmap per repeated digest, as long as it stays below
_MOST_WORDS = 1 << 20  # 8 MB
_LEAST_WORDS = 1 << 10
NARROW = 128  # bytes


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes over all columns; equal rows (nulls, NaN and both zeros alike) have equal ones."""
    cells = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0).cast(f.dataType)  # the two zeros are one
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        cells.append(c)
    # Hashes pass over nulls, so where they stand is hashed as well.
    gone = [F.concat_ws("", *[F.when(col(f.name).isNull(), "1").otherwise("0") for f in df.schema.fields])]
    return [F.xxhash64(*gone, *cells), F.xxhash64(F.lit(7), *cells, *gone)]


def repeated(df: DataFrame) -> DataFrame:
    """(h, g, n) of the digests that several rows have."""
    h, g = row_digest(df)
    return df.select(h.alias("h"), g.alias("g")).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def may_repeat(df: DataFrame) -> DataFrame | None:
    """``df`` with __may (false: the row surely occurs once), __h and __g; None if no row is repeated."""
    twice = materialise(repeated(df).select("h", "g"))
    n = twice.count()
    if not n:
        return None
    words = _LEAST_WORDS
    while words < _MOST_WORDS and words * 64 < n * _BITS_EACH:
        words *= 2
    place = lambda c: F.pmod(F.col(c), F.lit(words * 64))
    bits = twice.select(F.explode(F.array(place("h"), place("g"))).alias("p"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(64)).cast("int"))
    word = bits.groupBy(F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(mask).alias("m"))  # at most _MOST_WORDS rows
    every = df.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(word, "w", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0).cast("long")).alias("m")))).alias("x"))
    one = materialise(one.select(F.col("x.m").alias("__bits")))  # one row of up to 8 MB
    h, g = row_digest(df)
    marked = df.withColumns({"__h": h, "__g": g}).join(F.broadcast(one))

    def held(c: str) -> Column:
        p = place(c)
        at = F.call_function("shiftright", F.get("__bits", F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int"))
        return at.bitwiseAND(F.lit(1).cast("long")) != 0

    return marked.withColumn("__may", held("__h") & held("__g")).drop("__bits")


def narrow(df: DataFrame) -> bool:
    """Whether rows are small, by their types and the first thousand rows' texts; decides how, not what, is computed."""
    if "map<" in df.schema.simpleString() or "variant" in df.schema.simpleString():
        return False  # not comparable as they are
    fixed, loose = 0, []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            loose.append(F.octet_length(col(f.name)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            loose.append(F.octet_length(F.to_json(col(f.name))))
        else:
            fixed += 8
    if fixed > NARROW or not loose:
        return fixed <= NARROW
    size = df.limit(1000).agg(F.avg(sum((F.coalesce(x, F.lit(0)) for x in loose[1:]), F.coalesce(loose[0], F.lit(0))))).first()[0]
    return fixed + 16 * len(loose) + (size or 0) <= NARROW


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each row; of rows that are not narrow only those that may be repeated are exchanged."""
    if narrow(df):
        return df.dropDuplicates()
    marked = may_repeat(df)
    if marked is None:
        return df
    names = [col(c) for c in df.columns]
    once = marked.where(~F.col("__may")).select(*names)
    return once.unionByName(marked.where("__may").dropDuplicates(["__h", "__g"]).select(*names))
