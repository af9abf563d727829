"""Concatenate and cut: every token in exactly one piece of a fixed window.

The documents, in the order of their partitions, are one long run of ids. Two
passes place it: each task counts the ids before every document inside its
partition, then a prefix sum over the partition totals (one number per
partition) gives global offsets. Windows of ``size`` ids are cut from the run;
a document that crosses a window border becomes one boundary record per window.
Only the last window is not full.

The ids are written once below ``spark.checkpoint.dir``, so partition numbers and
offsets stay what they are when executors are lost. No row is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialise
from ..functions.ship import ship
from .textbytes import ranges, tidy
from .tokens import encode_column, part_tokenizer

_TYPES = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.ShortType: pa.int16(), T.BinaryType: pa.binary()}


def key_type(df: DataFrame, key: str) -> T.DataType:
    kind = df.schema[key].dataType
    if type(kind) not in _TYPES:
        raise TypeError(f"{key}: a key is an integer, a string or binary, not {kind.simpleString()}")
    return kind


def binary_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary value per row: the little-endian bytes of values[offsets[i]:offsets[i+1]]."""
    values = np.ascontiguousarray(values)
    at = (offsets * values.itemsize).astype(np.int64)
    if at[-1] >= 2**31:
        raise ValueError("a slice of texts holds over 2 GB of ids")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(values)])


def encode_documents(docs: DataFrame, vocabulary: str, *, key: str, text: str, end_id: int | None) -> DataFrame:
    """Ids of every text with its place in its partition.

    Returns key, part int, before long (ids of the partition before it),
    n_tokens long, ids binary (unsigned 16-bit when ``wide`` is false, else 32-bit),
    wide boolean.
    """
    kind = key_type(docs, key)
    ship(docs.sparkSession)

    def run(batches):
        tok = part_tokenizer(vocabulary)
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            column = b.column(1)
            for lo, hi, ids, at in encode_column(tok, column, end_id):
                wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, n),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(before + at[:-1]),
                        pa.array(np.diff(at)),
                        binary_array(ids if wide else ids.astype("<u2"), at),
                        pa.array(np.full(n, wide)),
                    ],
                    names=["key", "part", "before", "n_tokens", "ids", "wide"],
                )
                before += int(at[-1])

    schema = T.StructType(
        [
            T.StructField("key", kind),
            T.StructField("part", T.IntegerType()),
            T.StructField("before", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("wide", T.BooleanType()),
        ]
    )
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run, keep=True), schema)


def partition_bases(table: DataFrame, part: str, amount: str) -> dict[int, int]:
    """The sum of ``amount`` over all earlier partitions: one number per partition."""
    out, total = {}, 0
    for p, n in sorted(table.groupBy(part).agg(F.sum(amount)).collect()):
        out[p] = total
        total += n
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    size: int = 2048,
    end_id: int | None = 1,
) -> DataFrame:
    """Pieces of sequences of ``size`` ids.

    Returns key, start (the document's ids before the piece), length, doc_tokens,
    sequence_id, offset (place in the sequence), ids binary (little-endian unsigned
    32-bit). A null or empty text has only ``end_id`` (no piece if that is None).
    Equal keys and repeated rows are packed as documents of their own; a null key
    stays null. An empty table gives no piece. Other columns are ignored.
    """
    kind = key_type(docs, key)
    table = materialise(encode_documents(docs, vocabulary, key=key, text=text, end_id=end_id))
    base = docs.sparkSession.sparkContext.broadcast(partition_bases(table, "part", "n_tokens"))

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            place = np.array([base.value[p] for p in b.column(1).to_pylist()], np.int64) + b.column(2).to_numpy()
            count = b.column(3).to_numpy()
            last = np.where(count > 0, (place + count - 1) // size, -1)
            first = place // size
            pieces = np.where(count > 0, last - first + 1, 0)
            row = np.repeat(np.arange(n), pieces)
            seq = ranges(first, pieces)
            begin = np.maximum(place[row], seq * size)
            end = np.minimum((place + count)[row], (seq + 1) * size)
            # All ids of the batch, in row order, are cut at the pieces' ends.
            parts = [np.frombuffer(v.as_buffer(), "<u4" if w else "<u2").astype("<u4") for v, w in zip(b.column(4), b.column(5).to_pylist())]
            ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            length = end - begin
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row)),
                    pa.array(begin - place[row]),
                    pa.array(length),
                    pa.array(count[row]),
                    pa.array(seq),
                    pa.array(begin - seq * size),
                    binary_array(ids, np.concatenate(([0], np.cumsum(length)))),
                ],
                names=["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    schema = T.StructType(
        [T.StructField("key", kind)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.BinaryType())]
    )
    cut = table.select("key", "part", "before", "n_tokens", "ids", "wide").mapInArrow(tidy(run), schema)
    return cut.withColumnRenamed("key", key)
