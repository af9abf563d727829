"""Token ids in binary shards with a minimal perfect hash index.

``write`` puts the ids of every document, in ascending key order, into shard files
of raw little-endian unsigned ids (16 bits each if the vocabulary has at most 65,536
entries, else 32), followed by the record lengths and a trailer. The index maps a key to where its ids begin: keys are dealt to index
files by hash, and inside a file a cascade of bit arrays places n keys on the
numbers 0 … n-1 (a key settles at the first level where no other key claims its
bit; its number is the count of settled bits before it). Each slot holds a
fingerprint of its key, so an unknown key is refused, and the record's place. A
lookup reads a few bits and one slot whatever the size of the store.

Files go through Arrow's file systems to the given folder, which all executors
share. A task writes under a name of its own and moves the whole file into place,
so a repeated attempt leaves the same file.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialise, root
from ..functions.ship import ship
from .packing import binary_array, key_type
from .textbytes import mix, tidy
from .tokens import PartTokenizer, encode_column, part_tokenizer

_U = np.uint64
_TRAILER = np.dtype([("magic", "<u8"), ("n_records", "<u8"), ("n_ids", "<u8")])
_MAGIC = 0x31534E454B4F54
SLOT = np.dtype([("fingerprint", "<u4"), ("n_records", "<u4"), ("record", "<u8"), ("start", "<u8"), ("n_ids", "<u8")])


def new_folder(spark: SparkSession) -> str:
    return f"{root(spark)}/grainmark/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _put(folder: str, name: str, write) -> None:
    """Write a file under an attempt's own name, then move it into place."""
    files, path = _open(folder)
    head = f"{path}/{name}"
    files.create_dir(head.rpartition("/")[0], recursive=True)
    own = f"{head}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        result = write(out)
    if files.get_file_info(head).type != pafs.FileType.NotFound:
        files.delete_file(head)
    files.move(own, head)
    return result


def _shard_name(i: int) -> str:
    return f"ids/shard-{i:06d}.bin"


def _index_name(i: int) -> str:
    return f"index/part-{i:06d}.bin"


# --- minimal perfect hash -------------------------------------------------


def _slot_at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(keys + _U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % _U(bits)).astype(np.int64)


class PerfectHash:
    """Numbers 0 … n-1 for n distinct 64-bit keys, about three bits a key."""

    SPREAD = 1.8

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        self.sizes = [len(x) * 8 for x in levels]
        self.ranks = []
        total = 0
        for x in levels:
            c = np.cumsum(np.bitwise_count(x).astype(np.int64))
            self.ranks.append(total + np.concatenate(([0], c[:-1])) if len(x) else np.zeros(0, np.int64))
            total += int(c[-1]) if len(x) else 0
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.asarray(keys, np.uint64), []
        while len(left):
            bits = 8 * max(8, int(np.ceil(cls.SPREAD * len(left) / 8)))
            at = _slot_at(left, len(levels), bits)
            claims = np.bincount(at, minlength=bits)
            levels.append(np.packbits(claims == 1, bitorder="little"))
            left = left[claims[at] != 1]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """A number for each key; -1 where no level has it (then it isn't a key)."""
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, x in enumerate(self.levels):
            if not len(open_):
                break
            at = _slot_at(keys[open_], level, self.sizes[level])
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = (x[byte] >> bit) & 1 == 1
            below = x[byte] & ((np.uint8(1) << bit) - np.uint8(1))
            rank = self.ranks[level][byte] + np.bitwise_count(below)
            out[open_[here]] = rank[here]
            open_ = open_[~here]
        return out


def _write_index(folder: str, part: int, keys: np.ndarray, slots: np.ndarray) -> None:
    h = PerfectHash.build(keys)
    table = np.zeros(len(keys), SLOT)
    table[h.number(keys)] = slots
    head = json.dumps({"n": len(keys), "levels": [len(x) for x in h.levels]}).encode()

    def write(out):
        out.write(np.array([_MAGIC, len(head)], "<u8").tobytes() + head)
        for x in h.levels:
            out.write(x.tobytes())
        out.write(table.tobytes())

    _put(folder, _index_name(part), write)


def _read_index(folder: str, part: int) -> tuple[PerfectHash, np.ndarray]:
    files, path = _open(folder)
    if files.get_file_info(f"{path}/{_index_name(part)}").type == pafs.FileType.NotFound:
        return PerfectHash([]), np.zeros(0, SLOT)
    with files.open_input_file(f"{path}/{_index_name(part)}") as f:
        raw = f.read()
    size = int(np.frombuffer(raw, "<u8", 2)[1])
    head = json.loads(raw[16 : 16 + size])
    at, levels = 16 + size, []
    for n in head["levels"]:
        levels.append(np.frombuffer(raw, np.uint8, n, at))
        at += n
    return PerfectHash(levels), np.frombuffer(raw, SLOT, head["n"], at)


# --- writing ----------------------------------------------------------------


def write(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    keys_per_index: int = 500_000,
) -> dict:
    """Write all documents to ``folder``; returns what ``lookup`` and ``read`` need.

    Documents go in ascending key order, null keys first, equal keys by a hash of
    the text; they keep records of their own, and the index leads to the first of
    them and says how many follow. Null and empty texts are ``end_id`` alone. An
    empty table makes a store without files. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind = key_type(docs, key)
    ship(spark)
    wide = PartTokenizer(vocabulary).tok.get_vocab_size() > 65536 or end_id > 0xFFFF
    width = "<u4" if wide else "<u2"
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches):
        tok = part_tokenizer(vocabulary)
        shard, lengths, done = TaskContext.get().partitionId(), [], []

        def fill(out):
            before = 0
            for b in batches:
                for lo, hi, ids, at in encode_column(tok, b.column(1), end_id):
                    out.write(ids.astype(width).tobytes())
                    lengths.append(np.diff(at))
                    done.append((b.column(0).slice(lo, hi - lo), before + at[:-1], np.diff(at)))
                    before += int(at[-1])
            n = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            out.write(n.astype("<u8").tobytes())
            out.write(np.array([(_MAGIC, len(n), before)], _TRAILER).tobytes())

        first = next(batches, None)
        if first is None:
            return
        batches_ = batches

        def again():
            yield first
            yield from batches_

        batches = again()
        _put(folder, _shard_name(shard), fill)
        record = 0
        for keys, before, n in done:
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.full(len(n), shard, np.int32)), pa.array(record + np.arange(len(n))), pa.array(before), pa.array(n)],
                names=["key", "shard", "record", "before", "n_ids"],
            )
            record += len(n)

    schema = T.StructType(
        [T.StructField("key", kind), T.StructField("shard", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("record", "before", "n_ids")]
    )
    placed = materialise(rows.mapInArrow(tidy(run, keep=True), schema))
    totals = sorted(placed.groupBy("shard").agg(F.count("*"), F.sum("n_ids")).collect())
    base, records, ids = {}, 0, 0
    for s, n, m in totals:  # one row per shard file
        base[s] = (records, ids)
        records, ids = records + n, ids + m
    parts = max(1, -(-records // keys_per_index))
    bases = spark.sparkContext.broadcast(base)
    store = {"folder": folder, "width": width, "parts": parts, "shards": [(s, *base[s]) for s, _, _ in totals], "records": records, "ids": ids}

    def add_base(batches):
        for b in batches:
            s = b.column(1).to_pylist()
            rec = np.array([bases.value[x][0] for x in s], np.int64) + b.column(2).to_numpy()
            start = np.array([bases.value[x][1] for x in s], np.int64) + b.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rec), pa.array(start), b.column(4)], names=["key", "record", "start", "n_ids"])

    schema = T.StructType([T.StructField("key", kind)] + [T.StructField(c, T.LongType()) for c in ("record", "start", "n_ids")])
    entries = (
        placed.mapInArrow(tidy(add_base), schema)
        .groupBy("key")
        .agg(F.min("record").alias("record"), F.min("start").alias("start"), F.sum("n_ids").alias("n_ids"), F.count("*").alias("n"))
        .select(_part(parts).alias("part"), _hash().alias("h"), "record", "start", "n_ids", "n")
    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        slots = np.zeros(len(pdf), SLOT)
        k = pdf["h"].to_numpy().astype(np.int64).view(np.uint64)
        slots["fingerprint"] = (mix(k ^ _U(_MAGIC)) >> _U(32)).astype(np.uint32)
        for a, b in (("n_records", "n"), ("record", "record"), ("start", "start"), ("n_ids", "n_ids")):
            slots[a] = pdf[b].to_numpy()
        _write_index(folder, int(pdf["part"].iloc[0]), k, slots)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [len(pdf)]})

    built = materialise(entries.groupBy("part").applyInPandas(build, "part int, n long"))
    store["keys"] = built.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return store


def _hash():
    return F.xxhash64(F.lit("key"), F.col("key"))


def _part(parts: int):
    return F.pmod(F.xxhash64(F.lit("part"), F.col("key")), F.lit(parts)).cast("int")


# --- reading ----------------------------------------------------------------


def lookup(keys: DataFrame, store: dict, *, key: str = "doc_id") -> DataFrame:
    """Where each key's ids are: key, found, record, start, n_ids, n_records.

    One row per row of ``keys``; an unknown key has found false and nulls (up to a
    chance of 2^-32 that its fingerprint agrees). Each task loads the index files
    of the keys dealt to it.
    """
    kind = key_type(keys, key)
    ship(keys.sparkSession)
    folder, parts = store["folder"], store["parts"]
    rows = keys.select(F.col(key).alias("key")).withColumn("part", _part(parts)).withColumn("h", _hash())
    rows = rows.repartition("part", F.pmod("h", F.lit(32))).sortWithinPartitions("part")

    def run(batches):
        loaded: tuple[int, tuple] = (-1, ())
        for b in batches:
            part = b.column(1).to_numpy()
            h = b.column(2).to_numpy().view(np.uint64)
            out, found = np.zeros(len(part), SLOT), np.zeros(len(part), bool)
            for p in np.unique(part).tolist():
                if loaded[0] != p:
                    loaded = (p, _read_index(folder, p))
                at = np.flatnonzero(part == p)
                number = loaded[1][0].number(h[at])
                hit = number >= 0
                slot = loaded[1][1][number[hit]]
                same = slot["fingerprint"] == (mix(h[at[hit]] ^ _U(_MAGIC)) >> _U(32)).astype(np.uint32)
                out[at[hit][same]] = slot[same]
                found[at[hit][same]] = True
            cols = [pa.array(out[c].astype(np.int64), mask=~found) for c in ("record", "start", "n_ids", "n_records")]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found), *cols], names=["key", "found", "record", "start", "n_ids", "n_records"])

    schema = T.StructType(
        [T.StructField("key", kind), T.StructField("found", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("record", "start", "n_ids", "n_records")]
    )
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)


class _Shards:
    """Reads id ranges and record lengths of the shard files."""

    def __init__(self, store: dict):
        self.files, self.path = _open(store["folder"])
        self.names = [s for s, _, _ in store["shards"]]
        self.first_record = np.array([r for _, r, _ in store["shards"]], np.int64)
        self.first_id = np.array([i for _, _, i in store["shards"]], np.int64)
        self.n_ids = np.diff(np.append(self.first_id, store["ids"]))
        self.n_records = np.diff(np.append(self.first_record, store["records"]))
        self.kind = np.dtype(store["width"])
        self.at, self.file = -1, None

    def _shard(self, i: int):
        if self.at != i:
            self.file = self.files.open_input_file(f"{self.path}/{_shard_name(self.names[i])}")
            self.at = i
        return self.file

    def _range(self, first, sizes, start: int, n: int, width: int, skip) -> bytes:
        out = []
        i = int(np.searchsorted(first, start, "right")) - 1
        while n > 0:
            take = min(n, int(first[i] + sizes[i]) - start)
            if take > 0:
                f = self._shard(i)
                f.seek(skip(i) + width * (start - int(first[i])))
                out.append(f.read(width * take))
                start, n = start + take, n - take
            i += 1
        return b"".join(out)

    def ids(self, start: int, n: int) -> np.ndarray:
        raw = self._range(self.first_id, self.n_ids, start, n, self.kind.itemsize, lambda i: 0)
        return np.frombuffer(raw, self.kind).astype("<u4")

    def lengths(self, record: int, n: int) -> np.ndarray:
        raw = self._range(self.first_record, self.n_records, record, n, 8, lambda i: self.kind.itemsize * int(self.n_ids[i]))
        return np.frombuffer(raw, "<u8").astype(np.int64)


def read(places: DataFrame, store: dict, *, key: str = "doc_id") -> DataFrame:
    """The records at the found places, from the files: key, start, n_tokens, ids binary (32-bit).

    One row per record, so a key with several gives several. Places are dealt by
    where they begin, hence each task reads forward through few files.
    """
    kind = key_type(places, key)
    ship(places.sparkSession)
    rows = places.where("found").select(F.col(key).alias("key"), "record", "start", "n_ids", "n_records")
    rows = rows.repartitionByRange("start").sortWithinPartitions("start")

    def run(batches):
        shards = _Shards(store)
        for b in batches:
            keys, record, start, n_ids, n_records = (b.column(i) for i in range(5))
            record, start, n_ids, n_records = (x.to_numpy() for x in (record, start, n_ids, n_records))
            for lo in range(0, len(record), 512):
                row, starts, sizes, data = [], [], [], []
                for i in range(lo, min(lo + 512, len(record))):
                    one = n_records[i] == 1
                    size = n_ids[i : i + 1] if one else shards.lengths(int(record[i]), int(n_records[i]))
                    row += [i] * len(size)
                    starts.append(start[i] + np.cumsum(size) - size)
                    sizes.append(size)
                    data.append(shards.ids(int(start[i]), int(n_ids[i])))
                size = np.concatenate(sizes)
                ids = np.concatenate(data)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row)), pa.array(np.concatenate(starts)), pa.array(size), binary_array(ids, np.concatenate(([0], np.cumsum(size))))],
                    names=["key", "start", "n_tokens", "ids"],
                )

    schema = T.StructType([T.StructField("key", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)
