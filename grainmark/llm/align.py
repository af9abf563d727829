"""Alignment of two tokenizers' tokens of a text, by products of sparse incidence matrices.

A is a byte-level vocabulary of the ``tokenizers`` library, which reads a blank and the
text, B a ``sentencepiece`` model, which puts that blank itself. Each makes a matrix of
tokens by bytes, in compressed rows: a row's columns are the bytes of that token.
Row by row (Gustavson's order) the product A·Bᵀ adds up the bytes two tokens share, so its
entries are the overlap links. Places where tokens of both end cut a text into groups;
the product of the matrices tokens by groups gives the links within groups.

A corpus-wide count of each linked pair of ids needs every document twice. Texts are
encoded once: each slice of a few megabytes keeps its links as numbers of a dictionary of
the slice's own distinct pairs. Only dictionaries meet the counts, in joins by pair and by slice,
so what is shuffled is a small part of the links, and nothing is broadcast but one row per
id of B.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import materialise
from ..functions.ship import ship
from .packing import key_type
from .textbytes import CODES, ranges, span_hashes, text_slices, tidy
from .tokens import PartTokenizer

_BLANK = "▁"
SLICE = 1 << 20
_SHIFT = 32
Csr = tuple[np.ndarray, np.ndarray]  # row pointers, columns


def product(a: Csr, b: Csr, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A·B of two 0/1 matrices in compressed rows: row pointers, ascending columns, values.

    Gustavson: row i of the result is the sum of the rows of B that row i of A names.
    ``columns`` is the number of columns of B.
    """
    (ap, ac), (bp, bc) = a, b
    size = (bp[1:] - bp[:-1])[ac]
    row = np.repeat(np.repeat(np.arange(len(ap) - 1), np.diff(ap)), size)
    key = row * np.int64(columns) + bc[ranges(bp[:-1][ac], size)]
    if len(key) > 1 and (key[1:] < key[:-1]).any():
        key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
    value = np.diff(np.append(first, len(key)))
    key = key[first]
    ptr = np.searchsorted(key, np.arange(len(ap)) * np.int64(columns))
    return ptr, key % max(1, columns), value


def transposed(a: Csr, columns: int) -> Csr:
    ptr, col = a
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    if len(col) and (col[1:] < col[:-1]).any():
        row = row[np.argsort(col, kind="stable")]
    return np.concatenate(([0], np.cumsum(np.bincount(col, minlength=columns)))).astype(np.int64), row


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pieces], np.int64)
    return np.concatenate(([0], np.cumsum(size))), np.frombuffer(b"".join(pieces), np.uint8)


@functools.cache
def _decimals(top: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the decimal digits of 0 … top - 1 start in one string of them, and that string."""
    return _table([b"%d" % i for i in range(top)])


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """Ids of A and the bytes they stand for; texts come with their leading blank."""

    def __init__(self, path: str):
        self.tok = PartTokenizer(path, remembered=0)  # slices are large here
        letters = _byte_letters()
        vocab = self.tok.tok.get_vocab()
        pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            # A special token's own letters are never met as such: their strings are plain text.
            pieces[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.at, self.bytes = _table(pieces)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, at = self.tok.encode(buf, off)
        return ids.astype(np.int64), np.diff(at)


class PieceSide:
    """Ids of B and the bytes they stand for.

    Where no piece holds a blank after another character, a text's ids are those of its
    stretches of blanks and other characters, one after the other, and equal
    stretches of a slice are encoded once. Other models encode whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = []
        self.parts = True
        for i in range(self.sp.get_piece_size()):
            p = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                pieces.append(bytes([int(p[3:5], 16)]))
            else:
                pieces.append(p.replace(_BLANK, " ").encode())
                self.parts = self.parts and _BLANK not in p.lstrip(_BLANK)
        self.at, self.bytes = _table(pieces)
        # A blank alone, the model's own first one apart.
        self.blank = self.sp.piece_to_id(_BLANK)
        self.parts = self.parts and self.sp.encode(" ") == [self.sp.piece_to_id(_BLANK * 2)] and self.sp.encode("a ")[-1:] == [self.blank]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text) of texts that start with a blank, or are empty."""
        n = len(off) - 1
        starts = off[:-1][off[1:] > off[:-1]]
        if self.parts and len(buf):
            gap = buf == 32
            lead = gap.copy()
            lead[1:] &= ~gap[:-1]
            lead[starts] = True
            starts = np.flatnonzero(lead)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        ends = np.append(starts[1:], len(buf))
        _, at, which = np.unique(span_hashes(buf, starts, ends, CODES), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        texts = [raw[s + 1 : e].decode("utf-8", "replace") for s, e in zip(starts[at].tolist(), ends[at].tolist())]
        got = [x or [self.blank] for x in self.sp.encode(texts, num_threads=1)]
        each = np.array([len(x) for x in got], np.int64)
        flat = np.fromiter(itertools.chain.from_iterable(got), np.int64, int(each.sum()))
        size = each[which]
        ids = flat[ranges((np.cumsum(each) - each)[which], size)]
        row = np.searchsorted(off, starts, "right") - 1
        return ids, np.bincount(row, weights=size, minlength=n).astype(np.int64)


def _with_blank(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    filled = off[1:] > off[:-1]
    return np.insert(buf, off[:-1][filled], 32), off + np.concatenate(([0], np.cumsum(filled)))


def _per_row(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    stop = np.cumsum(count)
    return total[stop] - total[stop - count]


class Aligned:
    """The tokens, links and groups of a slice of texts.

    ``a`` and ``b`` are ids, ``a_end`` and ``b_end`` ends of their bytes, counted through the slice,
    ``n_a`` and ``n_b`` tokens by text (none for texts whose two byte strings are not blank + text).
    """

    def __init__(self, left: ByteSide, right: PieceSide, buf: np.ndarray, off: np.ndarray):
        buf, off = _with_blank(buf, off)
        size = np.diff(off)
        sides = [(s, *s.encode(buf, off)) for s in (left, right)]
        good = size > 0
        for side, ids, n in sides:
            good &= _per_row(side.at[ids + 1] - side.at[ids], n) == size
        for side, ids, n in sides:  # equal lengths: compare the bytes of these texts in place
            ids = ids[np.repeat(good, n)]
            told = side.bytes[ranges(side.at[ids], side.at[ids + 1] - side.at[ids])]
            wrong = _per_row(told != buf[np.repeat(good, size)], size[good])
            good[np.flatnonzero(good)[wrong > 0]] = False
        kept = []
        for side, ids, n in sides:
            ids = ids[np.repeat(good, n)]
            kept += [ids, np.cumsum(side.at[ids + 1] - side.at[ids]), np.where(good, n, 0)]
        self.a, self.a_end, self.n_a, self.b, self.b_end, self.n_b = kept
        self.row_bytes = np.where(good, size, 0)
        self.bytes = int(self.a_end[-1]) if len(self.a) else 0
        here, also = (np.zeros(self.bytes + 1, bool) for _ in range(2))
        here[self.a_end] = True
        also[self.b_end] = True
        here &= also
        self.groups = np.cumsum(here)  # by place: ends of groups up to there
        self.group_a, self.group_b = self.groups[self.a_end - 1], self.groups[self.b_end - 1]

    def incidence(self, end: np.ndarray) -> Csr:
        """Tokens by bytes."""
        return np.concatenate(([0], end)), np.arange(self.bytes)

    def grouped(self, end: np.ndarray) -> Csr:
        """Tokens by groups."""
        return np.arange(len(end) + 1), self.groups[end - 1]

    def overlaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, bytes they share) of every pair that shares any: A·Bᵀ."""
        ptr, col, value = product(self.incidence(self.a_end), transposed(self.incidence(self.b_end), self.bytes), len(self.b))
        return np.repeat(np.arange(len(self.a)), np.diff(ptr)), col, value

    def together(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A token, B token, 1) of every pair of one group."""
        ptr, col, value = product(self.grouped(self.a_end), transposed(self.grouped(self.b_end), int(self.groups[-1])), len(self.b))
        return np.repeat(np.arange(len(self.a)), np.diff(ptr)), col, value

    def rows(self, tokens: np.ndarray, side: np.ndarray) -> np.ndarray:
        """The texts of tokens, given the numbers of tokens by text."""
        return np.repeat(np.arange(len(side)), side)[tokens]

    def group_counts(self) -> np.ndarray:
        stop = np.cumsum(self.row_bytes)
        return self.groups[stop] - self.groups[stop - self.row_bytes]

    def group_strings(self) -> list[bytes | None]:
        """By text ``a1,a2|b1;a3|b2,b3``: groups of ids of A and B; None without tokens."""
        ga, gb = self.group_a, self.group_b
        total = int(self.groups[-1])
        before_a, before_b = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=total)))) for g in (ga, gb))
        place_a = np.arange(len(ga)) + before_b[ga]
        place_b = np.arange(len(gb)) + before_a[gb + 1]
        ids = np.empty(len(ga) + len(gb), np.int64)
        mark = np.empty(len(ids), np.uint8)
        for place, group, side, last in ((place_a, ga, self.a, b"|"), (place_b, gb, self.b, b";")):
            ids[place] = side
            mark[place] = np.where(np.append(group[1:] != group[:-1], True)[: len(group)], last[0], ord(","))
        at, digits = _decimals(1 << int(ids.max() if len(ids) else 0).bit_length())
        size = at[ids + 1] - at[ids]
        stop = np.cumsum(size + 1)
        out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
        out[ranges(stop - size - 1, size)] = digits[ranges(at[ids], size)]
        out[stop - 1] = mark
        raw = out.tobytes()
        edge = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        return [raw[s : e - 1] if e > s else None for s, e in zip(edge[:-1], edge[1:])]


def _sides(a_path: str, b_path: str):
    """Both tokenizers, read by a task when it needs them."""
    return ByteSide(a_path), PieceSide(b_path)


def links(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text", within: str = "overlap") -> DataFrame:
    """One row per link: key, a, b (token numbers in the text), a_id, b_id, a_end, b_end (byte ends in blank + text), shared.

    ``within="overlap"`` links tokens that share bytes (``shared`` of them); ``"group"`` links all
    tokens of a group (``shared`` is 1), whose number is the product of the group's two sides.
    Texts without tokens (see ``measures``) have no links.
    """
    if within not in ("overlap", "group"):
        raise ValueError("within is 'overlap' or 'group'")
    kind = key_type(docs, key)
    ship(docs.sparkSession)

    def run(batches):
        sides = _sides(a_path, b_path)
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(1), SLICE):
                x = Aligned(*sides, buf, off)
                i, j, v = x.overlaps() if within == "overlap" else x.together()
                row = x.rows(i, x.n_a)
                first_a, first_b, first = (np.cumsum(c) - c for c in (x.n_a, x.n_b, x.row_bytes))
                numbers = (i - first_a[row], j - first_b[row], x.a[i], x.b[j], x.a_end[i] - first[row], x.b_end[j] - first[row], v)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in numbers)],
                    names=["key", "a", "b", "a_id", "b_id", "a_end", "b_end", "shared"],
                )

    fields = [T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in ("a", "b", "a_id", "b_id", "a_end", "b_end", "shared"))]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), T.StructType(fields))
    return rows.withColumnRenamed("key", key)


def _slices(docs: DataFrame, a_path: str, b_path: str, key: str, text: str) -> DataFrame:
    """One row per slice of texts: its documents' measures, its distinct linked id pairs, and its links as numbers of these."""
    kind = key_type(docs, key)

    def run(batches):
        sides = _sides(a_path, b_path)
        number = TaskContext.get().partitionId() << _SHIFT
        for batch in batches:
            for lo, hi, buf, off in text_slices(batch.column(1), SLICE):
                n = hi - lo
                x = Aligned(*sides, buf, off)
                i, j, _ = x.overlaps()
                same = x.a_end[i] == x.b_end[j]
                i, j = i[same], j[same]
                pairs, which, times = np.unique(x.a[i] << _SHIFT | x.b[j], return_inverse=True, return_counts=True)
                row = x.rows(i, x.n_a)
                columns = [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0).slice(lo, n)),
                    *(
                        pa.array([c.tolist()], pa.list_(pa.int64()))
                        for c in (x.n_a, x.n_b, x.group_counts(), np.bincount(row, minlength=n))
                    ),
                    pa.array([[hashlib.sha256(g).hexdigest() if g is not None else "" for g in x.group_strings()]], pa.list_(pa.string())),
                    pa.array([which.astype(np.int32).tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(pairs, pa.int64())),
                    pa.ListArray.from_arrays(pa.array([0, len(pairs)], pa.int32()), pa.array(times, pa.int64())),
                ]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "key", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs", "times"])

    fields = [T.StructField("slice", T.LongType()), T.StructField("key", T.ArrayType(kind))]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("n_a", "n_b", "n_groups", "n_links")]
    fields += [T.StructField("groups", T.ArrayType(T.StringType())), T.StructField("links", T.BinaryType())]
    fields += [T.StructField(c, T.ArrayType(T.LongType())) for c in ("pairs", "times")]
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), T.StructType(fields))


def measures(docs: DataFrame, a_path: str, b_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    Links here are overlap links whose tokens end together. ``count_sum`` adds, over a text's
    links, how many links of the whole table have the same two ids; ``n_best`` counts those
    whose pair has the highest such count of its id of B. ``groups_sha256`` is the digest of
    ``group_strings``. Texts that are null, empty, or not told back byte for byte by both
    vocabularies have zeros and an empty ``groups_sha256``. Repeated rows count each; other
    columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    done = materialise(_slices(docs, a_path, b_path, key, text))
    met = done.select("slice", F.posexplode(F.arrays_zip("pairs", "times")).alias("at", "x")).select("slice", "at", "x.pairs", "x.times")
    counts = met.groupBy("pairs").agg(F.sum("times").alias("n"))
    counts = materialise(counts.withColumn("b", F.expr(f"pairs & {(1 << _SHIFT) - 1}L")))
    top = counts.groupBy("b").agg(F.max("n").alias("top"))  # one row per id of B
    told = counts.join(F.broadcast(top), "b").select("pairs", "n", (F.col("n") == F.col("top")).alias("best"))
    known = met.select("slice", "at", "pairs").join(told, "pairs")
    known = known.groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("at", "n", "best"))).alias("known"))
    known = known.select(F.col("slice").alias("s"), F.col("known.n").alias("n"), F.col("known.best").cast("array<int>").alias("best"))
    rows = done.select("slice", "links", F.arrays_zip("key", "n_a", "n_b", "n_groups", "n_links", "groups").alias("docs"))
    rows = rows.join(known, F.col("slice") == F.col("s"), "left").select("links", "docs", "n", "best")
    schema = T.StructType([*rows.schema["docs"].dataType.elementType, *(T.StructField(c, T.LongType()) for c in ("n_best", "count_sum"))])

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                inner = b.column("docs").slice(k, 1).flatten()
                which = np.frombuffer(b.column("links")[k].as_py(), np.int32)
                size = inner.field("n_links").to_numpy()
                sums = []
                for c in ("best", "n"):
                    of = b.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    sums.append(pa.array(_per_row(of[which], size)))
                yield pa.RecordBatch.from_arrays([*inner.flatten(), *sums], names=schema.names)

    out = rows.mapInArrow(tidy(run), schema)
    return out.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
