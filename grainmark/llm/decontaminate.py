"""Benchmark passages in training text by suffix arrays over shards of the text.

Each task cuts its documents into shards of a few megabytes and builds, per shard,
the suffix array of the word positions from which a match could start: positions
followed by enough words that the benchmark has at all. Every suffix of every
benchmark item is then binary-searched in the shard's array by its first
``window`` words (all of them for a shorter item), which gives an interval of
training positions that hold the same words; neighbouring hits on one diagonal
join to the longest verbatim matches. Documents never leave their task, so there
is no shuffle, and copies or popular passages don't meet anywhere.

The benchmark is the fixed side: it is taken in blocks of bounded size, each
broadcast in turn, and every block passes over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import ship
from .names import free
from .textbytes import ALNUM, CODES_LOWER, ranges, span_hashes, spans, text_slices, tidy

#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 32 << 20


def _words(buf, off):
    s, e, rows = spans(buf, off, ALNUM)
    return span_hashes(buf, s, e, CODES_LOWER), rows


class TestSuffixes:
    """The benchmark block's suffixes: word numbers, padded with -1 behind an item's end.

    ``item``: index of the suffix's item, ``at``: its first word, ``size``: words to
    compare. Only suffixes with a whole window are searched.
    """

    def __init__(self, texts: list[str | None], window: int):
        column = pa.array([t or "" for t in texts], pa.string())
        hashes, items = [], []
        for lo, _, buf, off in text_slices(column):
            h, r = _words(buf, off)
            hashes.append(h)
            items.append(r + lo)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        item = np.concatenate(items) if items else np.zeros(0, np.int64)
        self.window = window
        self.vocabulary, word = np.unique(h, return_inverse=True)
        total = np.bincount(item, minlength=len(texts))
        first = np.cumsum(total) - total
        place = np.arange(len(h)) - first[item]
        size = np.minimum(total[item], window)
        keep = place + size <= total[item]
        self.item, self.at, self.size = item[keep], place[keep], size[keep]
        start = np.flatnonzero(keep)
        at = start[:, None] + np.arange(window)[None, :]
        inside = np.arange(window)[None, :] < self.size[:, None]
        padded = np.append(word, -1).astype(np.int32)
        self.words = np.where(inside, padded[np.minimum(at, len(word))], -1).astype(np.int32)
        order = np.lexsort(self.words.T[::-1]) if len(self.words) else np.zeros(0, np.int64)
        self.item, self.at, self.size, self.words = self.item[order], self.at[order], self.size[order], self.words[order]
        self.shortest = int(self.size.min()) if len(self.size) else window


def suffix_array(word: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``starts`` in the order of their first ``depth`` words, and those words.

    -1 ends a suffix: a foreign word or the end of the document.
    """
    padded = np.append(word, np.full(depth, -1, word.dtype))
    columns = padded[starts[:, None] + np.arange(depth)[None, :]]
    ended = np.minimum.accumulate(columns, axis=1) < 0
    columns[ended] = -1
    order = np.lexsort(columns.T[::-1])
    return starts[order], columns[order]


def _compare(suffix: np.ndarray, test: np.ndarray, size: np.ndarray) -> np.ndarray:
    """-1, 0, 1 as each suffix's first ``size`` words are below, equal to or above the test's."""
    differ = (suffix != test) & (np.arange(test.shape[1])[None, :] < size[:, None])
    any_ = differ.any(axis=1)
    k = differ.argmax(axis=1)
    i = np.arange(len(test))
    return np.where(any_, np.sign(suffix[i, k] - test[i, k]), 0)


def search(columns: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """The interval of the suffix array that starts with each test suffix."""
    n, m = len(columns), len(tests.words)
    bounds = []
    for upper in (False, True):
        lo, hi = np.zeros(m, np.int64), np.full(m, n, np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            c = _compare(columns[mid], tests.words[open_], tests.size[open_])
            below = c <= 0 if upper else c < 0
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        bounds.append(lo)
    return bounds[0], bounds[1]


def shard_matches(buf: np.ndarray, off: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, ...]:
    """Longest matches of one shard: (words of each document, document, first word, item, item's word, length)."""
    h, rows = _words(buf, off)
    total = np.bincount(rows, minlength=len(off) - 1).astype(np.int64)
    none = np.zeros(0, np.int64)
    if not len(h) or not len(tests.words):
        return total, none, none, none, none, none
    at = np.searchsorted(tests.vocabulary, h)
    at[at == len(tests.vocabulary)] = 0
    word = np.where(tests.vocabulary[at] == h, at, -1).astype(np.int32)
    # A separator behind every document; words of a known run from here on.
    first = np.cumsum(total) - total
    word = np.insert(word, first + total, np.int32(-1))
    stop = np.flatnonzero(word < 0)
    run = stop[np.searchsorted(stop, np.arange(len(word)))] - np.arange(len(word))
    starts = np.flatnonzero(run >= tests.shortest)
    if not len(starts):
        return total, none, none, none, none, none
    place, columns = suffix_array(word, starts, tests.window)
    lo, hi = search(columns, tests)
    t = np.repeat(np.arange(len(lo)), hi - lo)
    p = place[ranges(lo, hi - lo)]
    begin = first + np.arange(len(first))  # of each document, separators counted
    doc = np.searchsorted(begin, p, "right") - 1
    item, where, size = tests.item[t], tests.at[t], tests.size[t]
    # One diagonal: same document, same item, same distance; the next hit goes on where this one is.
    order = np.lexsort((where, p - where, item, doc))
    doc, item, where, size, p = doc[order], item[order], where[order], size[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (p[1:] != p[:-1] + 1) | (where[1:] != where[:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    length = p[tail] + size[tail] - p[head] if len(head) else none
    return total, doc[head], p[head] - begin[doc[head]], item[head], where[head], length


MATCH = pa.struct([("item", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])
MATCH_SQL = "array<struct<item:bigint,item_word:bigint,doc_word:bigint,n_words:bigint>>"


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Blocks of (item ids as given, texts) of at most about ``block_bytes``."""
    rows, size = [], 0
    for r in benchmark.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).where("text is not null").toLocalIterator():
        rows.append(r)
        size += 4 * len(r["text"])
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def find_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with _n_words long and _matches, all longest verbatim matches of a window or more.

    A match has item (the item_id as given, integers only), item_word, doc_word and
    n_words, all counted in words from 0. Words are runs of letters and digits, A-Z
    lowered. An item of fewer words than the window matches as a whole. Null texts
    and null items have no words; repeated items match each for itself; an empty
    benchmark or table gives empty matches. All columns of ``docs`` stay; where one has
    the name of an added one, the added one, always last, gets one more underscore.
    """
    n_words, matches = free("_n_words", docs.columns), free("_matches", docs.columns)
    spark = docs.sparkSession
    ship(spark)
    out = docs.withColumns({n_words: F.lit(None).cast("long"), matches: F.array().cast(MATCH_SQL)})
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    rows = next(blocks, [])
    while True:
        # One pass per block over the documents, each adding its matches.
        ids = spark.sparkContext.broadcast([r["item"] for r in rows])
        tests = spark.sparkContext.broadcast(TestSuffixes([r["text"] for r in rows], window))
        out = _pass(out, text, ids, tests)
        rows = next(blocks, None)
        if rows is None:
            return out


def _pass(docs: DataFrame, text: str, ids, tests) -> DataFrame:
    names = docs.columns
    t, w, m = names.index(text), len(names) - 2, len(names) - 1

    def run(batches):
        known = np.array(ids.value, dtype=object)
        for b in batches:
            column = b.column(t)
            for lo, hi, buf, off in text_slices(column):
                total, doc, at, item, where, length = shard_matches(buf, off, tests.value)
                part = b.slice(lo, hi - lo)
                order = np.lexsort((where, item, at, doc))
                doc, at, item, where, length = (x[order] for x in (doc, at, item, where, length))
                n = np.bincount(doc, minlength=hi - lo)
                values = pa.StructArray.from_arrays(
                    [pa.array(known[item].tolist(), pa.int64()), pa.array(where, pa.int64()), pa.array(at, pa.int64()), pa.array(length, pa.int64())],
                    fields=list(MATCH),
                )
                old = part.column(m)
                if len(old.flatten()):
                    lists = [(x or []) + values.slice(s, c).to_pylist() for x, s, c in zip(old.to_pylist(), np.cumsum(n) - n, n)]
                    found = pa.array(lists, pa.list_(MATCH))
                else:
                    found = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), values)
                cols = list(part.columns)
                cols[w], cols[m] = pa.array(total), found
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(tidy(run), docs.schema)


def hit_words(matches: str):
    """Words inside any match: the length of the union of the matches' word ranges."""
    # Matches ascend by doc_word within a block; sorted again in case there were several.
    spans_ = F.array_sort(F.transform(matches, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans_,
        zero,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["b"]).alias("end"),
            (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"),
        ),
        lambda s: s["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_matches`` with _n_hit long, _items (distinct item ids) and _contaminated boolean, named and placed alike."""
    found = find_matches(docs, benchmark, **options)
    matches = found.columns[-1]
    n_hit, items, hit = (free(c, found.columns) for c in ("_n_hit", "_items", "_contaminated"))
    found = found.withColumns({n_hit: hit_words(matches), items: F.array_distinct(F.transform(matches, lambda m: m["item"]))})
    return found.withColumn(hit, F.col(n_hit) > 0)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window, with the columns they had."""
    found = find_matches(docs, benchmark, **options)
    return found.where(F.size(found.columns[-1]) == 0).select(*docs.columns)
