import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from grainmark.llm import packing, token_store
from grainmark.llm.suffix_dedup import SpanHash
from grainmark.llm.textbytes import ALNUM, CODES, SOLID, span_hashes, spans, text_slices
from grainmark.llm.tokens import PartTokenizer, encode_column


def test_words_are_those_of_the_patterns():
    texts = ["Ab c1-é", None, "", " xéy ", "\t", "a\nb"] * 3
    for table, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (SOLID, r"[^\x20\x09-\x0D]+")):
        got = []
        for lo, _, buf, off in text_slices(pa.array(texts, pa.string()), 8):
            s, e, r = spans(buf, off, table)
            got += [(int(k) + lo, buf[a:b].tobytes().decode()) for a, b, k in zip(s, e, r)]
        lower = (lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)) if table is ALNUM else (lambda t: t)
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, lower(t or ""))]
        assert [(i, lower(w)) for i, w in got] == want


def test_equal_spans_have_equal_hashes():
    r = random.Random(3)
    buf = np.frombuffer("".join(r.choice("ab ") for _ in range(4000)).encode(), np.uint8)
    s, e, _ = spans(buf, np.array([0, 1500, 4000]), SOLID)
    h, by = span_hashes(buf, s, e, CODES), SpanHash(buf)(s, e, 1)
    for hashes in (h, by):
        words = {}
        for a, b, x in zip(s, e, hashes):
            words.setdefault(buf[a:b].tobytes(), set()).add(int(x))
        assert all(len(v) == 1 for v in words.values()) and len({v for x in words.values() for v in x}) == len(words)


PIECES = ["a", "B", " ", "  ", "\n", " \n", "\t", "'s", "é", "1", "23", ".", "!!", "\x01", "\u0085", "\x1c", "日本", "<|endoftext|>", "Σ", "'LL", "̈", "　", "😀", "“", "-the", "x,y"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_parts_give_the_ids_of_whole_texts(vocabulary, name):
    r = random.Random(1)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 16))) for _ in range(4000)] + [None, "", " "]
    whole = Tokenizer.from_file(vocabulary(name))
    whole.encode_special_tokens = True
    want = [[*e.ids, 1] for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    tok = PartTokenizer(vocabulary(name))
    got = [ids[a:b].tolist() for _, _, ids, at in encode_column(tok, pa.array(texts, pa.string()), 1) for a, b in zip(at, at[1:])]
    assert got == want


def test_packing_puts_every_id_in_one_piece(odd, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    rows = packing.pack(odd, path, size=64).toPandas()
    whole = Tokenizer.from_file(path)
    texts = [r["text"] for r in odd.select("text").collect()]
    want = sorted(tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts)
    rows = rows.sort_values(["sequence_id", "offset"])
    stream, docs, open_ = [], [], []
    for r in rows.itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.sequence_id * 64 + r.offset == len(stream) and r.offset + r.length <= 64
        assert r.start == len(open_)
        stream += ids
        open_ += ids
        if len(open_) == r.doc_tokens:
            docs.append(tuple(open_))
            open_ = []
    assert sorted(docs) == want and not open_
    assert packing.pack(odd.limit(0), path).count() == 0
    assert set(rows["doc_id"].dropna().astype(int)) == {1, 2, 3, 4, 5, 6, 8, 9, 10, 11, -12, 13}


def test_perfect_hash_numbers_its_keys():
    keys = np.random.default_rng(5).integers(0, 2**63, 20_000, dtype=np.uint64)
    keys = np.unique(keys)
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.number(keys).tolist()) == list(range(len(keys)))
    assert token_store.PerfectHash.build(keys[:0]).number(keys).max() == -1


def test_store_gives_back_what_was_written(spark, odd, vocabulary, small):
    path = vocabulary("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, before = {}, 0
    for r in docs:
        ids = np.array([*whole.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want[r["doc_id"]] = (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    table = spark.read.parquet(f"{small}/documents.parquet")
    store = token_store.write(table, token_store.new_folder(spark), path, keys_per_index=40)
    assert store["parts"] == 5 and store["keys"] == 200 and store["ids"] == before
    keys = table.select("doc_id").unionByName(spark.sql("select explode(array(-1L, 10000L, null)) doc_id"))
    places = token_store.lookup(keys, store)
    assert [r["doc_id"] for r in places.where("not found").collect()].count(-1) == 1 and places.where("found").count() == 200
    got = {r["doc_id"]: (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_store.read(places, store).collect()}
    assert got == want


def test_store_keeps_odd_rows(spark, odd, vocabulary):
    path = vocabulary("word_bpe_49k.json")
    store = token_store.write(odd, token_store.new_folder(spark), path)
    places = token_store.lookup(odd.select("doc_id").distinct(), store)
    got = token_store.read(places, store).toPandas()
    assert places.where("not found").count() == 0 and len(got) == odd.count()
    assert (got["doc_id"] == 5).sum() == 2 and got["doc_id"].isna().sum() == 2
    assert got.loc[got["doc_id"] == 1, "n_tokens"].tolist() == [1]
    assert got["n_tokens"].sum() == store["ids"] and got["start"].is_unique
    empty = token_store.write(odd.limit(0), token_store.new_folder(spark), path)
    assert empty["keys"] == 0 and token_store.lookup(odd.select("doc_id"), empty).where("found").count() == 0
    assert token_store.read(token_store.lookup(odd.select("doc_id"), empty), empty).count() == 0
