import hashlib
import random
import re
from collections import Counter

import numpy as np
from conftest import WORDS, prose

import corpus_pipeline
from grainmark.functions.scratch import materialise
from grainmark.llm import minhash, suffix_dedup
from grainmark.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def classes(texts):
    """doc -> smallest doc of its class, by all pairs."""
    top = {i: i for i in texts}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(i for i in texts if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def near_copies():
    r = random.Random(4)
    texts = {}
    for g in range(12):
        base = prose(g, 150 + 40 * g).split()
        for c in range(r.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(r.randint(0, 2 + len(copy) // 60)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            texts[len(texts)] = " ".join(copy)
        texts[len(texts)] = " ".join(base[: len(base) // 2]) + " " + prose(100 + g, 90)
    return texts


def test_near_duplicates_equal_all_pairs(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()}
    assert got == classes(texts)
    kept = {r["doc_id"] for r in minhash.one_of_each(docs).collect()}
    assert kept == set(classes(texts).values())


def test_a_large_group_of_near_copies_is_one_class(spark):
    r = random.Random(9)
    base = prose(77, 120).split()
    rows = []
    for i in range(600):
        copy = list(base)
        copy[r.randrange(len(copy))] = f"own{i}"
        rows.append((i, " ".join(copy)))
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got["class_id"]) == {0} and set(got["class_size"]) == {600} and got["kept"].sum() == 1


def test_copies_of_one_text_meet_few_leaders(spark, monkeypatch):
    r = random.Random(10)
    base = prose(78, 200).split()
    texts = {0: " ".join(base)}
    for i in range(1, 400):
        copy = list(base)
        for j in r.sample(range(200), 3):  # near the base, not near each other
            copy[j] = f"own{i}x{j}"
        texts[i] = " ".join(copy)
    seen = []
    estimate = minhash._estimate

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return estimate(pairs, *rest)

    monkeypatch.setattr(minhash, "_estimate", counted)
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == classes(texts)
    assert sum(seen) < 5 * len(texts)  # leaders drawn by hash in each bucket: 34,288 pairs


def test_copies_whose_passage_repeats_are_linked(spark):
    texts = {}
    for g in range(6):
        w = prose(300 + g, 104).split()
        texts[2 * g] = " ".join(w)
        texts[2 * g + 1] = " ".join(w + w[-24:] * 1000)
    want = classes(texts)
    assert want == {i: i - i % 2 for i in texts}
    got = minhash.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def letters(pairs):
    """Form letters just under 0.8 of each other, but for mates that share a few words more."""
    form = prose(400, 404).split()
    texts = {}
    for i in range(2 * pairs):
        own = [f"p{i // 2}x{k}" for k in range(7)] + [f"o{i}x{k}" for k in range(47)]
        texts[i] = " ".join(form + own)
    return texts


def test_mates_among_form_letters_are_found(spark):
    texts = letters(150)
    want = classes(texts)
    assert want == {i: i - i % 2 for i in texts}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.classes(docs).collect()} == want


def test_rare_pairs_hold_every_similar_pair(spark):
    texts = {**near_copies(), **{1000 + i: t for i, t in letters(20).items()}}
    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i % 5 for i in texts}
    want = {(a, b) for a in texts for b in texts if a < b and label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    u = {i: i.to_bytes(4, "big") for i in texts}
    rows = spark.createDataFrame([(u[i], t, bytes([label[i]])) for i, t in texts.items()], "u binary, text string, l binary")
    got = [(int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in minhash._rare_pairs(rows, 0.8).collect()]
    assert want and want <= set(got) and len(got) == len(set(got)) and all(label[a] != label[b] for a, b in got)
    assert sum(a >= 1000 and b >= 1000 for a, b in got) <= 40  # mates, not all letters with all


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(1, 2**63, 900, dtype=np.uint64)
    h.sort()
    a, b = np.sort(rng.choice(900, 700, replace=False)), np.sort(rng.choice(900, 700, replace=False))
    wa, wb = rng.uniform(0.5, 4, 900), rng.uniform(0.5, 4, 900)
    both = minhash.prob_minhash(np.concatenate((h[a], h[b])), np.repeat([0, 1], 700), np.concatenate((wa[a], wb[b])), 2, 4096)
    exact = minhash.similarity(h[a], wa[a], h[b], wb[b])
    pa, pb = np.zeros(900), np.zeros(900)
    pa[a], pb[b] = wa[a], wb[b]
    both_in = np.flatnonzero((pa > 0) & (pb > 0))
    slow = sum(1 / np.maximum(pa / pa[d], pb / pb[d]).sum() for d in both_in)
    assert abs(exact - slow) < 1e-9 and abs((both[0] == both[1]).mean() - exact) < 0.04


def test_near_duplicates_of_odd_rows(spark, odd):
    rows = minhash.classes(odd).collect()
    assert len(rows) == odd.count()
    by = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in rows)
    assert by[5, 5, 3] == 2 and by[6, 5, 3] == 1 and by[9, 9, 2] == 1 and by[11, 9, 2] == 1 and by[1, 1, 1] == 1
    kept = minhash.one_of_each(odd)
    assert kept.columns == odd.columns
    left = Counter(r["doc_id"] for r in kept.collect())
    assert left == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 2, 8: 1, 9: 1, 10: 1, -12: 1, 13: 1})
    assert minhash.classes(odd.limit(0)).count() == 0 and minhash.one_of_each(odd.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    rows = [(bytes([0, i]), bytes([0, i + 1])) for i in range(40)] + [(b"\x05\x00", bytes([6, i])) for i in range(50)]
    got = {r["v"]: r["l"] for r in components(spark.createDataFrame(rows, "a binary, b binary")).collect()}
    assert {bytes(v) for k, v in got.items() if k[0] == 0} == {b"\x00\x00"} and {bytes(v) for k, v in got.items() if k[0] > 4} == {b"\x05\x00"}


def repeats(texts, length=400):
    """Bytes, removed, runs and digest of the kept bytes of each text, from all windows."""
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        end = removed = runs = 0
        keep = []
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                if s > end or not runs:
                    keep.append(t[end:s])
                    runs, removed, end = runs + 1, removed + length, s + length
                else:
                    removed, end = removed + s + length - end, s + length
        keep.append(t[end:])
        out.append((len(t), removed, runs, hashlib.sha256(b"".join(keep)).hexdigest()))
    return out


def digest(df):
    return [(r["doc_id"], (r["_n_bytes"], r["_n_removed"], r["_n_spans"], hashlib.sha256(r["_kept"]).hexdigest())) for r in df.collect()]


def test_repeats_equal_all_windows(spark):
    r = random.Random(6)
    passage = [prose(200 + k, n) for k, n in enumerate((60, 100, 130, 250, 81))]
    texts = ["", None, "a" * 1500, "ab" * 700, "é" * 300, prose(1, 300), prose(1, 300)]
    for i in range(60):
        parts = [prose(1000 + i, r.randint(0, 120))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passage)
            if r.random() < 0.5:
                p = p.replace(r.choice(p.split()), "changed", 1)
            parts += [p[r.randint(0, 60) :], prose(r.randrange(10**6), r.randint(0, 40))]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = list(enumerate(repeats([(t or "").encode() for t in texts])))
    assert sorted(digest(suffix_dedup.remove_repeats(docs))) == want
    assert sorted(digest(suffix_dedup.remove_repeats(docs, most=0))) == want  # without broadcasts
    kept = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    assert len(kept) == len(texts) and kept[1] is None and kept[0] == "" and kept[5] == ""


def test_repeats_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()]
    want = Counter(zip([i for i, _ in rows], repeats([t for _, t in rows])))
    got = suffix_dedup.remove_repeats(odd)
    assert Counter((r["doc_id"], (r["__n_bytes"] if "__n_bytes" in got.columns else r["_n_bytes"], r["_n_removed"], r["_n_spans"], hashlib.sha256(r["__kept"]).hexdigest())) for r in got.collect()) == want
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0
    assert suffix_dedup.without_repeats(odd).columns == odd.columns


def test_pipeline_stages_on_their_own_input(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append({r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {})
        docs = materialise(stage(spark, docs, sf))
        if name != "packing":
            assert docs.columns == columns
    _, languages, singles, cut, clean = inputs
    assert set(languages) == set(inputs[0])  # all have letters
    assert set(singles) == set(classes(languages).values())
    want = dict(zip(singles, repeats([t.encode() for t in singles.values()])))
    assert set(cut) == set(singles) and all((cut[i] == t) == (want[i][1] == 0) for i, t in singles.items())
    assert set(clean) < set(cut)
    assert set(r["doc_id"] for r in docs.collect()) == set(clean)


def test_pipeline_takes_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, "/root/testdata/sf0.001"))
        if name != "packing":
            assert docs.columns == odd.columns
    assert docs.count() > 0
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, "/root/testdata/sf0.001"))
    assert docs.count() == 0
