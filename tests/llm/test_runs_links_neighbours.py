import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose

from grainmark.llm import align, periodic, prefix_forest, queries
from grainmark.llm.textbytes import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs


def all_runs(w, least=12):
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            b = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > b and i + q - b >= max(least, 2 * q):
                seen.setdefault((b, i + q), q)
            i = max(i, b + 1)
    return sorted((b, e - b, q) for (b, e), q in seen.items())


def strings():
    r = random.Random(3)
    fib, old = [0, 1], [0]
    while len(fib) < 300:
        fib, old = fib + old, fib
    thue = [0]
    while len(thue) < 256:
        thue = thue + [1 - x for x in thue]
    out = [[], [1], [1] * 11, [1] * 12, [1] * 40, [1, 2] * 6, fib, thue]
    out += [[r.randrange(2) for _ in range(300)] for _ in range(10)]
    for p in (2, 3, 5, 7, 11, 12, 13, 23, 24, 40):
        root = [r.randrange(3) for _ in range(p)]
        out.append([9] + (root * 40)[: r.randrange(2 * p, 6 * p)] + [8])
        out.append(root * 12 + (root * 12)[r.randrange(p) :] + root * 3)  # two regions of one period meet
        out.append(((root * 9) + [7]) * 4)  # periods within periods
    mirror = [0, 1] * 45
    out.append(mirror + mirror[::-1] + mirror[::-1] + mirror)
    return out


def test_runs_equal_brute_force():
    docs = strings()
    flat, ends = [], []
    for k, d in enumerate(docs):
        flat += [x + 1 for x in d] + [10_000 + k]
        ends.append(len(flat) - 1)
    got = defaultdict(list)
    for b, e, q in periodic.runs_of(mix(np.array(flat, np.uint64)), np.array(ends)).T.tolist():
        k = int(np.searchsorted(ends, b))
        got[k].append((b - (ends[k - 1] + 1 if k else 0), e - b, q))
    for k, d in enumerate(docs):
        assert sorted(got[k]) == all_runs(d), d


def test_runs_that_reach_the_end_of_a_slice():
    # A long match near the last word is compared in blocks that reach past it.
    for d in ([0, 2] * 12 + ([2, 0] * 12 + [2]) * 2, ([1, 1, 2] * 9 + [1]) * 3, [*range(12)] * 8, [*range(13)] * 40):
        w = mix(np.array([x + 1 for x in d] + [10_000], np.uint64))
        got = [(b, e - b, q) for b, e, q in periodic.runs_of(w, np.array([len(d)])).T.tolist()]
        assert sorted(got) == all_runs(d), d


def digest_of_runs(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = all_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, *sha)


def test_runs_query_equals_brute_force(spark, small):
    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").collect() if len(r["text"] or "") < 8_000]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_periodic_runs"](spark, small).collect()}
    assert any(v[0] for v in got.values())
    for r in docs:
        assert got[r["doc_id"]] == digest_of_runs(r["doc_id"], r["text"]), r["doc_id"]


def test_runs_of_odd_rows(spark, odd):
    got = periodic.periodic_runs(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        w = WORD.findall(r["text"] or "")
        assert r["_n_words"] == len(w)
        if not w:
            assert (r["_runs"], r["_collapsed"]) == ([], "")
    assert periodic.periodic_runs(odd.where("false")).count() == 0
    planted = queries.with_planted_tails(odd).select("text")
    assert planted.count() == odd.count()


def test_a_long_repeat_in_a_long_text(spark):
    text = prose(1, 30_000) + " " + " ".join([prose(2, 7_001)] * 3) + " " + prose(3, 100)
    r = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["_runs"]] == [(30_000, 21_003, 7_001)]
    assert len(r["_collapsed"].split()) == 30_000 + 7_001 + 100


# --- token alignment


@pytest.fixture(scope="module")
def sides(vocabulary):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def tokens(sides, text):
    """Ids and bytes of both sides, or None."""
    if not text:
        return None
    a, b = sides
    letters = align._byte_letters()
    ea = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in t)) for i, t in zip(ea.ids, ea.tokens)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if all(b"".join(x[1] for x in s) == whole for s in (left, right)) else None


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute_alignment(sides, texts):
    rows, counts = [], Counter()
    for text in texts:
        both = tokens(sides, text)
        if both is None:
            rows.append(None)
            continue
        left, right = (spans(s) for s in both)
        ends = {e for _, _, e in left} & {e for _, _, e in right}
        groups, links = [], []
        i = j = 0
        for cut in sorted(ends):
            ga, gb = [], []
            while i < len(left) and left[i][2] <= cut:
                ga.append(left[i][0])
                i += 1
            while j < len(right) and right[j][2] <= cut:
                gb.append(right[j][0])
                j += 1
            groups.append((ga, gb))
        stop = {e: x for x, _, e in right}
        links = [(x, stop[e]) for x, _, e in left if e in stop]
        counts.update(links)
        rows.append((len(left), len(right), groups, links))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, groups, links = r
        told = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        best = sum(counts[x] == top[x[1]] for x in links)
        out.append((na, nb, len(groups), len(links), best, sum(counts[x] for x in links), hashlib.sha256(told.encode()).hexdigest()))
    return out


AWKWARD = ["", None, " ", "  ", "a ", " a", "a  b   c", "\n\n x\t\ty ", "<s> </s> <0x41> <unk> <|endoftext|>", "▁ a", "a▁b", "  日本 語 é́", "x" * 3000, "😀 ​  ok", "\x00 \x01\x7f", "  \n  ", "İ ß ﬁ"]


def test_alignment_equals_brute_force(spark, sides, vocabulary, small):
    texts = AWKWARD + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in align.measures(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()}
    for k, want in enumerate(brute_alignment(sides, texts)):
        assert got[k] == want, texts[k]


def test_links_equal_all_pairs(spark, sides, vocabulary):
    texts = [*AWKWARD, prose(1, 50), "Unbelievable antidisestablishmentarianism, naïve façade — 12345!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    overlap, group = (Counter(tuple(r) for r in align.links(docs, *paths, within=w).collect()) for w in ("overlap", "group"))
    want_overlap, want_group = Counter(), Counter()
    for k, text in enumerate(texts):
        both = tokens(sides, text)
        if both is None:
            continue
        left, right = (spans(s) for s in both)
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        for i, (x, s, e) in enumerate(left):
            for j, (y, t, f) in enumerate(right):
                if min(e, f) > max(s, t):
                    want_overlap[k, i, j, x, y, e, f, min(e, f) - max(s, t)] += 1
                if np.searchsorted(cuts, e) == np.searchsorted(cuts, f):
                    want_group[k, i, j, x, y, e, f, 1] += 1
    assert overlap == want_overlap
    assert group == want_group


def test_product_of_incidence_matrices():
    r = np.random.default_rng(1)
    for _ in range(20):
        n, k, m = r.integers(0, 9, 3)
        a, b = (r.random((x, y)) < 0.4 for x, y in ((n, k), (k, m)))
        csr = [(np.concatenate(([0], np.cumsum(x.sum(1)))).astype(int), np.nonzero(x)[1]) for x in (a, b)]
        ptr, col, value = align.product(*csr, int(m))
        got = np.zeros((n, m), int)
        got[np.repeat(np.arange(n), np.diff(ptr)), col] = value
        assert (got == a.astype(int) @ b.astype(int)).all()
        back = align.transposed(csr[0], int(k))
        assert (back[1] == np.nonzero(a.T)[1]).all()


def test_alignment_of_odd_rows(spark, odd, vocabulary):
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    assert align.measures(odd, *paths).count() == odd.count()
    assert align.measures(odd.where("false"), *paths).count() == 0
    assert align.links(odd.where("false"), *paths).count() == 0


# --- nearest neighbours


def nearest(rows, queries_, k):
    """query -> [(key, score)] over all rows of other keys, ties to the smaller key."""
    x = np.stack([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for i, v in queries_:
        s = x @ v
        order = [j for j in np.lexsort((ids, -s.round(12))) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


def answers(found, key="vec_id"):
    got = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r[key], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall_of(got, want):
    return sum(len({j for j, _ in got[i]} & {j for j, _ in w}) for i, w in want.items()) / sum(map(len, want.values()))


def embedded(spark, vectors, ids=None, kind="float"):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(int(i), [float(c) for c in v], int(i) % 3) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, tree int")


@pytest.mark.parametrize("shape", ["plain", "lengths", "clusters"])
def test_recall_against_all_rows(spark, shape):
    r = np.random.default_rng(5)
    x = r.standard_normal((6_000, 24)).astype(np.float32)
    if shape == "lengths":
        x *= r.lognormal(0, 0.6, (len(x), 1)).astype(np.float32)
    if shape == "clusters":
        x = (8 * x[r.integers(0, 150, len(x))] + x).astype(np.float32)
    docs = embedded(spark, x)
    found = prefix_forest.search(docs, docs.where("vec_id % 20 = 0"), key="vec_id", vector="embedding", page=500, sample=1_500)
    rows = list(enumerate(x.astype(np.float64)))
    want = nearest(rows, rows[::20], 20)
    got = answers(found)
    assert set(got) == set(want)
    assert all(len(v) == 20 for v in got.values())
    assert recall_of(got, want) >= 0.9
    for i, near in got.items():
        for j, s in near:
            assert s == pytest.approx(float(x[i].astype(float) @ x[j].astype(float)), abs=1e-9)
        assert near == sorted(near, key=lambda t: (-t[1], t[0]))


def test_clusters_need_few_candidates(spark):
    r = np.random.default_rng(6)
    h = prefix_forest._strings((20 * r.standard_normal((400, 16)))[r.integers(0, 400, 20_000)] + r.standard_normal((20_000, 16)), 1e5, prefix_forest._planes(16, 3), 3)
    f = prefix_forest.Forest(h, 20_000, 500)
    for m in (100, 1_000, 60_000):
        bits = f.lengths(h.T[:200], m)
        for k in np.unique(bits):
            q = h.T[:200][bits == k]
            assert (f.held(q, int(k)) >= min(m, 60_000)).all()
            if k < prefix_forest.BITS:
                assert (f.held(q, int(k) + 1) < m).all()


def test_copies_and_ties(spark):
    r = np.random.default_rng(7)
    base = r.standard_normal((50, 8)).astype(np.float32)
    x = np.concatenate([np.repeat(base[:1], 1_200, axis=0), np.repeat(base[1:30], 4, axis=0), base[30:]])
    ids = r.permutation(len(x))
    docs = embedded(spark, x, ids).repartition(5)
    got = answers(prefix_forest.search(docs, docs.where("vec_id % 20 = 0"), key="vec_id", vector="embedding", k=7, page=100, recall=1.0))
    rows = list(zip(ids.tolist(), x.astype(np.float64)))
    want = nearest(rows, [t for t in rows if t[0] % 20 == 0], 7)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [-1.0, 0.0]), (40, None), (60, [0.0, -0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(prefix_forest.search(docs, docs.where("vec_id % 20 = 0"), key="vec_id", vector="embedding", k=20))
    assert dict(got) == {0: [(8, 2.0), (20, 0.5), (9, -1.0)], 20: [(8, 1.0), (0, 0.5), (9, -0.5)]}
    none = docs.where("false")
    assert prefix_forest.search(none, none, key="vec_id", vector="embedding").count() == 0
    assert prefix_forest.search(docs, none, key="vec_id", vector="embedding").count() == 0
