import re
from collections import Counter

from conftest import prose
from pyspark.sql import functions as F

from grainmark.llm import decontaminate, html_text, language, quality_rules, sharding, toxicity
from grainmark.llm.queries import QUERIES


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_shards_keep_the_key_law(spark, odd):
    tree = sharding.balanced(16)
    rows = sharding.place(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), tree, sharding.grown(tree)).toPandas()
    assert rows.groupby("shard").size().between(1100, 1400).all()
    moved = rows[rows["shard"] != rows["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 1000 < len(moved) < 1350
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    got = sharding.place(odd, tree, sharding.grown(tree)).toPandas()
    assert len(got) == odd.count() and got[["shard", "slot"]].drop_duplicates().shape[0] == len(got)
    assert got[got["doc_id"] == 1]["size"].tolist() == [1] and got[got["doc_id"] == 1]["text_crc32"].tolist() == [0]
    assert got[got["doc_id"] == 5]["shard"].nunique() == 1
    assert sharding.place(odd.limit(0), tree, tree).count() == 0
    assert sharding.assign(odd, tree).columns == [*odd.columns, "_shard"]


def test_weights_move_only_their_subtree(spark):
    tree = sharding.balanced(8)
    heavy = [sharding.Leaf(x.shard, x.region, x.rack, 3.0 if x.shard == 3 else 1.0) for x in tree]
    key = F.col("id").cast("string")
    both = spark.range(8000).select(sharding.descend(key, tree).alias("a"), sharding.descend(key, heavy).alias("b")).toPandas()
    region = {x.shard: x.region for x in tree}
    moved = both[both["a"] != both["b"]]
    assert all(region[b] == region[3] for b in moved["b"])  # nothing moves into the unchanged region
    assert 0.25 < (both["b"] == 3).mean() < 0.35


def test_matches_equal_brute_force(spark, odd, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "ha then x"), (901, None), (902, ""), (903, prose(5, 10)), (903, prose(13, 40))], "item_id long, text string")
    items = items.unionByName(extra)
    both = docs.unionByName(odd.select("doc_id", "text"))
    windows = {}
    for r in items.collect():
        w = words(r["text"])
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(r["item_id"])
    want = Counter()
    for r in both.collect():
        w, hit, found = words(r["text"]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        want[r["doc_id"], len(w), len(hit), tuple(sorted(found))] += 1
    for block in (decontaminate.BLOCK_BYTES, 2000):  # one block, and several
        got = Counter((r[0], r["_n_words"], r["_n_hit"], tuple(sorted(r["_items"]))) for r in decontaminate.contamination(both, items, block_bytes=block).collect())
        assert got == want
    kept = decontaminate.remove_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == sum(n for (i, w, h, f), n in want.items() if not h) - sum(
        1 for r in decontaminate.contamination(docs, items).collect() if not r["_n_hit"]
    )
    assert decontaminate.contamination(odd, items.limit(0)).where("_n_hit > 0").count() == 0
    assert decontaminate.contamination(odd.limit(0), items).count() == 0


def test_longest_match_and_its_place(spark):
    text = "x y " + prose(3, 25) + " z"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "q " + prose(3, 25))], "item_id long, text string")
    (m,) = decontaminate.find_matches(docs, items).first()["_matches"]
    assert (m["item"], m["item_word"], m["doc_word"], m["n_words"]) == (7, 1, 2, 25)


def test_quality_measures_equal_brute_force(spark, odd, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang", "source")
    both = docs.unionByName(odd.select("doc_id", "text", "lang", "source"))
    want = Counter()
    for r in both.collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        want[r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)] += 1
    rows = quality_rules.quality(both).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == want and not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality_rules.quality(odd.limit(0)).count() == 0


def test_fences_follow_the_group(spark):
    rows = [(i, prose(i, 80), "aa", "s") for i in range(150)] + [(500 + i, " ".join(w + "$$$" for w in prose(i, 80).split()), "aa", "s") for i in range(12)]
    rows += [(1000 + i, " ".join(w + "$$" for w in prose(i, 80).split()), "bb", "s") for i in range(150)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(150)) and not any(got[500 + i] for i in range(12)) and all(got[1000 + i] for i in range(150))


def test_sketches_merge(spark):
    docs = spark.createDataFrame([(i, prose(i, 60 + i % 40), "aa", f"s{i % 2}") for i in range(80)], "doc_id long, text string, lang string, source string")
    m = quality_rules.measure(docs, key="doc_id", text="text", groups=("lang", "source"))
    parts = [quality_rules.sketches(m.where(f"key % 3 = {k}")) for k in range(3)]
    together = quality_rules.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["g0", "g1"])
    a = {tuple(r) for r in quality_rules.fences(together, reach=4.0, min_rows=1).collect()}
    b = {tuple(r) for r in quality_rules.fences(quality_rules.sketches(m), reach=4.0, min_rows=1).collect()}
    assert a == b  # fewer values than a sketch holds: exact


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and (held["lang"] == held["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark, odd):
    model = language.train(odd)
    found = language.identify(odd, model)
    rows = found.collect()
    assert found.columns[-2:] == ["__lang", "_lang_score"] and len(rows) == odd.count()
    for r in rows:
        silent = not re.search(r"[^\W\d_]", r["text"] or "")
        assert (r["__lang"] == "und") == silent and (r["_lang_score"] == 0) == silent
    assert language.accepted(odd, model).columns == odd.columns
    nothing = language.train(odd.limit(0))
    assert {r["_lang_score"] for r in language.identify(odd, nothing).collect()} == {0.0}
    assert language.identify(odd.limit(0), model).count() == 0


def test_disguises_are_undone(spark):
    model = toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text")
    restore = toxicity.Restorer(model)
    for said, meant in {"st.u.p.i.d": "stupid", "m0r0n": "moron", "l0s3r": "loser", "$cum": "scum", "p@thetic": "pathetic", "stuuuupid": "stupid", "i_d_i_o_t": "idiot"}.items():
        assert restore(f"the {said} ereat") == [meant]
    assert restore("re s t u p i d and the.") == ["stupid"]
    assert restore("The ereat, and%%% wher*** is!! 2.3") == []


def test_long_spans_phrases_and_edge_signs_are_restored(spark):
    restore = toxicity.Restorer(toxicity.character_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text"))
    assert restore("the st" + "u" * 200 + "pid ereat") == ["stupid"]
    phrase = "  ".join(" ".join(w) for w in ["stupid", "idiot"] * 10)
    assert restore(f"The {phrase}.") == [" ".join(["stupid", "idiot"] * 10)]
    for said, meant in {"a  s t u p i d": "a stupid", "y  i d i o t  a": "y idiot a"}.items():
        assert restore(f"{said}.") == [meant]
    assert restore("the $$cum ereat") in (["scum"], ["sscum"]) and len(restore("the as$ and as5 and a$$ ereat")) == 3
    assert all(w.startswith("as") for w in restore("the as$ and a$$ ereat"))
    long_ = "s t u p i d  " * 20_000
    assert restore(long_)[0].split() == ["stupid"] * 20_000


def test_every_text_with_a_disguise_is_suspect():
    import random

    import numpy as np

    r = random.Random(3)
    texts = ["x s t u p i d", "s. t. u. p. i. d", "s  t  u  p  i  d", "p é d é", "am p é d é.", "idiééét", "müüüde", "日日日", "𐐀𐐀𐐀"]
    texts += ["".join(r.choice("ab é日$@.-_*  1ü𐐀") for _ in range(r.randint(0, 14))) for _ in range(20_000)]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(t) for t in raw])))
    found = set(toxicity.suspects(np.frombuffer(b"".join(raw), np.uint8), off).tolist())
    assert [t for i, t in enumerate(texts) if any(toxicity.disguised(t)) and i not in found] == []


def test_disguised_spans_are_those_of_one_pattern_tried_everywhere():
    import random
    import re

    letter, sign = toxicity._L, toxicity._SIGN
    plain = re.compile(  # from every place, first form first; takes time with the square of a long word
        rf"(?<![\w@$]){letter}(?:[ .\-_*]{{1,2}}{letter}){{3,}}(?![\w@$])"
        rf"|[$@0-9(|!€]{{0,3}}{letter}+(?:{sign}{{1,3}}{letter}+)+[0-9@$]{{0,3}}(?!\w)"
        rf"|(?<![\w$@(|!€])[$@0-9(|!€]{{1,3}}{letter}{{2,}}[0-9@$]{{0,3}}(?![\w$@])"
        rf"|(?<![\w$@]){letter}+[0-9@$]{{1,3}}(?![\w$@])"
        rf"|(?<!\w)\w*({letter})\1\1\w*(?!\w)"
    )
    r = random.Random(5)
    for letters in ["ab1. _", "ab1.$_ é", "a1._", "ab .-_*", "aaab$ (1_.", "a. _"] * 8_000:
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert [m.span() for m in toxicity.disguised(text)] == [m.span() for m in plain.finditer(text)], text


def test_long_words_take_time_in_proportion(spark):
    import time

    import numpy as np

    restore = toxicity.Restorer(toxicity.character_model(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "text"))
    texts = ["x1 " + "abcdefghij" * 100_000, "a1b2" * 250_000 + "_", "a.b.c.d..." * 100_000, "a_ b_ c_ " * 110_000, "x1" + "abcdefghij" * 100_000]
    for text in texts:
        start, raw = time.perf_counter(), np.frombuffer(text.encode(), np.uint8)
        toxicity.all_forms(raw, np.array([0, len(raw)]), restore)
        assert time.perf_counter() - start < 10


def test_nested_pages_take_time_in_proportion():
    import time

    for page in ["<div>x</p>" * 100_000, "<div><ul><li>x</div>" * 50_000, "<article>" * 110_000 + "x" + "</article>" * 3]:
        start = time.perf_counter()
        html_text.blocks(page)
        assert time.perf_counter() - start < 10


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(language.fold("doc_id") != 0))
    held = docs.join(labels.where(language.fold("doc_id") == 0), "doc_id").select("doc_id", "text", "toxic")
    got = toxicity.score(held, model).join(held.select("doc_id", "toxic"), "doc_id").toPandas()
    said = got["score"] >= 0.5
    assert (said & (got["toxic"] == 1)).sum() > 0.8 * (got["toxic"] == 1).sum()
    assert (said & (got["toxic"] == 0)).sum() < 0.02 * (got["toxic"] == 0).sum()
    one = spark.createDataFrame([(1, "the ereat is a m0r0n and an i.d.i.o.t here"), (2, "the ereat is here")], "doc_id long, text string")
    a, b = (r["score"] for r in toxicity.score(one, model).orderBy("doc_id").collect())
    assert a > 0.9 > 0.2 > b


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (8, 0), (None, 1), (9, None), (6, 0), (13, 1), (-12, 0), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.train(odd, labels.limit(0))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}
    assert toxicity.score(odd.limit(0), model).count() == 0


PAGES = {
    "<html><body><nav><a href=/>Home</a></nav><article><h1>Ti&amp;tle</h1><p>One <b>two</b>\n three<br>four<p>Five &copy; six</article><footer>x</footer>": "Ti&tle\nOne two three four\nFive © six",
    "<div class='comments'><article>no</article></div><main><p>yes it is<aside>not</aside><p>more<script>var a='</p>'</script> text</main>": "yes it is\nmore text",
    "<div id=cookie-notice>Accept all</div><article class=post><p>a &lt; b<form>mail <input></form><div class='ad-slot'>buy</div><p>end</article>": "a < b\nend",
    "<article><p>cut off &am": "cut off &am",
    "<article><p>x<!-- not --> y</p><p></p><ul><li>l1<li>l2</ul></article>": "x y\nl1\nl2",
    "": "",
    "<nav>only</nav>": "",
}


def test_pages(spark):
    rows = [(i, None if h == "" else h, "u", "clash") for i, h in enumerate(PAGES)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string, url string, _text string"))
    assert got.columns == ["page_id", "url", "_text", "__text"]
    assert {r["page_id"]: r["__text"] for r in got.collect()} == dict(enumerate(PAGES.values()))
    plain = "<div><ul>" + "".join(f"<li><a href=/>m{k}</a></li>" for k in range(6)) + "</ul></div>" + "".join(f"<p>{prose(k, 60)}</p>" for k in range(3)) + "<div>tail words</div>"
    one = html_text.extract(spark.createDataFrame([(1, plain)], "page_id long, html string")).first()["_text"]
    assert one == "\n".join(prose(k, 60) for k in range(3))
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_fixture_pages_give_the_article(spark):
    from html import unescape

    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in QUERIES["op2_html_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inside))
        assert got[r["page_id"]] == "\n".join(x for x in (" ".join(unescape(p).split()) for p in parts) if x)
