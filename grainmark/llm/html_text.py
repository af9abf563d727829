"""Main text of web pages from flat text blocks and a trained decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. A block has its
word count and link density, those of the blocks before and after it, and the zone
that its enclosing tags and their class, id and role words suggest (1 article, -1
page furniture, 0 unknown). A decision tree, trained on a small labelled table,
keeps or drops each block; the kept ones are the page's text. The tree becomes one
SQL expression, so only cutting a page into blocks runs in Python.

The labelled table is made by rule (``labelled_blocks``): pages in the common
layouts, with and without article tags, whose words say which block is article.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from .textbytes import tidy
from .names import free

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "zone", "heading"]

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML's elements by what they do to text.
RAW = set("script style noscript template iframe object svg math canvas audio video title textarea select".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = set("aside button dialog fieldset footer form head label menu nav option search".split())
ARTICLE = {"article", "main"}

# Words of class, id and role that name parts of a page.
STRONG = set(
    "ad ads advert adverts advertisement advertising adsense adslot alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent "
    "contentinfo cookie cookies copyright disclaimer disqus feedback gdpr login modal newsletter notice notices notification pager pagination popup promo promoted "
    "promotion recommended recommendations related replies reply respond search share sharing signup social sponsor sponsored subscribe teaser toolbar trending widget widgets".split()
)
LAYOUT = set("aside bottombar footer header masthead menu nav navbar navigation rail sidebar sidenav topbar".split())
CONTENT = set("article articlebody content entry main post story".split())
QUALIFIED = CONTENT | {"has", "no", "with", "without"}


def _hints(attrs: str) -> set[str]:
    words: set[str] = set()
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        words.update(w.lower() for w in _WORD.findall(value))
    return words


def _zone(tag: str, attrs: str, zone: int, strong: bool) -> tuple[int, bool]:
    """Zone inside a tag, and whether nothing inside can leave it, given those outside."""
    if strong:
        return -1, True
    if tag in FURNITURE:
        return -1, True
    words = _hints(attrs) if "=" in attrs and tag not in ("html", "body") else set()
    if words & STRONG and not (tag in ARTICLE and words & CONTENT):
        return -1, True
    if tag in ARTICLE:
        return 1, False
    if (tag == "header" and zone != 1) or (words & LAYOUT and not words & QUALIFIED):
        return -1, False
    if words & CONTENT and zone == 0:
        return 1, False
    return zone, False


def blocks(html: str | None) -> list[tuple[str, int, float, int, bool]]:
    """(text, words, link density, zone, heading) of each block of a page, in order."""
    out: list[tuple[str, int, float, int, bool]] = []
    stack: list[tuple[str, int, bool]] = []  # open elements with their zones
    still = Counter()  # how often a tag is open
    zone, strong, heading = 0, False, False
    parts: list[str] = []
    linked, links = 0, 0

    def flush():
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                out.append((" ".join(words), len(words), min(1.0, linked / len(words)), zone, heading))
            parts.clear()
        linked = 0

    page, at, n = html or "", 0, len(html or "")
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.split())
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), bool(m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            if not closing and not attrs.endswith("/"):
                close = re.compile(rf"</{tag}\s*>|</{tag}\Z", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        if tag not in BLOCK:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            while still[tag]:  # what was opened inside ends with it
                last = stack.pop()[0]
                still[last] -= 1
                if last == tag:
                    break
        else:
            links = 0
            if tag == "body" and still["head"]:  # a head that was not closed ends here
                stack = [x for x in stack if x[0] != "head"]
                still["head"] = 0
            while stack and stack[-1][0] == "p":  # a paragraph ends where the next block starts
                stack.pop()
                still["p"] -= 1
            if tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
                still["li"] -= 1
            zone, strong = stack[-1][1:] if stack else (0, False)
            stack.append((tag, *_zone(tag, attrs, zone, strong)))
            still[tag] += 1
        zone, strong = stack[-1][1:] if stack else (0, False)
        heading = any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t, _, _ in stack[-2:])
    flush()
    return out


def with_neighbours(page: list[tuple[str, int, float, int, bool]]) -> list[tuple]:
    """(text, *FEATURES) of each block."""
    rows = []
    for i, (text, words, density, zone, heading) in enumerate(page):
        _, wb, lb, _, _ = page[i - 1] if i else ("", 0, 0.0, 0, False)
        _, wa, la, _, _ = page[i + 1] if i + 1 < len(page) else ("", 0, 0.0, 0, False)
        rows.append((text, float(words), float(density), float(wb), float(lb), float(wa), float(la), float(zone), float(heading)))
    return rows


# --- the labelled table ------------------------------------------------------------


def _say(word: str, n: int) -> str:
    return " ".join([word] * n)


def labelled_pages() -> list[str]:
    """Pages made by rule; a block whose words are "keep" is article, one of "drop" is not."""
    link = lambda w, n: f'<a href="/x">{_say(w, n)}</a>'
    pages = []
    for case in range(144):
        long_, short = 15 + 7 * (case % 9), 1 + case % 8
        prose = [f"<p>{_say('keep', long_ + 11 * (k % 4))}</p>" for k in range(3 + case % 3)]
        prose.insert(1 + case % 2, f"<p>{_say('keep', short)}</p>")
        prose.insert(2, f"<p>{_say('keep', long_)} {link('keep', 1 + case % 6)}</p>")
        head = f"<h1>{_say('keep', 2 + case % 9)}</h1>"
        menu = "<ul>" + "".join(f"<li>{link('drop', 1 + (k + case) % 3)}</li>" for k in range(4 + case % 5)) + "</ul>"
        extra = f"<p>{_say('drop', 2 + case % 7 + 9 * (case // 6 % 11))}</p>"
        tail = f"<p>{_say('drop', 2 + case % 5 + 7 * (case // 6 % 9))}</p>"
        side = f"<h3>{_say('drop', 1 + case % 5)}</h3>{extra}"
        kind = case % 6
        if kind == 0:
            body = f"<nav>{menu}</nav><div class='ad'>{side}</div><article>{head}{''.join(prose)}</article><footer>{tail}</footer>"
        elif kind == 1:
            body = f"<header>{menu}<div>{_say('drop', 4)}</div></header><main>{head}{''.join(prose)}<aside>{side}</aside></main><div id='comments'>{side}{extra}</div>"
        elif kind == 2:
            body = f"<div class='menu'>{menu}</div><div class='post-content'>{head}{''.join(prose)}<p>{link('keep', 2 + case % 7)}</p></div><div class='sidebar'>{side}{menu}</div>"
        elif kind == 3:  # nothing says what is what but words and links
            plain = [f"<p>{_say('keep', long_ + 9 * k)}</p>" for k in range(4)]
            top = f"<div>{_say('drop', 1 + case % 4)}</div>{head}" if case % 12 == 3 else ""  # else the menu meets the prose
            body = f"<div>{menu}</div>{top}<div>{''.join(plain)}</div><div>{menu}</div><div>{_say('drop', 2 + case % 5)}</div>"
        elif kind == 4:
            body = f"<article><header>{head}</header>{''.join(prose)}<form><p>{_say('drop', 9)}</p></form><p>{_say('keep', short)}</p></article><form>{extra}</form>"
        else:
            body = f"<div>{menu}</div><article>{head}{''.join(prose[: 1 + case % 4])}</article><section class='comments'><article>{side}</article></section><footer>{menu}{tail}</footer>"
        pages.append(f"<html><head><title>drop</title></head><body>{body}</body></html>")
    return pages


def labelled_blocks() -> list[tuple]:
    """(label, *FEATURES) of all blocks of the labelled pages: about two thousand rows."""
    return [(float(row[0].split()[0] == "keep"), *row[1:]) for page in labelled_pages() for row in with_neighbours(blocks(page))]


# --- the tree -------------------------------------------------------------------------


def train_tree(spark: SparkSession, rows: list[tuple] | None = None, depth: int = 6):
    """A fitted decision tree over FEATURES, from rows of (label, *FEATURES)."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    table = spark.createDataFrame(rows or labelled_blocks(), ", ".join(f"{c} double" for c in ["label", *FEATURES])).coalesce(1)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=4, seed=1).fit(vectors)


def tree_rule(model) -> list:
    """The tree as nested lists: [feature, threshold, left, right], or the label of a leaf."""
    lines = [x.strip() for x in model.toDebugString.splitlines()[1:] if x.strip()]

    def node(i: int):
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        if m is None:
            return float(lines[i].split(":")[1]), i + 1
        left, i = node(i + 1)
        right, i = node(i + 1)  # past the Else line
        return [int(m[1]), float(m[2]), left, right], i

    return node(0)[0]


def tree_column(rule, block: Column) -> Column:
    """True for the blocks that the tree keeps."""
    if not isinstance(rule, list):
        return F.lit(rule == 1.0)
    feature, threshold, left, right = rule
    return F.when(block[FEATURES[feature]] <= threshold, tree_column(left, block)).otherwise(tree_column(right, block))


BLOCK_TYPE = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in FEATURES)]))


def cut_pages(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and, last, _blocks: the blocks of each page with their features."""
    last = free("_blocks", keep)
    ship(pages.sparkSession)
    kind = pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in FEATURES)]))
    names = ["text", *FEATURES]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                got = [[dict(zip(names, r)) for r in with_neighbours(blocks(h))] for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(got, kind)], names=[*keep, last])

    rows = pages.select(*keep, F.col(html).cast("string").alias(free("_html", keep)))
    return rows.mapInArrow(tidy(run), T.StructType([*(pages.schema[c] for c in keep), T.StructField(last, BLOCK_TYPE)]))


def extract(pages: DataFrame, *, html: str = "html", keep: list[str] | None = None, rule=None) -> DataFrame:
    """The columns ``keep`` (all but the html, if not given) and _text, the page's main text.

    Character references are decoded, white space inside a block is one blank, blocks
    are joined by a line feed. A null or empty page, or one without an article, has
    the empty text. Repeated rows are extracted each. Where ``keep`` has a column
    _text, the added one, always last, gets one more leading underscore.
    """
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    rule = tree_rule(train_tree(pages.sparkSession)) if rule is None else rule
    cut = cut_pages(pages, html, keep)
    kept = F.filter(cut.columns[-1], lambda b: tree_column(rule, b))
    return cut.select(*keep, F.array_join(F.transform(kept, lambda b: b["text"]), "\n").alias(free("_text", keep)))
