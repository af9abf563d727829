"""Toxicity of texts after undoing disguises with a noisy-channel model.

Words written with digits and signs for letters, with separators between letters,
or with drawn-out letters become lattices of readings; the Viterbi path under a
character trigram model of the whole corpus is the restored word. The restored
words are scored together with the text's own words.

The scorer looks at whole words and at word beginnings of 4 to 6 bytes. From one
part of the labelled sample (three quarters) it learns, per form, a cautious log
odds of toxic against clean documents (less ``CAUTION`` standard errors); on the
rest a logistic curve turns a text's two strongest forms into a score. At most about
``per_label`` labelled documents of either label are used, and at most
``MAX_FORMS`` forms are kept; the trigram counts cover every document.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from .packing import key_type
from .suffix_dedup import SpanHash
from .textbytes import ALNUM, mix, spans, text_slices, tidy

MAX_FORMS = 20_000
CAUTION = 1.64
STARTS = (4, 5, 6)

# Letters that a sign or digit may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l",
}
SEPARATORS = ".-_*~'^"

# --- character model ---------------------------------------------------------

#: 0 is a word's edge; then a-z, U+00DF to U+00FF, and one symbol for all other letters.
_SYMBOLS = 1 + 26 + 33 + 1
_OTHER = _SYMBOLS - 1


def symbol(c: str) -> int:
    k = ord(c)
    return k - 96 if 97 <= k <= 122 else k - 0xDF + 27 if 0xDF <= k <= 0xFF else _OTHER


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x250, np.int32)
    for k in range(0x250):
        c = chr(k).lower()
        if len(c) == 1 and c.isalpha():
            table[k] = symbol(c)
    return table


_TABLE = _symbol_table()


def trigrams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of (symbol, symbol, symbol) in the letters of the texts; all else is an edge."""
    edged = np.insert(buf, off[1:], np.uint8(32))
    points = np.frombuffer(edged.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    s = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], _OTHER).astype(np.int64)
    s = np.concatenate(([0, 0], s, [0]))
    keep = np.ones(len(s), bool)  # two edges begin a word, one ends it
    keep[2:] = (s[2:] != 0) | (s[1:-1] != 0) | (s[:-2] != 0)
    s = s[keep]
    # After an edge nothing before it counts: a word's first letter follows two edges.
    code = (np.where(s[1:-1] == 0, 0, s[:-2]) * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:]
    good = (s[2:] != 0) | (s[1:-1] != 0)
    return np.bincount(code[good], minlength=_SYMBOLS**3)


class CharacterModel:
    """-log P(c | a, b), from trigram counts backed off to bigrams."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).astype(np.float64)
        two = three.sum(axis=0)
        back = (two + 1) / (two.sum(axis=1, keepdims=True) + _SYMBOLS)
        p = (three + 5 * back[None]) / (three.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p)).tolist()


def character_model(docs: DataFrame, text: str) -> CharacterModel:
    """Trigrams of every text, summed in the tasks first: at most _SYMBOLS^3 rows a task."""
    ship(docs.sparkSession)

    def run(batches):
        total = np.zeros(_SYMBOLS**3, np.int64)
        for b in batches:
            for _, _, buf, off in text_slices(b.column(0)):
                total += trigrams(buf, off)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_SYMBOLS**3, np.int64)
    for gram, n in rows.toLocalIterator():
        counts[gram] = n
    return CharacterModel(counts)


# --- channel -------------------------------------------------------------------


#: Costs of a separator between two letters of a word and of one between two words.
INSIDE, EDGE = 0.3, 1.0


@lru_cache(10_000)
def _readings(c: str, n: int, longer: bool) -> list[tuple[str, float]]:
    """Of a character that stands ``n`` times in a row, three meaning three or more."""
    if c.isalpha():
        return [(c, 0.4), (c + c, 0.6)] if n > 2 else [(c * n, 0.0)]
    if c in LOOKALIKES:
        letters = LOOKALIKES[c]
        price = 0.5 + math.log(len(letters))
        return [(x, price) for x in letters] + ([(x + x, price) for x in letters] if n > 1 else []) + ([("", 1.0)] if c in "|!" else [("", 8.0)])
    if c == "*":
        return [("", 1.0)] + [(chr(k), 1.0) for k in range(97, 123)] + [(" ", EDGE)]
    if c == " " and longer:
        return [("", 8.0), (" ", INSIDE)]
    return [("", INSIDE), (" ", EDGE)]


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each part of a disguised word, its readings and their costs (-log of the channel's chance).

    A separator may be a word's edge (a blank); blanks longer than the shortest
    separator of the span most likely are.
    """
    parts = [m[0] for m in re.finditer(r"(.)\1*", word.lower(), re.S)]
    shortest = min((len(p) for p in parts if not p[0].isalpha() and p[0] not in LOOKALIKES), default=0)
    return [_readings(p[0], min(len(p), 3), len(p) > shortest) for p in parts]


def decode(word: str, model: CharacterModel) -> str:
    """The Viterbi path through a word's lattice under the character model; linear in the word."""
    best: dict = {(0, 0): (0.0, None)}
    cost = model.cost
    for readings in lattice(word):
        step: dict = {}
        letters, price = readings[0]
        if len(readings) == len(letters) == 1:  # a plain letter, the common case
            k = symbol(letters)
            for (a, b), (total, made) in best.items():
                t = total + price + cost[a][b][k]
                if (b, k) not in step or t < step[b, k][0]:
                    step[b, k] = (t, (made, letters))
            best = step
            continue
        for (a, b), (total, made) in best.items():
            for letters, price in readings:
                p, q, t = a, b, total + price
                for c in letters:
                    if c == " ":
                        t += cost[p][q][0] if q else 0.0
                        p = q = 0
                        continue
                    k = symbol(c)
                    t += cost[p][q][k]
                    p, q = q, k
                if (p, q) not in step or t < step[p, q][0]:
                    step[p, q] = (t, (made, letters) if letters else made)
        best = step
    made = min(((t + cost[p][q][0], made) for (p, q), (t, made) in best.items()), key=lambda x: x[0])[1]
    out = []
    while made is not None:
        made, letters = made
        out.append(letters)
    return " ".join("".join(reversed(out)).split())


_L = r"[^\W\d_]"
_SIGN = "[" + re.escape("".join(LOOKALIKES) + SEPARATORS) + "]"
#: Letters one by one. The second form is a run that ends inside a word: it fails from all its later letters too, so it is passed over whole.
APART = re.compile(rf"(?<![\w@$])(?:{_L}(?:[ .\-_*]{{1,2}}+{_L}){{3,}}(?![\w@$])|(?P<miss>{_L}(?:[ .\-_*]{{1,2}}+{_L}){{3,}}+))")
#: Signs before a word; letters and signs in turn up to a word's end. A chain that fails at
#: its first letters fails at all later ones, so a search starts it only there.
_LEAD = r"[$@0-9(|!€]{0,3}"
_CHAIN = rf"{_L}++(?:{_SIGN}{{1,3}}+{_L}++)+[0-9@$]{{0,3}}(?!\w)"
#: Signs inside, at the start or at the end of a word; letters drawn out.
SIGNED = re.compile(
    rf"{_LEAD}(?<!{_L})(?<!{_L}{_SIGN})(?<!{_L}{_SIGN}{{2}})(?<!{_L}{_SIGN}{{3}}){_CHAIN}"
    rf"|(?<![\w$@(|!€])[$@0-9(|!€]{{1,3}}{_L}{{2,}}[0-9@$]{{0,3}}(?![\w$@])"
    rf"|(?<![\w$@]){_L}+[0-9@$]{{1,3}}(?![\w$@])"
    rf"|(?<!\w)\w*({_L})\1\1\w*(?!\w)"
)
#: What is left of a chain whose beginning another span has taken.
_REST = re.compile(rf"{_SIGN}{{0,3}}?(?P<rest>{_LEAD}(?={_L}))")
_WHOLE = re.compile(_LEAD + _CHAIN)


def _apart(text: str, at: int) -> re.Match | None:
    m = APART.search(text, at)
    while m and m["miss"]:
        m = APART.search(text, m.end())
    return m


def disguised(text: str):
    """Disguised spans from left to right, none inside another; linear in long words and chains.

    Where several begin at one place, letters one by one come first, then signs inside a word.
    """
    at, far = 0, len(text) + 1
    apart, signed = _apart(text, 0), SIGNED.search(text)
    while apart or signed:
        first = apart.start() if apart else far
        rest = _REST.match(text, at) if at else None
        begin = rest.start("rest") if rest else far
        m = None
        if begin < first and begin <= (signed.start() if signed else far):
            m = _WHOLE.match(text, begin)
        if m is None:
            m = apart if first <= (signed.start() if signed else far) else signed
        yield m
        at = m.end()
        if apart and apart.start() < at:
            apart = _apart(text, at)
        if signed and signed.start() < at:
            signed = SIGNED.search(text, at)
    rest = _REST.match(text, at) if at else None
    m = _WHOLE.match(text, rest.start("rest")) if rest else None
    if m:
        yield m


_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"0123456789@$!|+(" + SEPARATORS.encode())] = True
_SIGNS[[0xC2, 0xE2]] = True  # first bytes of the signs beyond ASCII
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_ENDS = np.zeros(256, bool)
_ENDS[list(b"0123456789@$")] = True
_BETWEEN = np.zeros(256, bool)
_BETWEEN[list(b" .-_*")] = True
#: Bytes of a character by its first byte; 0 for what cannot begin a letter.
_WIDTH = np.zeros(256, np.int64)
_WIDTH[65:91] = _WIDTH[97:123] = 1
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:0xF8] = 2, 3, 4


def suspects(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts in which a span can be disguised: a sign beside a letter, three equal characters, or lone letters in a row.

    Each is a necessary part of one way to match, in whole UTF-8 characters.
    """
    n = len(buf)
    if n < 2:
        return np.zeros(0, np.int64)
    letter, sign = _LETTERS[buf], _SIGNS[buf]
    hit = np.zeros(n, bool)
    hit[:-1] = (sign[:-1] & letter[1:]) | (letter[:-1] & _ENDS[buf[1:]])
    hit[:-2] |= letter[:-2] & (buf[:-2] == buf[1:-1]) & (buf[1:-1] == buf[2:])
    between = _BETWEEN[buf]
    lone = [np.flatnonzero(between[:-2] & letter[1:-1] & between[2:]) + 1]
    wide = np.flatnonzero(buf >= 0xC0)
    if len(wide):
        width = _WIDTH[buf[wide]]
        inner = (wide > 0) & (wide + width < n)
        at, k = wide[inner], width[inner]
        lone.append(at[between[at - 1] & between[at + k]])
        for k in (2, 3, 4):  # a character of k bytes three times: 2 k bytes that return after k
            at = wide[(width == k) & (wide + 3 * k <= n)]
            for j in range(2 * k):
                at = at[buf[at + j] == buf[at + j + k]]
            hit[at] = True
    lone = np.sort(np.concatenate(lone))
    gap = lone[1:] - (lone + np.maximum(_WIDTH[buf[lone]], 1))[:-1]
    hit[lone[:-1][gap <= 2]] = True
    return np.unique(np.searchsorted(off, np.flatnonzero(hit), "right") - 1)


class Restorer:
    """Restored words of texts; a task remembers short spans it has decoded."""

    def __init__(self, model: CharacterModel):
        self.long = lambda w: decode(w, model)
        self.short = lru_cache(200_000)(self.long)

    def __call__(self, text: str) -> list[str]:
        out = []
        for m in disguised(text):
            # Three of a letter read as more of it do.
            span = re.sub(rf"({_L})\1{{3,}}", r"\1\1\1", m[0])
            out.append((self.short if len(span) <= 64 else self.long)(span))
        return out


# --- forms and scores -----------------------------------------------------------


def forms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of whole words and word beginnings, A-Z lowered."""
    low = buf.copy()
    low[(buf >= 65) & (buf <= 90)] += 32
    s, e, row = spans(low, off, ALNUM)
    if not len(s):
        return np.zeros(0, np.uint64), row
    h = SpanHash(low)
    hashes, rows = [h(s, e, 1)], [row]
    for k in STARTS:
        at = np.flatnonzero(e - s > k)
        hashes.append(h(s[at], s[at] + k, k))
        rows.append(row[at])
    return np.concatenate(hashes), np.concatenate(rows)


def all_forms(buf: np.ndarray, off: np.ndarray, restore: Restorer) -> tuple[np.ndarray, np.ndarray]:
    h, row = forms(buf, off)
    at = suspects(buf, off)
    if not len(at):
        return h, row
    raw = buf.tobytes()
    words = [" ".join(restore(raw[off[i] : off[i + 1]].decode("utf-8", "replace"))).encode() for i in at.tolist()]
    ends = np.concatenate(([0], np.cumsum([len(w) for w in words])))
    h2, row2 = forms(np.frombuffer(b"".join(words), np.uint8), ends)
    return np.concatenate((h, h2)), np.concatenate((row, at[row2]))


@dataclass
class Model:
    characters: CharacterModel
    hashes: np.ndarray  # ascending
    weights: np.ndarray
    curve: np.ndarray  # for 1, strongest, second

    def strongest(self, h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """n x 2: the two largest weights among a text's distinct forms."""
        out = np.zeros((n, 2))
        if not len(self.hashes) or not len(h):
            return out
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        pair = np.unique(row[hit].astype(np.int64) * len(self.hashes) + at[hit])
        r, w = pair // len(self.hashes), self.weights[pair % len(self.hashes)]
        order = np.lexsort((-w, r))
        r, w = r[order], w[order]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
        out[r[first], 0] = w[first]
        second = first + 1
        second = second[second < len(r)]
        second = second[r[second] == r[second - 1]]
        out[r[second], 1] = w[second]
        return out

    def score(self, strongest: np.ndarray) -> np.ndarray:
        x = np.hstack([np.ones((len(strongest), 1)), strongest])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def _logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = 8000) -> Model:
    """Fit on the labelled documents (0 or 1) given; the character model is of all ``docs``.

    Null labels and labels of unknown documents teach nothing; of several labels of one
    document the larger counts. Without labels of both
    kinds every score is the share of toxic ones seen (0.5 without any).
    """
    spark = docs.sparkSession
    ship(spark)
    characters = character_model(docs, text)
    known = labels.select(F.col(key).alias("lk"), F.col(label).cast("int").alias("y")).where("lk is not null and y in (0, 1)")
    known = known.groupBy("lk").agg(F.max("y").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    draw = F.pmod(F.xxhash64("lk", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    take = F.create_map(*(v for y in (0, 1) for v in (F.lit(y), F.lit(min(1.0, per_label / max(1, counts.get(y, 0)))))))
    sample = known.where(draw < F.element_at(take, F.col("y"))).withColumn("half", (F.pmod(F.xxhash64("lk", F.lit(8)), F.lit(4)) == 0).cast("int"))
    # The sample has about 2 x per_label rows of three numbers.
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("key") == F.col("lk")).select("text", "y", "half")
    model = spark.sparkContext.broadcast(characters)

    def count(batches):
        restore = Restorer(model.value)
        for b in batches:
            y = b.column(1).to_numpy()
            for lo, hi, buf, off in text_slices(b.column(0)):
                h, row = all_forms(buf, off, restore)
                # Distinct forms of each text.
                _, first = np.unique(h ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
                h, toxic = h[first], y[lo:hi][row[first]]
                v, which = np.unique(h, return_inverse=True)
                t = np.bincount(which, weights=toxic, minlength=len(v)).astype(np.int64)
                n = np.bincount(which, minlength=len(v))
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(t), pa.array(n - t)], names=["h", "t", "c"])

    seen = dict(sample.where("half = 0").groupBy("y").count().collect())
    nt, nc = seen.get(1, 0) + 1.0, seen.get(0, 0) + 1.0
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 1.0))
    weight = F.log((F.col("t") + 0.5) / nt) - F.log((F.col("c") + 1.0) / nc) - CAUTION * error
    found = rows.where("half = 0").mapInArrow(tidy(count), "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    best = found.where("t >= 3").withColumn("w", weight).where("w > 1").orderBy(F.desc("w"), "h").limit(MAX_FORMS).select("h", "w").collect()
    h = np.array([r["h"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(h)
    out = Model(characters, h[order], np.array([r["w"] for r in best], np.float64)[order], np.zeros(3))
    shared = spark.sparkContext.broadcast(out)

    def strengths(batches):
        restore = Restorer(shared.value.characters)
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(0)):
                s = shared.value.strongest(*all_forms(buf, off, restore), hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(lo, hi - lo), pa.array(s[:, 0]), pa.array(s[:, 1])], names=["y", "a", "b"])

    got = rows.where("half = 1").mapInArrow(tidy(strengths), "y int, a double, b double").collect()  # at most about per_label each
    y = np.array([r["y"] for r in got], np.float64)
    if len(set(y.tolist())) == 2:
        out.curve = _logistic_fit(np.array([(r["a"], r["b"]) for r in got]), y)
    else:
        total = sum(counts.values())
        share = min(max(counts.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        out.curve = np.array([math.log(share / (1 - share)), 0.0, 0.0])
    return out


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1), restored (words read out of disguises), one row per document.

    Null and empty texts have no forms and take the score of a text without any
    suspect form. Equal keys and repeated rows are scored each; other columns are ignored.
    """
    kind = key_type(docs, key)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        restore = Restorer(shared.value.characters)
        for b in batches:
            for lo, hi, buf, off in text_slices(b.column(1)):
                s = shared.value.score(shared.value.strongest(*all_forms(buf, off, restore), hi - lo))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s)], names=["key", "score"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("score", T.DoubleType())])
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)
