"""Language by family first, then by one-versus-one linear machines inside the family.

Texts become counts of byte 1- to 3-grams (letters lowered, all else a blank) in
``BINS`` hashed bins, damped by a logarithm and scaled to length 1. One linear
support vector machine per family separates it from the others; inside the chosen
family one machine per pair of languages votes. A vote's strength is the logistic
of its margin. Whole texts are read, in training and in prediction.

Training uses at most about ``per_language`` documents of each language (a hash of
the row decides, with a share computed from the language's count) and each machine
at most about twice that; every machine is one group of a grouped map, so Spark
trains them side by side. Only the weights, BINS numbers a machine, come to the
driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ship import ship
from .names import free
from .textbytes import hand_back, text_slices, tidy

BINS = 4096
_ROWS = 256
UND = "und"

# Families of languages by ISO 639-1 code. A code that is missing is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["an", "ca", "es", "fr", "gl", "it", "la", "oc", "pt", "rm", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sh", "sk", "sl", "sr", "uk"],
    "celtic": ["br", "cy", "ga", "gd", "gv", "kw"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu", "se"],
    "turkic": ["az", "ba", "kk", "ky", "tk", "tr", "tt", "ug", "uz"],
    "indic": ["as", "bn", "gu", "hi", "mr", "ne", "or", "pa", "sa", "si", "ur"],
    "iranian": ["fa", "ku", "ps", "tg"],
    "dravidian": ["kn", "ml", "ta", "te"],
    "semitic": ["am", "ar", "he", "mt"],
    "austronesian": ["id", "jv", "mg", "mi", "ms", "su", "tl"],
}


def family(language: str) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    for name, codes in FAMILIES.items():
        if code in codes:
            return name
    return language


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def _bins(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint32(salt)) * np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2246822519)
    return (x >> np.uint32(20)).astype(np.int64)  # 12 bits: BINS


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of BINS damped, scaled counts per text (few texts at a time: it is dense)."""
    n = len(off) - 1
    out = np.zeros((n, BINS), np.float32)
    if not len(buf):
        return out
    b = _FOLD[buf]
    latin = np.flatnonzero(buf[:-1] == 0xC3) + 1  # À-Þ to à-þ
    latin = latin[(buf[latin] >= 0x80) & (buf[latin] <= 0x9E)]
    b[latin] |= 0x20
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    keep[off[:-1][off[:-1] < len(b)]] = True
    row = np.repeat(np.arange(n), np.diff(off))[keep]
    b = b[keep].astype(np.uint32)
    flat = np.zeros(n * BINS, np.float64)
    gram = b
    for order in (1, 2, 3):
        if order > 1:
            if len(b) < order:
                break
            gram = gram[:-1] * np.uint32(257) + b[order - 1 :]
            ok = row[: len(gram)] == row[order - 1 :]
        else:
            ok = b != 32
        at = row[: len(gram)] * BINS + _bins(gram, order * 7919)
        flat += np.bincount(at[ok], minlength=n * BINS)
    out[:] = np.log1p(flat).reshape(n, BINS)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def _row_slices(column):
    for lo, hi, buf, off in text_slices(column):
        for a in range(0, hi - lo, _ROWS):
            z = min(a + _ROWS, hi - lo)
            yield lo + a, lo + z, buf[off[a] : off[z]], off[a : z + 1] - off[a]


def linear_machine(x: Sequence[np.ndarray], y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge support vector machine, by dual coordinate descent."""
    rows, x = x, np.ones((len(x), len(x[0]) + 1))
    for i, row in enumerate(rows):  # one matrix, and no other copy of it
        x[i, :-1] = row
    square = np.concatenate([(x[i : i + _ROWS] ** 2).sum(axis=1) for i in range(0, len(x), _ROWS)]) + 0.5 / cost
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (w @ x[i]) - 1 + alpha[i] * 0.5 / cost
            step = max(alpha[i] - slope / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w


@dataclass
class Model:
    """Families with their languages, and the machines by name: a family, or two languages."""

    families: dict[str, list[str]]
    weights: dict[str, np.ndarray]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) for rows of features."""
        names = sorted(self.families)
        if not names:
            return np.full(len(x), UND, object), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])

        def margin(name: str) -> np.ndarray:
            return x @ self.weights[name].astype(np.float32) if name in self.weights else np.zeros(len(x), np.float32)

        if len(names) > 1:
            p = np.stack([_logistic(margin(f"family {f}")) for f in names], axis=1)
            chosen = p.argmax(axis=1)
            sure = p.max(axis=1) / p.sum(axis=1)
        else:
            chosen, sure = np.zeros(len(x), int), np.ones(len(x))
        language, score = np.full(len(x), UND, object), np.zeros(len(x))
        for k, f in enumerate(names):
            at = chosen == k
            if not at.any():
                continue
            langs = self.families[f]
            votes = np.zeros((len(x), len(langs)))
            for i in range(len(langs)):
                for j in range(i + 1, len(langs)):
                    q = _logistic(margin(f"pair {langs[i]} {langs[j]}"))
                    votes[:, i] += q
                    votes[:, j] += 1 - q
            best = votes.argmax(axis=1)
            share = votes[np.arange(len(x)), best] / max(len(langs) - 1, 1) if len(langs) > 1 else np.ones(len(x))
            language[at] = np.array(langs, object)[best[at]]
            score[at] = sure[at] * share[at]
        return language, score


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4.0 * m.astype(np.float64)))


def _letters(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, *, text: str = "text", label: str = "lang", per_language: int = 1500) -> Model:
    """Fit on ``docs``, rows with a label and a letter only. ``per_language``: about the most documents of one language."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where("label is not null")
    counts = dict(rows.groupBy("label").count().collect())  # one row per language
    families: dict[str, list[str]] = {}
    for language in sorted(counts):
        families.setdefault(family(language), []).append(language)
    if not counts:
        return Model({}, {})
    taken = {x: min(n, per_language) for x, n in counts.items()}
    shares = F.create_map(*(y for x in counts for y in (F.lit(x), F.lit(taken[x] / counts[x]))))
    draw = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(_letters("text")).where(draw < F.element_at(shares, F.col("label")))
    others = {f: sum(taken[x] for x in taken if family(x) != f) for f in families}
    share = {f: min(1.0, 2 * per_language / max(1, n)) for f, n in others.items()}

    def run(batches):
        for b in batches:
            labels = b.column(1).to_pylist()
            for lo, hi, buf, off in _row_slices(b.column(0)):
                x = features(buf, off)
                out = []
                for i, language in enumerate(labels[lo:hi]):
                    f = family(language)
                    raw = x[i].tobytes()
                    if len(families) > 1:
                        out.append((f"family {f}", 1, raw))
                        at = zlib.crc32(raw) / 2**32
                        out += [(f"family {g}", -1, raw) for g in families if g != f and at < share[g]]
                    for other in families[f]:
                        if other != language:
                            a, z = sorted((language, other))
                            out.append((f"pair {a} {z}", 1 if language == a else -1, raw))
                name, y, raw = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(y, pa.int32()), pa.array(raw, pa.binary())], names=["machine", "y", "x"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])  # whatever order the shuffle gave
        w = linear_machine([np.frombuffer(v, np.float32) for v in pdf["x"]], pdf["y"].to_numpy().astype(float))
        hand_back()
        return pd.DataFrame({"machine": [pdf["machine"].iloc[0]], "w": [w.astype(np.float32).tobytes()]})

    fitted = sample.mapInArrow(tidy(run), "machine string, y int, x binary").groupBy("machine").applyInPandas(fit, "machine string, w binary")
    return Model(families, {r["machine"]: np.frombuffer(r["w"], np.float32) for r in fitted.collect()})


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with _lang and _lang_score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, and so is every
    text when nothing was learned. All columns stay (``keep_text`` false drops the
    text); where a table has a column of an added name, the added one gets one more
    leading underscore.
    """
    lang, sure, lettered = (free(c, docs.columns) for c in ("_lang", "_lang_score", "_letters"))
    spark = docs.sparkSession
    ship(spark)
    known = spark.sparkContext.broadcast(model)
    rows = docs.withColumn(lettered, _letters(text))
    names = rows.columns
    t, letters = names.index(text), names.index(lettered)
    kept = [i for i, c in enumerate(names) if i != letters and (keep_text or i != t)]

    def run(batches):
        for b in batches:
            for lo, hi, buf, off in _row_slices(b.column(t)):
                language, score = known.value.predict(features(buf, off))
                silent = ~b.column(letters).slice(lo, hi - lo).to_numpy(zero_copy_only=False).astype(bool)
                language[silent], score[silent] = UND, 0.0
                cols = [b.column(i).slice(lo, hi - lo) for i in kept]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(language.tolist(), pa.string()), pa.array(score)], names=[*(names[i] for i in kept), lang, sure]
                )

    schema = T.StructType([rows.schema[i] for i in kept] + [T.StructField(lang, T.StringType()), T.StructField(sure, T.DoubleType())])
    return rows.mapInArrow(tidy(run), schema)


def accepted(docs: DataFrame, model: Model, *, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The documents with a language, as they are: not ``und``, and a score of ``min_score`` or more."""
    found = identify(docs, model, text=text)
    lang, sure = found.columns[-2:]
    return found.where((F.col(lang) != UND) & (F.col(sure) >= min_score)).select(*docs.columns)


def fold(key: str, folds: int = 5):
    """crc32 of the key as text, modulo ``folds``; a null key is in no fold."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds
