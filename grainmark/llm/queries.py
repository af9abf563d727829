"""The queries of this subpackage, by name, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    align,
    decontaminate,
    html_text,
    language,
    minhash,
    oracles,
    packing,
    periodic,
    prefix_forest,
    quality_rules,
    sharding,
    suffix_dedup,
    token_store,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_sharding", oracles.SHARDING)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    tree = sharding.balanced(16)
    placed = sharding.place(table(spark, sf, "documents"), tree, sharding.grown(tree))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op2_html_text")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    found = html_text.extract(table(spark, sf, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


@query("op3_prob_minhash")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.classes(table(spark, sf, "documents"))


@query("op4_decontaminate", oracles.DECONTAMINATE)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform("_items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


@query("op5_token_store")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    store = token_store.write(docs, token_store.new_folder(spark), vocabulary(WORD_VOCABULARY))
    places = token_store.lookup(docs.select("doc_id").distinct(), store)
    got = token_store.read(places, store)
    return got.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("_n_bytes").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels")
    model = toxicity.train(docs, labels.where(language.fold("doc_id") != 0))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        (F.coalesce(language.fold("doc_id"), F.lit(-1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = language.train(docs.where(language.fold("doc_id") != 0))
    found = language.identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select(
        "doc_id",
        (F.coalesce(language.fold("doc_id"), F.lit(-1)) == 0).alias("held_out"),
        F.col("_lang").alias("lang_pred"),
        F.col("_lang_score").alias("score"),
    )


@query("op9_quality_rules")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def packed(docs: DataFrame) -> DataFrame:
    """The digest of ``packing.pack``: pieces with a checksum in place of their ids."""
    pieces = packing.pack(docs, vocabulary(BYTE_VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op10_packing")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


def with_counted_characters(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, if it has one, counted anew where the text's length has changed."""
    if "n_chars" not in docs.columns:
        return docs
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(size))


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words from a on of some documents repeat the first p of them (null ids: as they are).

    With h the crc32 of the id and g its tenth, a document of n words is changed if
    h ends in 0: a = g mod n, p = 1 + (n - a) / (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.select("doc_id", "text", h.alias("_h"), F.floor(h / 10).alias("_g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (F.col("_g") % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return some.select("doc_id", F.when((F.col("_h") % 10 == 0) & (n > 0), changed).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_tails(table(spark, sf, "documents")))
    top = F.array_max(F.transform("_runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("s"), (-r.period).alias("p"))))
    line = F.transform("_runs", lambda r: F.format_string("%d,%d,%d\n", r.start, r.length, r.period))
    found = found.withColumn("_top", top)
    return found.select(
        "doc_id",
        F.size("_runs").cast("long").alias("n_runs"),
        (-F.col("_top.s")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.p")).alias("period"),
        F.floor(1000 * F.col("_top.length") / -F.col("_top.p")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("_collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_prefix_forest")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return prefix_forest.search(rows, rows.where("vec_id % 20 = 0"), key="vec_id", vector="embedding", k=20)


@query("op13_token_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return align.measures(table(spark, sf, "documents"), vocabulary(BYTE_VOCABULARY), vocabulary(PIECE_VOCABULARY))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
