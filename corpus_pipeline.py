"""A training corpus in five stages: language, near duplicates, repeated strings, benchmark passages, packing.

Every stage works on what the one before it kept and, but for the last, returns the
columns of ``documents``. ``run`` writes each stage as Parquet below
``spark.checkpoint.dir`` and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmark.functions.scratch import materialise
from grainmark.llm import decontaminate, language, minhash, packing, queries, suffix_dedup


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; ``und`` and uncertain ones go. Learned from the stage's own input."""
    model = language.train(docs.where(language.fold("doc_id") != 0))
    return language.accepted(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return minhash.one_of_each(docs)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 400 bytes that occur twice go; n_chars follows the text."""
    return queries.with_counted_characters(suffix_dedup.without_repeats(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return queries.packed(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Training, hashing of registers and tokenising have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
