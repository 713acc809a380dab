"""A training-data pipeline over `documents`, built from the operators of sluicework.llm.

Each stage works on the rows that the stage before it has kept, and returns the columns of
`documents`; the last one returns digests of the ids and of the decoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sluicework.llm import bpe_chunks, decontaminate, language_id, simhash_gray, suffix_dedup
from sluicework.llm.common import reachable, table, text_of, written
from sluicework.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without a letter go, null texts included."""
    return language_id.in_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints at most two bits apart (3-word shingles): the one with the smallest id."""
    return simhash_gray.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages: runs of 50 words, and strings of 400 bytes that hold fewer; rows stay even if nothing is left.

    Documents that hold a benchmark item keep their passages, which may be that item: the next stage has to see it.
    """
    texts = docs.select(F.xxhash64(text_of("text")).alias("mark"), "text")
    held = decontaminate.contaminated(texts, table(spark, sf_dir, "benchmark", "item_id", "text"), doc_id="mark")
    cut = suffix_dedup.without_repeats(docs, passages=True, spared=held.select(F.col("doc_id").alias("mark")).distinct())
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    return bpe_chunks.round_trip(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark", benchmark),
    ("bpe", bpe),
]

#: SQL can express neither the classifier nor the byte-pair encoding; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(reachable(spark), docs, sf_dir))
    return docs
