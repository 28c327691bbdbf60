"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Every stage takes all rows that its predecessor kept and returns a DataFrame, which is written as Parquet and read again
for the next one. All but the last return the columns of ``documents``; a stage that changes texts sets ``n_chars``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import jaccard, packing, pii, quality, repeats, scratch, textio


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    textio.short_batches(spark)
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    textio.short_batches(spark)
    return jaccard.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier, too, are cut out."""
    textio.short_batches(spark)
    return repeats.kept_texts(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced within its format, by the session's key."""
    return pii.pseudonymise(docs, pii.key_of(spark)).withColumn("n_chars", F.length("text").cast("bigint"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of sequences of at most 2048 tokens."""
    textio.short_batches(spark)
    return packing.pack(scratch.settled(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("pii", pseudonyms),
    ("best-fit packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
