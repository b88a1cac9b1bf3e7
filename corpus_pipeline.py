"""A corpus pipeline: language ID, SimHash near-dedup, secret scans, mixing to target weights, best-fit packing.

Each stage takes the documents that its predecessor kept and returns documents again; the last returns packed pieces.

1. language_id drops documents of no language (`und`: null, or without a letter); a null lang becomes the predicted one.
2. near_dedup keeps one document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more, verified).
3. secret_scan replaces secrets by a mark; documents stay, and n_chars follows the text.
4. mix repeats and leaves out documents so that sources come near their weights (5, 2, 1 in turn, 150 % of all words).
5. pack cuts documents into pieces of at most 4096 tokens and packs these into as few sequences as it can.

Nulls, empty tables and repeated rows are treated as the operators say in tessera/llm; unlike texts with one id are
documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, mixing, packing, secret_scan, simhash
from tessera.llm.common import stored
from tessera.llm.queries import word_tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    samples = language.trained(docs)
    if not samples:  # nothing labelled to learn from: only texts without a letter go
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    known = language.identify(docs, samples).filter(F.col("lang_pred") != language.UNKNOWN)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs.select(*COLUMNS))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redacted(docs.select(*COLUMNS).withColumn("_before", F.xxhash64("text")))
    changed = ~F.col("_before").eqNullSafe(F.xxhash64("text"))
    return clean.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, word_tokenizer(), with_ids=False).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("mix", mix),
    ("pack", pack),
]

#: SQL can express neither the automata nor the packing; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
