"""From raw documents to packed training sequences: the stages of a corpus, each over all that its predecessor kept.

All stages but the last return the columns of ``documents``; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm import jaccard, lines, packing, personal, quality
from sparkassay.llm.registry import small_batches
from sparkassay.session import scratch_path, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside the perplexity bands of their language go."""
    small_batches(spark)
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines that many sites share are cut out; every document stays."""
    small_batches(spark)
    return _recount(lines.remove_boilerplate(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    small_batches(spark)
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    small_batches(spark)
    return _recount(personal.redact_documents(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    small_batches(spark)
    files = (public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("json", "tiktoken"))
    return packing.pack(docs, *files)


def _recount(changed: DataFrame, docs: DataFrame) -> DataFrame:
    kind = docs.schema["n_chars"].dataType
    return changed.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]
ORACLE_SQL = None  # perplexity bands, the conditional random field and packing have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
