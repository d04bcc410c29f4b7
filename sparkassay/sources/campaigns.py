"""Campaign shards (JSON lines per job), their plan and their digests; trace documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CAMPAIGN_ROW, JOB_PLAN, TRACE_DOCUMENT


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_PLAN).option("multiLine", True).json(path)


def read_rows(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """All jobs in one pass: ``<root>/<job>/sample-shards/<number>.jsonl``; job and shard from the path."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return (
        spark.read.schema(CAMPAIGN_ROW)
        .json(f"{root}/*/sample-shards/{pattern}")
        .withColumns(
            {
                "job": F.element_at(parts, -3),
                "shard": F.regexp_extract(F.element_at(parts, -1), r"^(\d+)", 1).cast("int"),
            }
        )
    )


def count_check(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Jobs whose row count differs from the planned episodes (also jobs on one side only)."""
    have = rows.groupBy("job").agg(F.count(F.lit(1)).alias("rows"))
    want = plan.select(F.col("key").alias("job"), F.col("episodes").alias("planned"))
    both = want.join(have, "job", "full").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return both.where(~F.col("rows").eqNullSafe(F.col("planned"))).select("job", "planned", "rows")


def _stem(c) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), r"(\.sha256\.json|\.jsonl?)$", "")


def shard_digests(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """sha256 of every shard: (file, actual). A shard is one record, hashed where it is read."""
    return (
        spark.read.format("binaryFile")
        .load(f"{root}/*/sample-shards/{pattern}")
        .select(_stem(F.col("path")).alias("file"), F.sha2("content", 256).alias("actual"))
    )


def recorded_digests(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.schema("sha256 STRING")
        .option("multiLine", True)
        .json(f"{root}/*/sample-shards/*.sha256.json")
        .select(_stem(F.col("_metadata.file_path")).alias("file"), F.col("sha256").alias("recorded"))
    )


def compare_digests(shards: DataFrame, notes: DataFrame) -> DataFrame:
    """(file, recorded, actual, ok); a shard or a side-car alone is not ok."""
    both = shards.join(notes, "file", "full")
    return both.withColumn("ok", F.coalesce(F.col("actual") == F.col("recorded"), F.lit(False)))


def digest_check(spark: SparkSession, root: str) -> DataFrame:
    """sha256 of every shard against its side-car."""
    return compare_digests(shard_digests(spark, root), recorded_digests(spark, root))


def read_traces(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per episode document: a document per file, or with ``lines`` one per line of files that hold many.

    Listing and opening a file per episode costs more than its records once there are many short episodes.
    """
    return spark.read.schema(TRACE_DOCUMENT).option("multiLine", not lines).json(path)
