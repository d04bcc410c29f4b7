"""Typed reads and writes of result tables, cost profiles and labels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FRONTIER_TABLES


def read_frontier(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(FRONTIER_TABLES[kind]).option("header", True).option("enforceSchema", False).csv(path)


def write_history(df: DataFrame, path: str) -> None:
    """CSV with header; arrays become JSON text, since CSV holds no nested values."""
    flat = [
        F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_tracker(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_cost_profile(spark: SparkSession, path: str) -> dict:
    """The cost configuration: a document of a few kB, read through Spark so that shared paths work."""
    return json.loads("\n".join(r.value for r in spark.read.text(path).toLocalIterator()))


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A JSON object {gidx: value} as rows (labels and splits files)."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING,STRING>").alias("m"))
    return doc.select(F.explode("m").alias("g", "v")).select(
        F.col("g").cast("bigint").alias("gidx"), F.col("v").alias(value)
    )
