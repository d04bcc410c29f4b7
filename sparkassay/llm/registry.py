"""Name -> Spark query and name -> SQL text of this subpackage."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


BATCH_ROWS = 1000  # rows of an Arrow batch: long texts pass through workers in small pieces


def small_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark, sf: str, name: str):
    small_batches(spark)
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
