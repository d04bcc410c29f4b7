"""Partitioned Parquet episode store: read, append, compact and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import designs, episodes
from ..schemas import episode

REQUIRED = ("ep_uid", "ep_id", "sc_name", "gidx")


def read(spark: SparkSession, path: str, params: list[str] | None = None) -> DataFrame:
    """All shards of a store; the scenario is a partition column, so one scenario reads one folder."""
    reader = spark.read.option("recursiveFileLookup", "false")
    if params is not None:
        reader = reader.schema(episode(params))
    df = reader.parquet(path)
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"store lacks columns {missing}")
    return episodes.alias_legacy(df)


def scan(spark: SparkSession, path: str, scenario: str, params=None, on_duplicate: str = "keep_first") -> DataFrame:
    df = read(spark, path, params).where(F.col("sc_name") == scenario)
    if on_duplicate == "raise" and not episodes.repeats(df).isEmpty():
        raise ValueError(f"repeated uids in scenario {scenario!r}")
    return episodes.scan(df, scenario, ["ep_id"])


def append(
    rows: DataFrame,
    path: str,
    *,
    batch: str,
    order: list[str],
    uid_from: list[str],
    spaces=None,
    stamp_ns: int | None = None,
) -> DataFrame:
    """Append a batch. Numbers follow the store's largest ``ep_id``; a uid depends only on batch and row,
    so a repeated batch writes only what the first attempt did not. Returns the rows written."""
    spark = rows.sparkSession
    try:
        old = read(spark, path)
    except Exception as exc:  # a store that does not exist yet
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        old = None
    start = 0 if old is None else (old.agg(F.max("ep_id")).first()[0] or 0)
    if old is not None:
        rows = episodes.unstored(rows, old, episodes.batch_uid(batch, uid_from))
    new = episodes.number_new(rows, order, F.lit(start), batch, uid_from)
    if spaces is not None:
        new = new.select("*", *designs.decode(F.col("gidx"), spaces))
    if stamp_ns is not None:
        new = new.withColumn("stamp", F.lit(stamp_ns).cast("bigint"))
    new.write.mode("append").option("compression", "zstd").partitionBy("sc_name").parquet(path)
    return new


def compact(spark: SparkSession, source: str, target: str, scenario: str | None = None) -> DataFrame:
    """Rewrite a store without identical repeats into a new folder and prove the copy before returning it.

    The source is left untouched; the caller switches over once the result is in hand.
    """
    df = read(spark, source)
    if scenario is not None and not df.where(F.col("sc_name") != scenario).isEmpty():
        raise ValueError(f"store holds rows of another scenario than {scenario!r}")
    conflict = lambda: not episodes.conflicts(df).isEmpty()
    uids, differ = episodes.screen(df)  # uids and contents are compared as such only where their hashes leave a doubt
    if differ and conflict():
        raise ValueError("one uid carries different contents")
    seen = Observation()  # the rows are counted on their way into the copy, not derived once more
    slim = episodes.compact(df).observe(seen, *episodes.digest_columns(df.columns))
    slim.write.mode("errorifexists").option("compression", "zstd").partitionBy("sc_name").parquet(target)
    copy = read(spark, target).select(*df.columns)
    if seen.get["rows"] != uids and conflict():
        raise ValueError(f"one uid carries different contents; the copy in {target} is void")
    if seen.get != episodes.multiset_digest(copy).first().asDict():
        raise RuntimeError(f"the copy in {target} differs from its source")
    return copy


def merge(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several roots in priority order, one row per uid; writers use only the first root."""
    return episodes.merge_roots([read(spark, p) for p in paths], ["ep_id"])
