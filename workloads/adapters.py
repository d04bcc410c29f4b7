"""How the benchmark tables stand in for episodes, campaigns, trials and traces (Spark and SQL side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

D_SAFE = 0.5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# A total order of the episodes of one design and scenario.
EP_ORDER = ["ep_id", "seq", "part", "metric", "disc", "tax", "flag", "qty", "ship"]


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as episodes: design = supplier, scenario = line status."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ep_uid"),
        F.col("l_orderkey").alias("ep_id"),
        F.col("l_linenumber").alias("seq"),
        F.col("l_linestatus").alias("scenario"),
        F.col("l_suppkey").alias("gidx"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("metric"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").alias("ship"),
        ((50 - F.col("l_suppkey") % 5 - F.col("l_quantity")) / 10 + 0.5).alias("min_d"),
    )


EP_SQL = """ep AS (
  SELECT l_orderkey || '-' || l_linenumber AS ep_uid, l_orderkey AS ep_id, l_linenumber AS seq,
    l_linestatus AS scenario, l_suppkey AS gidx, l_partkey AS part, l_quantity AS qty,
    l_extendedprice AS metric, l_discount AS disc, l_tax AS tax, l_returnflag AS flag, l_shipdate AS ship,
    (50 - l_suppkey % 5 - l_quantity) / 10 + 0.5 AS min_d
  FROM lineitem)"""
EP_ORDER_SQL = ", ".join(EP_ORDER)


def unsafe_flag() -> Column:
    return F.col("min_d") < D_SAFE


def campaign(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as weighted rare-event rows: job = line status, stratum = return flag."""
    li = table(spark, sf, "lineitem")
    gone = F.col("l_tax") == 0
    return li.select(
        F.col("l_linestatus").alias("job"),
        F.col("l_returnflag").alias("sampling_component"),
        (F.col("l_quantity") > 50 - F.col("l_suppkey") % 5).alias("failure"),
        F.when(F.col("l_tax") == 0.08, F.lit(float("-inf")))
        .otherwise(F.ln(0.5 + 10 * F.col("l_discount")))
        .alias("log_weight"),
        F.when(~gone, F.col("l_partkey").cast("double")).alias("first_detection_ms"),
        F.when(~gone, F.col("l_suppkey").cast("double")).alias("first_external_message_age_ms"),
        F.concat(F.col("l_returnflag"), F.lit("|"), F.col("l_linenumber").cast("string")).alias("route_signature"),
        ((50 - F.col("l_suppkey") % 5 - F.col("l_quantity")) / 10 + 0.5).alias("min_d"),
    )


CAMPAIGN_SQL = """ca AS (
  SELECT l_linestatus AS job, l_returnflag AS sampling_component,
    l_quantity > 50 - l_suppkey % 5 AS failure,
    CASE WHEN l_tax = 0.08 THEN 0.0 ELSE 0.5 + 10 * l_discount END AS w,
    CASE WHEN l_tax <> 0 THEN l_partkey::DOUBLE END AS first_detection_ms,
    CASE WHEN l_tax <> 0 THEN l_suppkey::DOUBLE END AS first_external_message_age_ms,
    l_returnflag || '|' || l_linenumber AS route_signature,
    (50 - l_suppkey % 5 - l_quantity) / 10 + 0.5 AS min_d
  FROM lineitem)"""


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """events as a trace: episode = user, one record per row."""
    ev = table(spark, sf, "events")
    k = F.from_json("props", "k INT")["k"]
    return ev.select(
        F.col("user_id").alias("episode"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.col("event_id"),
        F.col("event_type").alias("sender"),
        F.col("value").alias("dist"),
        k.cast("bigint").alias("k"),
    )


TICKS_SQL = """tk AS (
  SELECT user_id AS episode, epoch_us(ts) AS t_us, event_id, event_type AS sender, value AS dist,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events)"""


def by_part(df: DataFrame) -> DataFrame:
    """Part takes the role of the design and the design that of the part: many short groups."""
    swap = {"gidx": "part", "part": "gidx"}
    return df.select(*[F.col(swap.get(c, c)).alias(c) for c in df.columns])
