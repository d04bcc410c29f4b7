"""Streaming queries driven by the benchmark files; each runs to the end of its input and is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.session import scratch_path
from sparkassay.streaming import streams as ST

from .adapters import EP_ORDER, EP_SQL, table, unsafe_flag
from .registry import query
from .sequential import KEYS, LABEL_SQL
from .traces import DAY_MS, MS_SQL


PARTS = 4


def parts_of(spark, sf, name, order=None):
    """The folder of a table cut into ``PARTS`` in one job: rows at random, or in runs of the ``order`` column, nulls first."""
    rows = table(spark, sf, name)
    if order is None:
        part = F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))
    else:
        limits = rows.agg(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)], 1000)).first()[0]
        part = sum((F.coalesce(F.col(order) > F.lit(x), F.lit(False)).cast("int") for x in limits or []), F.lit(0))
    folder = scratch_path(spark, f"{name}-parts")
    rows.withColumn("part__", part).write.partitionBy("part__").parquet(folder)
    return folder


def feed(spark, sf, name, start, order=None):
    """Run the query that ``start`` makes of a stream once per part: each run finds the part's files, as many as there are."""
    schema, parts, folder = table(spark, sf, name).schema, parts_of(spark, sf, name, order), scratch_path(spark, f"{name}-files")
    for i in range(PARTS):
        spark.read.schema(schema).parquet(f"{parts}/part__={i}").write.mode("append").parquet(folder)
        start(ST.source(spark, folder, schema)).awaitTermination()


FILE_ROWS = 1_000_000


def stream(spark, sf, name):
    """A table as one stream of files of at most some ``FILE_ROWS`` rows, in ``PARTS`` batches."""
    folder = scratch_path(spark, f"{name}-files")
    rows = table(spark, sf, name)
    each = max(2, -(-rows.count() // (PARTS * FILE_ROWS)))  # files of a batch; a task holds one, whatever the size of the table
    rows.repartition(PARTS * each, F.xxhash64(*rows.columns)).write.parquet(folder)
    return ST.source(spark, folder, rows.schema, maxFilesPerTrigger=each)


def places(spark, name):
    return scratch_path(spark, name), scratch_path(spark, f"{name}-offsets")


def episodes(lines):
    return lines.select(
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


@query("stream_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest(spark, sf):
    target, offsets = places(spark, "ingest")
    src = stream(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    ST.stream_ingest(src, target, offsets, ["event_type"]).awaitTermination()
    return spark.read.parquet(target).select("event_id", "user_id", "event_type", "value")


@query("stream_dedup", f"WITH {EP_SQL} SELECT DISTINCT ep_uid FROM ep")
def stream_dedup(spark, sf):
    target, offsets = places(spark, "dedup")
    src = episodes(stream(spark, sf, "lineitem")).select("ep_uid")
    ST.stream_dedup(src, target, offsets).awaitTermination()
    return spark.read.parquet(target).select("ep_uid")


@query("stream_sprt", f"WITH {LABEL_SQL} SELECT gidx, scenario, label, mode, n, k FROM lab")
def stream_sprt(spark, sf):
    target, offsets = places(spark, "sprt")
    # a sequential test takes its trials in their order, so the parts are runs of it
    feed(spark, sf, "lineitem", lambda lines: ST.stream_sprt(episodes(lines), target, offsets, KEYS, EP_ORDER, unsafe_flag()), "l_orderkey")
    return ST.sprt_state(spark, target, KEYS)


@query(
    "stream_gate",
    """WITH n AS (SELECT p_partkey AS iter, p_size::DOUBLE AS s, (p_partkey % 11 = 0)::INT AS r FROM part ORDER BY p_partkey DESC LIMIT 50)
SELECT max(iter) AS iter, CASE WHEN sum(s) / 200 > 6 OR 100.0 * sum(r) / 400 > 10 THEN 'stopped' ELSE 'passed' END AS status,
  round(sum(s) / 200, 9) AS seconds_per_trial FROM n""",
)
def stream_gate(spark, sf):
    target, offsets = places(spark, "gate")
    src = stream(spark, sf, "part").select(
        F.col("p_partkey").alias("iter"), F.col("p_size").cast("double").alias("seconds"), (F.col("p_partkey") % 11 == 0).cast("int").alias("retries")
    )
    ST.stream_gate(
        src, target, offsets, window=50, trials=4, scenarios=2, max_seconds=6, max_retries=10
    ).awaitTermination()
    out = spark.read.parquet(f"{target}/status").orderBy(F.desc("batch")).limit(1)  # after the last batch
    return out.select("iter", "status", F.round("seconds_per_trial", 9).alias("seconds_per_trial"))


@query(
    "stream_checkpoint_log",
    "SELECT l_orderkey AS trial_index, l_linestatus AS scenario, count(*) AS episodes, max(l_quantity) AS top FROM lineitem GROUP BY ALL",
)
def stream_checkpoint_log(spark, sf):
    target, offsets = places(spark, "log")
    keys = ["trial_index", "scenario"]
    src = stream(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trial_index"), F.col("l_linestatus").alias("scenario"), "l_quantity"
    )
    result = lambda d: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("episodes"), F.max("l_quantity").alias("top"))
    ST.stream_checkpoint_log(src, target, offsets, keys, result).awaitTermination()
    return ST.checkpoint_log(spark, target, keys)


@query(
    "stream_message_age",
    f"""WITH {MS_SQL}, d AS (SELECT episode, t, event_id AS decision FROM ms WHERE sender = 'view'),
m AS (SELECT episode, t, t - k * 600000 AS time_stamp, event_id AS msg_id FROM ms WHERE sender <> 'view'),
j AS (SELECT d.episode, decision, d.t, max((time_stamp, msg_id)) AS best FROM d LEFT JOIN m ON m.episode = d.episode AND m.t <= d.t GROUP BY ALL)
SELECT episode, decision, t, best[2] AS msg_id, t - best[1] AS age FROM j""",
)
def stream_message_age(spark, sf):
    target, offsets = places(spark, "age")
    ev = stream(spark, sf, "events")
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    k = F.from_json("props", "k INT")["k"].cast("bigint")
    src = ev.select(
        F.col("user_id").alias("episode"), t.alias("t"), (F.col("event_type") == "view").alias("is_decision"),
        F.col("event_id").alias("id"), (t - k * 600000).alias("time_stamp"),
    )
    ST.stream_message_age(src, target, offsets, ["episode"]).awaitTermination()
    return ST.message_ages(spark, target, ["episode"])


@query(
    "stream_trace_fold",
    f"""WITH {MS_SQL}, z AS (SELECT min(t) AS z FROM ms), e AS (SELECT episode, t - z AS t, event_id, sender, dist FROM ms, z),
f AS (SELECT episode, t // {7 * DAY_MS} AS chunk, sender AS topic, count(*)::INT AS len, string_agg(t, ',' ORDER BY t, event_id) AS times, round(sum(dist), 6) AS total FROM e GROUP BY ALL)
SELECT * FROM f""",
)
def stream_trace_fold(spark, sf):
    target, offsets = places(spark, "fold")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    rows = table(spark, sf, "events").select("user_id", ms.alias("t"), "event_id")
    zero = rows.agg(F.min("t")).first()[0]
    # the last record of a user is its termination record: a static table joined to the stream
    last = rows.groupBy("user_id").agg(F.max(F.struct("t", "event_id")).alias("l")).select(
        F.col("l.event_id").alias("event_id"), F.lit("end").alias("cause")
    )
    src = stream(spark, sf, "events").join(last, "event_id", "left").select(
        F.col("user_id").alias("episode"), F.col("event_type").alias("topic"), (ms - zero).alias("t"),
        F.col("event_id").alias("id"), F.col("value").alias("v"), "cause",
    )
    ST.stream_trace_fold(src, target, offsets, 7 * DAY_MS).awaitTermination()
    total = F.aggregate("vals", F.lit(0.0), lambda a, x: a + x)
    return ST.trace_folds(spark, target).select(
        "episode", "chunk", "topic", F.size("times").alias("len"), F.array_join("times", ",").alias("times"), F.round(total, 6).alias("total")
    )
