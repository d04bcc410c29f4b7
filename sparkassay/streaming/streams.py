"""Ingest, folding, de-duplication, sequential tests, gates and message age as Structured Streaming queries.

Every function starts a query and returns it. Results go to Parquet below ``target``; whatever runs in
``foreachBatch`` writes one folder per batch and overwrites it on a retry, so a batch that is run twice
leaves the same files. What outlives a batch is keyed state in RocksDB (``states``): no batch reads the results or
the input of another. Rows that a state would not look at are cut before the shuffle, a batch of rows at a time.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import sequential
from ..operators.frontiers import rolling_gate
from . import states

AVAILABLE = {"availableNow": True}


def source(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of files (or of Kafka records with ``fmt="kafka"`` and its options)."""
    reader = spark.readStream.format(fmt).options(**{k: str(v) for k, v in options.items()})
    if fmt == "kafka":
        return reader.load()
    return reader.schema(schema).load(path)


def stream_ingest(stream: DataFrame, target: str, checkpoint: str, partition_by: list[str] = (), trigger=AVAILABLE) -> StreamingQuery:
    """Append every record once; the checkpoint holds the position, so a restart repeats nothing."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy(*partition_by)
        .outputMode("append")
        .trigger(**trigger)
        .start(target)
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state on disk; the session's own setting comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def stream_dedup(stream: DataFrame, target: str, checkpoint: str, uid: str = "ep_uid", trigger=AVAILABLE) -> StreamingQuery:
    """Accept a uid once across shards and batches, in whatever order they come.

    Every accepted uid stays in a keyed state on disk: nothing counts as late, so no uid is dropped or accepted again.
    """
    with rocksdb(stream.sparkSession):
        return stream_ingest(stream.dropDuplicates([uid]), target, checkpoint, trigger=trigger)


def _each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _put(df: DataFrame, root: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/batch={batch}")


BUCKETS = 1024


def _bucketed(stream: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The keys as text, exact and with nulls in pandas whatever their type, and the bucket that their keyed state is held by."""
    texts = {}
    for k in keys:
        kind, c = stream.schema[k].dataType, F.col(k)
        c = F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.hex(c) if isinstance(kind, T.BinaryType) else c
        c = c + F.lit(0.0).cast(kind) if isinstance(kind, (T.DoubleType, T.FloatType)) else c  # -0.0 is 0.0
        texts[k] = c.cast("string")
    return stream.withColumns(texts).withColumn("bucket__", F.pmod(F.xxhash64(*keys), F.lit(buckets)))


def _text_fields(keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, T.StringType()) for k in keys]


def _from_text(df: DataFrame, keys: list[str], like: DataFrame) -> DataFrame:
    columns = {}
    for k in keys:
        kind, c = like.schema[k].dataType, F.col(k)
        columns[k] = (
            F.timestamp_micros(c.cast("long")) if isinstance(kind, T.TimestampType) else F.unhex(c) if isinstance(kind, T.BinaryType) else c.cast(kind)
        )
    return df.withColumns(columns)


def stream_sprt(
    stream: DataFrame, target: str, checkpoint: str, keys: list[str], order: list[str], unsafe: Column,
    rule: sequential.SequentialRule = sequential.SequentialRule(), idle_ms: int | None = None, trigger=AVAILABLE, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Online sequential label; read it with ``sprt_state``. State per design is (n, k, mode); trials after a decision are ignored.

    Designs share ``buckets`` calls a batch, by a hash of their keys; the number must not change over restarts.
    A batch needs at most ``cap`` further trials of a design. They are cut from every batch of rows before the shuffle,
    so a design that dominates the stream does not dominate a task. Each batch stores only the designs it moved. With
    ``idle_ms`` an undecided design that had no trial for so long (processing time) is forgotten and starts anew.
    """
    slim = _bucketed(stream.select(*keys, *[c for c in order if c not in keys], unsafe.cast("int").alias("unsafe__")), keys, buckets)
    cut = slim.mapInPandas(states.first_rows(keys, order, rule.cap), slim.schema)
    out = T.StructType([*_text_fields(keys), *[T.StructField(c, T.LongType()) for c in "nk"], T.StructField("mode", T.StringType())])
    with rocksdb(stream.sparkSession):
        labels = cut.groupBy("bucket__").transformWithStateInPandas(
            states.SequentialTest(keys, order, rule, idle_ms), out, "append", "none" if idle_ms is None else "processingTime"
        )
        labels = _from_text(labels, keys, stream)
        return stream_ingest(labels, target, checkpoint, trigger=trigger)


def sprt_state(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Current label of every design seen by ``stream_sprt``."""
    df = spark.read.parquet(target).groupBy(*keys).agg(F.max(F.struct("n", "k", "mode")).alias("s"))  # n only grows
    return df.select(
        *keys,
        sequential.mode_label(F.col("s.mode")).alias("label"),
        F.coalesce("s.mode", F.lit("INSUFFICIENT_EPISODES")).alias("mode"),
        "s.n",
        "s.k",
    )


def stream_gate(
    stream: DataFrame, target: str, checkpoint: str, *, window: int, trials: int, scenarios: int, max_seconds: float,
    max_retries: float, trigger=AVAILABLE,
) -> StreamingQuery:
    """Operational gate over the newest ``window`` designs after every batch: iter, seconds, retries in.

    The state is these designs. A task sends at most ``window`` rows of each batch of rows; a batch stores the state below
    ``target`` and its verdict from there, so its input is read once.
    """
    rows = stream.select(F.col("iter").cast("long"), F.col("seconds").cast("double"), F.col("retries").cast("double"))
    top = rows.mapInPandas(states.newest(window), rows.schema)
    with rocksdb(stream.sparkSession):
        held = top.withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(states.Newest(window), rows.schema, "update", "none")

        def work(batch: DataFrame, number: int) -> None:
            _put(batch, f"{target}/newest", number)  # the gate takes several jobs, each of which would run the whole batch anew
            stored = stream.sparkSession.read.schema(rows.schema).parquet(f"{target}/newest/batch={number}")
            gate = rolling_gate(
                stored, [], window=window, trials=trials, scenarios=scenarios, max_seconds=max_seconds, max_retries=max_retries
            )
            _put(gate.orderBy(F.col("iter").desc()).limit(1), f"{target}/status", number)

        return _each_batch(held, work, checkpoint, trigger, "update")


class Chain:
    """Two queries of which the second reads what the first has stored; both end together."""

    def __init__(self, first: StreamingQuery, second: Callable[[], StreamingQuery], bounded: bool):
        self.first = first
        if bounded:
            first.awaitTermination()
        self.second = second()

    def awaitTermination(self, timeout: int | None = None):
        return self.second.awaitTermination(timeout) if timeout else self.second.awaitTermination()

    def stop(self) -> None:
        self.first.stop()
        self.second.stop()

    @property
    def recentProgress(self):
        return self.second.recentProgress


def stream_checkpoint_log(
    stream: DataFrame, target: str, checkpoint: str, keys: list[str], result: Callable[[DataFrame], DataFrame], trigger=AVAILABLE
) -> Chain:
    """Raw episodes are durable before their results are; read the log with ``checkpoint_log``.

    One query stores the episodes; a second one reads the stored files as a stream and keeps ``result``, any streaming
    aggregation by ``keys``, as mergeable buffers per key in its state. A batch reads its own new files only and logs the
    results of the keys it touched as a new version: a trial that is spread over batches ends with the result of the
    whole trial.
    """
    spark, raw, log = stream.sparkSession, f"{target}/episodes", f"{target}/results"

    def results() -> StreamingQuery:
        stored = spark.readStream.schema(stream.schema).parquet(raw)
        with rocksdb(spark):
            return _each_batch(result(stored), lambda batch, number: _put(batch, log, number), f"{checkpoint}/results", trigger, "update")

    first = stream_ingest(stream, raw, f"{checkpoint}/episodes", trigger=trigger)
    return Chain(first, results, bool(trigger.get("availableNow") or trigger.get("once")))


def checkpoint_log(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The newest logged result of every key."""
    log = spark.read.parquet(f"{target}/results")
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return newest.select(*keys, *[F.col(f"s.{c}").alias(c) for c in rest])


def stream_message_age(
    stream: DataFrame, target: str, checkpoint: str, keys: list[str], event_time: str | None = None, idle: str = "1 hour", trigger=AVAILABLE,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Age of the freshest message of each target at every decision; read the answers with ``message_ages``.

    Input: keys, t, is_decision, id, time_stamp. A decision sees only messages received up to its own time, whichever
    batch brings them. The state of a target is a staircase, the messages fresher than all received before them, and the
    decisions that a late message may still change: a batch answers its own decisions and those older ones that its
    messages improve. With an ``event_time`` column a timer ends the wait ``idle`` after it: decisions up to the watermark
    leave the state, and all steps but the last up to it. Without one no record is ever late and the state keeps all.
    Targets share ``buckets`` calls a batch, by a hash of their keys; the number must not change over restarts.
    """
    low = F.lit(states.NEVER)
    clock = F.lit(0).cast("long") if event_time is None else F.unix_millis(event_time)
    if event_time is not None:
        stream = stream.withWatermark(event_time, idle)
    long = lambda c: F.coalesce(F.col(c).cast("long"), low).alias(c)
    rows = _bucketed(stream.where("is_decision OR id IS NOT NULL"), keys, buckets).select(
        "bucket__", *keys, F.coalesce("is_decision", F.lit(False)).alias("is_decision"), long("t"), long("id"), long("time_stamp"), clock.alias("at"),
        *([] if event_time is None else [event_time]),
    )
    out = T.StructType([*_text_fields(keys), *[T.StructField(c, T.LongType()) for c in ("decision", "t", "msg_id", "age")]])
    wait = None if event_time is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    with rocksdb(stream.sparkSession):
        ages = rows.groupBy("bucket__").transformWithStateInPandas(
            states.MessageAges(keys, wait), out, "append", "none" if event_time is None else "eventTime"
        )
        ages = _from_text(ages, keys, stream)
        return stream_ingest(ages, target, checkpoint, trigger=trigger)


def message_ages(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The freshest answer of every decision: keys, decision, t, msg_id, age (null without a message)."""
    found = spark.read.parquet(target)
    best = F.max(F.when(F.col("msg_id").isNotNull(), F.struct((-F.col("age")).alias("fresh"), "msg_id"))).alias("s")
    return found.groupBy(*keys, "decision", "t").agg(best).select(
        *keys, "decision", "t", F.col("s.msg_id").alias("msg_id"), (-F.col("s.fresh")).alias("age")
    )


FOLD_OUT = "episode BIGINT, chunk BIGINT, topic STRING, times ARRAY<BIGINT>, ids ARRAY<BIGINT>, vals ARRAY<DOUBLE>, complete BOOLEAN"
CHUNK_RECORDS = 100_000


def stream_trace_fold(
    stream: DataFrame, target: str, checkpoint: str, chunk_ms: int, event_time: str | None = None, idle: str = "1 hour", trigger=AVAILABLE,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Fold records per (episode, time chunk) until the episode's termination record; read with ``trace_folds``.

    Input: episode, topic, t (ms since the start of the episode), id, v, cause (set on the termination
    record only). A termination is copied to every chunk up to its time, so chunks close on their own
    and a long episode never sits in one state. No record is lost: a chunk of more than ``CHUNK_RECORDS``
    records gives out a part before its end, a record that comes after the termination gives a part of
    its own, and with an ``event_time`` column a chunk whose watermark is ``idle`` past its last record
    (an abandoned episode) gives out what it has with ``complete`` false and leaves the state. Chunks share
    ``buckets`` calls a batch, by a hash of episode and chunk; the number must not change over restarts.
    """
    here = F.floor(F.col("t") / chunk_ms).cast("bigint")
    chunks = F.when(F.col("cause").isNotNull(), F.sequence(F.lit(0).cast("bigint"), here)).otherwise(F.array(here))
    clock = F.lit(0).cast("long") if event_time is None else F.unix_millis(event_time)
    if event_time is not None:
        stream = stream.withWatermark(event_time, idle)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(states.NEVER)).alias(c)
    spread = stream.withColumn("home", here).withColumn("chunk", F.explode(chunks)).select(
        F.pmod(F.xxhash64("episode", "chunk"), F.lit(buckets)).alias("bucket__"), whole("episode"), whole("chunk"), "topic", whole("t"), whole("id"),
        F.col("v").cast("double").alias("v"), F.col("cause").isNotNull().cast("long").alias("ends"),
        F.col("home").eqNullSafe(F.col("chunk")).cast("long").alias("own"), clock.alias("at"), *([] if event_time is None else [event_time]),
    )
    wait = None if event_time is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    with rocksdb(stream.sparkSession):
        folded = spread.groupBy("bucket__").transformWithStateInPandas(
            states.TraceFold(CHUNK_RECORDS, wait), FOLD_OUT, "append", "none" if event_time is None else "eventTime"
        )
        return stream_ingest(folded, target, checkpoint, trigger=trigger)


def trace_folds(spark: SparkSession, target: str) -> DataFrame:
    """One row per (episode, chunk, topic) from all its parts, in order of time and id; ``complete`` once it has ended."""
    each = spark.read.parquet(target).select("episode", "chunk", "topic", "complete", F.arrays_zip("times", "ids", "vals").alias("part"))
    whole = each.groupBy("episode", "chunk", "topic").agg(
        F.array_sort(F.flatten(F.collect_list("part"))).alias("all"), F.bool_or("complete").alias("complete")
    )
    return whole.select("episode", "chunk", "topic", *[F.col(f"all.{c}").alias(c) for c in ("times", "ids", "vals")], "complete")
