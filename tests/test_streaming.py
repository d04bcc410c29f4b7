"""Streams against the batch operators on the same rows, for different cuts into micro-batches."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkassay.operators import sequential as S
from sparkassay.operators import traces as T
from sparkassay.streaming import states
from sparkassay.streaming import streams as ST


def feed(spark, folder, df, order, parts, shuffle=False):
    """Write ``parts`` files in row order, or in random order, and stream them one per batch."""
    pdf = df.toPandas().sort_values(order)
    pdf = pdf.sample(frac=1, random_state=3) if shuffle else pdf
    for i, idx in enumerate(np.array_split(np.arange(len(pdf)), parts)):
        spark.createDataFrame(pdf.iloc[idx], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return ST.source(spark, f"{folder}/in", df.schema, maxFilesPerTrigger=1)


@pytest.mark.parametrize("parts", [1, 5])
def test_online_label_equals_offline(spark, folder, parts):
    rng = np.random.default_rng(4)
    rows = [(g, i, int(rng.random() < (0.0, 0.03, 0.3)[g % 3])) for i in range(100) for g in range(9)]
    df = spark.createDataFrame(rows, "gidx long, ord long, bad int")
    stream = feed(spark, folder, df, ["ord", "gidx"], parts)
    ST.stream_sprt(stream, f"{folder}/out", f"{folder}/cp", ["gidx"], ["ord"], F.col("bad") == 1).awaitTermination()
    got = sorted(map(tuple, ST.sprt_state(spark, f"{folder}/out", ["gidx"]).collect()))
    want = S.sprt_label(df, ["gidx"], ["ord"], F.col("bad") == 1).drop("llr")
    assert got == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize(("parts", "shuffle"), [(1, False), (4, False), (5, True)])
def test_message_age_equals_batch(spark, folder, parts, shuffle):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 3)), t, bool(rng.random() < 0.4), t, t - int(rng.integers(0, 50))) for t in range(120)]
    df = spark.createDataFrame(rows, "episode long, t long, is_decision boolean, id long, time_stamp long")
    stream = feed(spark, folder, df, ["t"], parts, shuffle)
    ST.stream_message_age(stream, f"{folder}/out", f"{folder}/cp", ["episode"]).awaitTermination()
    got = sorted(map(str, ST.message_ages(spark, f"{folder}/out", ["episode"]).select("episode", "decision", "t", "msg_id", "age").collect()))
    d = df.where("is_decision").withColumnRenamed("id", "decision")
    m = df.where("NOT is_decision").withColumnRenamed("id", "msg_id")
    want = T.latest_message_asof(d, m, ["episode"]).select("episode", "decision", "t", "msg_id", "age")
    assert got == sorted(map(str, want.collect()))


def test_restart_repeats_nothing(spark, folder):
    df = spark.range(20).select(F.col("id").alias("t"))
    for _ in range(2):
        stream = feed(spark, folder, df, ["t"], 2)
        ST.stream_ingest(stream, f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 40
    ST.stream_ingest(ST.source(spark, f"{folder}/in", df.schema), f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert spark.read.parquet(f"{folder}/out").count() == 40


@pytest.mark.parametrize("shuffle", [False, True])
def test_uid_is_accepted_once_over_batches(spark, folder, shuffle):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"u{i % 7}", at + dt.timedelta(days=i)) for i in range(30)], "ep_uid string, ts timestamp")
    ST.stream_dedup(feed(spark, folder, df, ["ts"], 3, shuffle), f"{folder}/out", f"{folder}/cp").awaitTermination()
    assert sorted(r["ep_uid"] for r in spark.read.parquet(f"{folder}/out").collect()) == [f"u{i}" for i in range(7)]


@pytest.mark.parametrize("shuffle", [False, True])
def test_log_ends_with_whole_trials(spark, folder, shuffle):
    df = spark.createDataFrame([(i % 6, i) for i in range(30)], "key long, t long")
    result = lambda d: d.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("s"))
    ST.stream_checkpoint_log(feed(spark, folder, df, ["t"], 3, shuffle), f"{folder}/out", f"{folder}/cp", ["key"], result).awaitTermination()
    got = ST.checkpoint_log(spark, f"{folder}/out", ["key"])
    assert sorted(map(str, got.collect())) == sorted(map(str, result(df).collect()))
    assert spark.read.parquet(f"{folder}/out/episodes").count() == 30


def test_gate_follows_the_newest_designs(spark, folder):
    df = spark.createDataFrame([(i, 5.0 if i < 8 else 50.0, 0) for i in range(12)], "iter long, seconds double, retries int")
    stream = feed(spark, folder, df, ["iter"], 3)
    ST.stream_gate(
        stream, f"{folder}/out", f"{folder}/cp", window=4, trials=1, scenarios=2, max_seconds=12, max_retries=10
    ).awaitTermination()
    got = spark.read.parquet(f"{folder}/out/status").orderBy("batch").collect()
    assert [r["status"] for r in got] == ["passed", "passed", "stopped"]


@pytest.mark.parametrize(("parts", "shuffle", "most"), [(1, False, 100_000), (4, False, 100_000), (4, True, 100_000), (3, True, 2)])
def test_fold_waits_for_the_end(spark, folder, monkeypatch, parts, shuffle, most):
    monkeypatch.setattr(ST, "CHUNK_RECORDS", most)
    rows = [(e, "ab"[i % 2], i * 10, i, float(i), "end" if i == 19 and e < 2 else None) for e in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "episode long, topic string, t long, id long, v double, cause string")
    ST.stream_trace_fold(feed(spark, folder, df, ["t", "episode"], parts, shuffle), f"{folder}/out", f"{folder}/cp", 60).awaitTermination()
    got = ST.trace_folds(spark, f"{folder}/out").toPandas()
    got = got[got["complete"]]
    assert sorted(got["episode"].unique()) == [0, 1]  # episode 2 never ended
    for e in (0, 1):
        for topic, odd in (("a", 0), ("b", 1)):
            mine = got[(got.episode == e) & (got.topic == topic)].sort_values("chunk")
            assert [x for v in mine["vals"] for x in v] == [float(i) for i in range(20) if i % 2 == odd]
            assert all(t // 60 == c for c, ts in zip(mine["chunk"], mine["times"]) for t in ts)


def test_sequential_state_is_one_row_per_design(spark, folder):
    """A batch reads its own rows only, and the state holds a row per design whatever came before."""
    rows = [(g, i, 0) for i in range(200) for g in range(5)]
    df = spark.createDataFrame(rows, "gidx long, ord long, bad int")
    query = ST.stream_sprt(feed(spark, folder, df, ["ord", "gidx"], 4), f"{folder}/out", f"{folder}/cp", ["gidx"], ["ord"], F.col("bad") == 1)
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [250] * 4
    assert [p["stateOperators"][0]["numRowsTotal"] for p in batches] == [5] * 4
    assert spark.read.parquet(f"{folder}/out").count() == 10  # settled designs are not stored again
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ST.ROCKSDB


def test_cut_keeps_the_first_trials_of_a_hot_design(spark):
    cut = states.first_rows(["g"], ["t"], 3)
    f = pd.DataFrame({"g": [1] * 50 + [2, None, None], "t": [*range(50, 0, -1), 7, 2, 1], "unsafe__": 0})
    got = pd.concat(cut(iter([f, f])))
    assert len(got) == 2 * 6 and sorted(got[got.g == 1].t) == [1, 1, 2, 2, 3, 3]


def test_staircase():
    rng = np.random.default_rng(1)
    rows = np.column_stack([rng.integers(0, 30, 200), rng.integers(0, 40, 200), np.arange(200), np.zeros(200, int)])
    steps = states.staircase(rows)
    assert (np.diff(steps[:, 0]) > 0).all() and (np.diff(steps[:, 1]) >= 0).all() and len(steps) <= 30
    for t, (stamp, message) in zip(range(-1, 32), states.answers(steps, np.arange(-1, 32)).tolist()):
        seen = rows[rows[:, 0] <= t]
        assert (stamp, message) == (max(map(tuple, seen[:, 1:3].tolist())) if len(seen) else (states.NEVER,) * 2)


def test_late_messages_change_open_decisions_only(spark, folder):
    """With a watermark a decision that is past it keeps its answer, and the steps before it leave the state."""
    start = dt.datetime(2024, 1, 1)
    day = lambda d: start + dt.timedelta(days=d)
    schema = "episode long, t long, is_decision boolean, id long, time_stamp long, ts timestamp"
    batches = [
        [(1, 10, False, 1, 5, day(0)), (1, 20, True, 2, None, day(0)), (None, 1, True, 9, None, day(0)), (1, None, False, None, 7, day(0))],
        [(1, 15, False, 3, 12, day(0)), (1, 30, False, 4, 25, day(10))],  # a late message, still in time
        [(2, 1, False, 5, 1, day(20))],  # moves the watermark past the first decisions
        [(2, 2, False, 6, 2, day(40))],
        [(1, 16, False, 7, 14, day(41)), (1, 40, True, 8, None, day(41))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = ST.source(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
        query = ST.stream_message_age(source, f"{folder}/out", f"{folder}/cp", ["episode"], event_time="ts", idle="1 day")
        query.awaitTermination()
    got = {(r["episode"], r["decision"]): (r["t"], r["msg_id"], r["age"]) for r in ST.message_ages(spark, f"{folder}/out", ["episode"]).collect()}
    assert got == {(1, 2): (20, 3, 8), (None, 9): (1, None, None), (1, 8): (40, 4, 15)}


def test_log_reads_only_new_episodes(spark, folder):
    df = spark.createDataFrame([(i % 3, i) for i in range(40)], "key long, t long")
    result = lambda d: d.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    query = ST.stream_checkpoint_log(feed(spark, folder, df, ["t"], 4), f"{folder}/out", f"{folder}/cp", ["key"], result)
    query.awaitTermination()
    assert sum(p["numInputRows"] for p in query.recentProgress) == 40


@pytest.mark.parametrize("shuffle", [False, True])
def test_gate_state_is_bounded(spark, folder, shuffle):
    df = spark.createDataFrame([(i, float(i), i % 2) for i in range(60)], "iter long, seconds double, retries int")
    limits = dict(window=5, trials=1, scenarios=1, max_seconds=1e9, max_retries=1e9)
    query = ST.stream_gate(feed(spark, folder, df, ["iter"], 3, shuffle), f"{folder}/out", f"{folder}/cp", **limits)
    query.awaitTermination()
    wide = pd.DataFrame({"iter": range(40), "seconds": 0.0, "retries": 0.0})
    assert [len(f) for f in states.newest(5)(iter([wide, wide[:3]]))] == [5, 3]
    last = spark.read.parquet(f"{folder}/out/status").orderBy(F.desc("batch")).first()
    assert (last["iter"], last["seconds_per_trial"]) == (59, 57.0)


def test_chunk_parts_hold_every_record():
    rng = np.random.default_rng(2)
    held = [rng.choice(["a", "b", None], 60).tolist(), rng.integers(0, 9, 60).tolist(), rng.permutation(60).tolist(), rng.random(60).tolist()]
    got = states.topic_parts((4, 7), held, True)
    rows = sorted(zip(held[1], held[2], held[0], held[3]))
    assert set(got["topic"]) == {"a", "b", None} and set(got["complete"]) == {True} and set(got["episode"]) == {4}
    for r in got.itertuples():
        assert list(zip(r.times, r.ids, r.vals)) == [(t, i, v) for t, i, topic, v in rows if topic == r.topic]
    assert len(states.topic_parts((4, 7), [[], [], [], []], False)) == 0


def test_gate_reads_a_batch_once(spark, folder, monkeypatch):
    """The several jobs of the gate read the stored state, not the batch with its input and keyed state."""
    read, gate = [], ST.rolling_gate
    monkeypatch.setattr(ST, "rolling_gate", lambda batch, *args, **limits: read.append(batch.inputFiles()) or gate(batch, *args, **limits))
    df = spark.createDataFrame([(i, 1.0, 0) for i in range(30)], "iter long, seconds double, retries int")
    limits = dict(window=5, trials=1, scenarios=1, max_seconds=1e9, max_retries=1e9)
    ST.stream_gate(feed(spark, folder, df, ["iter"], 1), f"{folder}/out", f"{folder}/cp", **limits).awaitTermination()
    assert len(read) == 1 and read[0] and all("/out/newest/" in f for f in read[0])


def test_targets_and_designs_share_calls(spark, folder):
    """One bucket holds all keys, nulls and large whole numbers among them, with the same results."""
    keys = [None, *[(1 << 60) + i for i in range(20)]]
    rows = [(k, i, i % 3 == 0, i, i - 7 * (i % 5)) for i in range(40) for k in keys]
    schema = "episode long, t long, is_decision boolean, id long, time_stamp long"
    for i in (2, 0, 1):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = ST.source(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, maxFilesPerTrigger=1)
    query = ST.stream_message_age(source, f"{folder}/ages", f"{folder}/cp", ["episode"], buckets=1)
    query.awaitTermination()
    assert {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]} == {1}
    got = {(r["episode"], r["decision"]): (r["msg_id"], r["age"]) for r in ST.message_ages(spark, f"{folder}/ages", ["episode"]).collect()}
    want = {}
    for k, t, asks, i, _ in rows:
        best = max(((s, m) for e, u, a, m, s in rows if e == k and u <= t and not a), default=None)
        if asks:
            want[k, i] = (best[1], t - best[0]) if best else (None, None)
    assert got == want
    bad = F.col("t") % 19 == 3
    ST.stream_sprt(source, f"{folder}/out", f"{folder}/cp2", ["episode"], ["t"], bad, buckets=1).awaitTermination()
    labels = {r["episode"] for r in ST.sprt_state(spark, f"{folder}/out", ["episode"]).collect()}
    assert labels == set(keys)


@pytest.mark.parametrize("most", [100_000, 5])
def test_chunks_share_calls(spark, folder, monkeypatch, most):
    """One bucket holds all chunks, nulls and large whole numbers among them: a call and a state value, and no record is lost."""
    monkeypatch.setattr(ST, "CHUNK_RECORDS", most)
    keys = [None, *[(1 << 60) + i for i in range(20)]]
    rows = [
        (k, [None, "a", "b"][i % 3], i * 10, (1 << 60) + i, None if i % 7 == 0 else i / 3, "end" if i == 37 and k != keys[-1] else None)
        for i in range(40) for k in keys
    ]
    schema = "episode long, topic string, t long, id long, v double, cause string"
    for i in (2, 0, 1):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = ST.source(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, maxFilesPerTrigger=1)
    query = ST.stream_trace_fold(source, f"{folder}/out", f"{folder}/cp", 60, buckets=1)
    query.awaitTermination()
    assert {p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]} == {1}
    got = {(r["episode"], r["chunk"], r["topic"]): r for r in ST.trace_folds(spark, f"{folder}/out").collect()}
    want = {}
    for k, topic, t, i, v, _ in rows:
        want.setdefault((k, t // 60, topic), []).append((t, i, v))
    ended = {key for key in want if key[0] != keys[-1]}
    whole = set(got) if most == 5 else ended
    assert set(got) >= ended and set(got) == whole
    for key in ended:
        assert list(zip(got[key]["times"], got[key]["ids"], got[key]["vals"])) == sorted(want[key], key=lambda x: x[:2])
        assert got[key]["complete"]


def test_an_abandoned_chunk_gives_what_it_has(spark, folder):
    start = dt.datetime(2024, 1, 1)
    day = lambda d: start + dt.timedelta(days=d)
    schema = "episode long, topic string, t long, id long, v double, cause string, ts timestamp"
    batches = [
        [(1, "a", 5, 1, 0.5, None, day(0)), (1, "a", 65, 2, 0.5, None, day(0)), (2, "a", 5, 3, 0.5, "end", day(0))],
        [(3, "a", 5, 4, 0.5, None, day(10))],  # moves the watermark past the wait of episodes 1 and 2
        [(4, "a", 5, 5, 0.5, None, day(20))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = ST.source(spark, f"{folder}/in", spark.createDataFrame([], schema).schema)
        ST.stream_trace_fold(source, f"{folder}/out", f"{folder}/cp", 60, event_time="ts", idle="1 day").awaitTermination()
    got = {(r["episode"], r["chunk"]): (r["ids"], r["complete"]) for r in ST.trace_folds(spark, f"{folder}/out").collect()}
    assert got[1, 0] == ([1], False) and got[1, 1] == ([2], False) and got[2, 0] == ([3], True) and (4, 0) not in got
