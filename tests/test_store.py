import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sparkassay.operators import designs as D
from sparkassay.operators import episodes as E
from sparkassay.sources import campaigns, episode_store, tables

SPACES = (D.discrete("x", 1, 2, 3),)


def rows(spark, n=6, sc="s1"):
    return spark.range(n).select(F.lit(sc).alias("sc_name"), (F.col("id") % 3).alias("gidx"), F.col("id").alias("src"))


def append(df, path, batch):
    return episode_store.append(df, path, batch=batch, order=["src"], uid_from=["src"], spaces=SPACES, stamp_ns=7)


def test_append_is_idempotent_and_numbers_follow(spark, folder):
    path = f"{folder}/store"
    append(rows(spark), path, "b1")
    append(rows(spark), path, "b1")
    append(rows(spark, 4), path, "b2")
    got = episode_store.read(spark, path).orderBy("ep_id").collect()
    assert [r["ep_id"] for r in got] == list(range(1, 11)) and len({r["ep_uid"] for r in got}) == 10
    assert all(r["x"] == r["gidx"] + 1 for r in got)
    assert E.validate(episode_store.read(spark, path), SPACES).isEmpty()


def test_compaction_keeps_content_and_refuses_conflicts(spark, folder):
    path = f"{folder}/store"
    append(rows(spark), path, "b1")
    episode_store.read(spark, path).write.partitionBy("sc_name").mode("append").parquet(f"{folder}/twice")
    episode_store.read(spark, path).write.partitionBy("sc_name").mode("append").parquet(f"{folder}/twice")
    out = episode_store.compact(spark, f"{folder}/twice", f"{folder}/slim", "s1")
    assert out.count() == 6
    with pytest.raises(ValueError):
        episode_store.compact(spark, f"{folder}/twice", f"{folder}/slim2", "other")
    changed = episode_store.read(spark, path).withColumn("src", F.col("src") + 1)
    changed.write.partitionBy("sc_name").mode("append").parquet(f"{folder}/twice")
    with pytest.raises(ValueError):
        episode_store.compact(spark, f"{folder}/twice", f"{folder}/slim3")
    files = episode_store.read(spark, f"{folder}/twice").withColumn("file", F.col("_metadata.file_name"))
    assert E.conflict_files(files, "file").select("ep_uid").distinct().count() == 6


def test_equal_number_is_not_a_repeat(spark):
    df = spark.createDataFrame([("a", 1, "s"), ("b", 1, "s"), ("a", 2, "s"), ("c", 1, "t")], "ep_uid string, ep_id long, sc_name string")
    assert sorted(r["ep_uid"] for r in E.scan(df, "s", ["ep_id"]).collect()) == ["a", "b"]
    assert [tuple(r) for r in E.repeats(df).collect()] == [("a", 1)]


def test_roots_in_priority_order(spark):
    a = spark.createDataFrame([("u", 1, 5)], "ep_uid string, ep_id long, v int")
    b = spark.createDataFrame([("u", 1, 9), ("w", 2, 1)], "ep_uid string, ep_id long, v int")
    got = {r["ep_uid"]: (r["v"], r["root_rank"]) for r in E.merge_roots([a, b], ["ep_id"]).collect()}
    assert got == {"u": (5, 0), "w": (1, 1)}


def test_flipped_byte_is_reported(spark, folder):
    for job in ("j1", "j2"):
        d = f"{folder}/{job}/sample-shards"
        os.makedirs(d)
        for i in range(2):
            text = json.dumps({"failure": True, "log_weight": 0.0, "route_signature": "r"}) + "\n"
            open(f"{d}/{i}.jsonl", "w").write(text)
            open(f"{d}/{i}.sha256.json", "w").write(json.dumps({"sha256": hashlib.sha256(text.encode()).hexdigest()}))
    assert campaigns.digest_check(spark, folder).where("NOT ok").isEmpty()
    open(f"{folder}/j2/sample-shards/1.jsonl", "a").write(" ")
    bad = campaigns.digest_check(spark, folder).where("NOT ok").collect()
    assert len(bad) == 1 and bad[0]["file"].endswith("/j2/sample-shards/1")
    got = campaigns.read_rows(spark, folder)
    assert {(r["job"], r["shard"]) for r in got.select("job", "shard").distinct().collect()} == {(j, i) for j in ("j1", "j2") for i in (0, 1)}
    plan = spark.createDataFrame([("j1", "x", "d", 2), ("j2", "x", "d", 3), ("j3", "x", "d", 1)], "key string, scheme string, design string, episodes long")
    assert {tuple(r) for r in campaigns.count_check(got, plan).collect()} == {("j2", 3, 2), ("j3", 1, 0)}


def test_label_maps(spark, folder):
    open(f"{folder}/labels.json", "w").write('{"3": 1, "7": 0}')
    got = tables.read_map(spark, f"{folder}/labels.json", "label").collect()
    assert {(r["gidx"], r["label"]) for r in got} == {(3, "1"), (7, "0")}


def test_compaction_shuffles_contents_once(spark, folder):
    df = spark.range(3000).select(
        F.lit("s1").alias("sc_name"), (F.col("id") % 3).alias("gidx"), F.col("id").alias("ep_id"), F.sha2(F.col("id").cast("string"), 256).alias("ep_uid"),
        F.sha2((-F.col("id")).cast("string"), 512).alias("payload"),
    )
    for _ in range(2):
        df.write.partitionBy("sc_name").mode("append").parquet(f"{folder}/twice")
    assert E.screen(episode_store.read(spark, f"{folder}/twice")) == (3000, 0)
    tracker, listed = spark.sparkContext.statusTracker(), spark.sparkContext
    listed.setJobGroup("compact", "compact")
    out = episode_store.compact(spark, f"{folder}/twice", f"{folder}/slim")
    store = listed._jsc.sc().statusStore()
    jobs = tracker.getJobIdsForGroup("compact")
    stages = {s for j in jobs for s in tracker.getJobInfo(j).stageIds}
    listed.setLocalProperty("spark.jobGroup.id", None)
    sent = sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in stages if tracker.getStageInfo(s))
    assert sorted(map(tuple, out.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    size = 3000 * 2 * (64 + 128)  # the text of both copies
    assert sent < 1.5 * size
    bad = df.limit(1).withColumn("payload", F.lit("x"))
    bad.write.partitionBy("sc_name").mode("append").parquet(f"{folder}/twice")
    assert E.screen(episode_store.read(spark, f"{folder}/twice")) == (3000, 1)


def test_append_sends_no_rows_of_stored_batches(spark, folder):
    path = f"{folder}/store"
    append(rows(spark, 8), path, "b1")
    old = episode_store.read(spark, path)
    uid = E.batch_uid("b1", ["src"])
    again = E.unstored(rows(spark, 8), old, uid)
    assert again.isEmpty() and "Join" not in again._jdf.queryExecution().optimizedPlan().toString()
    other = E.unstored(rows(spark, 8), old, E.batch_uid("b2", ["src"]))
    assert other.count() == 8 and "Join" not in other._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["src"] for r in E.unstored(rows(spark, 11), old, uid).collect()) == [8, 9, 10]
    append(rows(spark, 11), path, "b1")  # a batch of which a part was stored
    got = episode_store.read(spark, path)
    assert sorted(r["src"] for r in got.collect()) == list(range(11)) and sorted(r["ep_id"] for r in got.collect()) == list(range(1, 12))
