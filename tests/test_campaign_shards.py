"""Shards written and read by the data source: places, digests, plans and cursors."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from sparkassay.schemas import CAMPAIGN_ROW
from sparkassay.sources import campaign_shards as CS

ROW = {"failure": True, "log_weight": -0.5, "route_signature": "r"}


def put(folder, job, shard, rows, digest="right"):
    where = f"{folder}/{job}/sample-shards"
    os.makedirs(where, exist_ok=True)
    text = "".join(json.dumps(ROW | {"route_signature": str(r)}) + "\n" for r in rows)
    if text is not None:
        open(f"{where}/{shard:06d}.jsonl", "w").write(text)
    noted = {"right": json.dumps({"sha256": hashlib.sha256(text.encode()).hexdigest()}), "wrong": json.dumps({"sha256": "0" * 64}), "bad": "{"}
    if digest in noted:
        open(f"{where}/{shard:06d}.sha256.json", "w").write(noted[digest])


def test_places_and_fields(spark, folder):
    for shard in (0, 2, 10):
        put(folder, "j", shard, range(shard * 100, shard * 100 + 5))
    open(f"{folder}/j/sample-shards/notes.txt", "w").write("other")
    got = CS.parsed(CS.scan(spark, folder), CAMPAIGN_ROW).orderBy("shard", "ordinal").collect()
    assert [(r["job"], r["shard"], r["ordinal"], r["route_signature"]) for r in got] == [("j", s, i, str(s * 100 + i)) for s in (0, 2, 10) for i in range(5)]
    assert all(r["failure"] and r["log_weight"] == -0.5 for r in got)
    assert CS.scan(spark, f"{folder}/nothing").collect() == []


def test_every_problem_gives_a_row(spark, folder):
    put(folder, "a", 0, range(4))
    put(folder, "a", 1, range(4), digest="wrong")
    put(folder, "a", 2, range(4), digest=None)
    put(folder, "a", 3, [], digest="bad")
    put(folder, "b", 0, range(3))
    path = f"{folder}/b/sample-shards/000000.jsonl"
    text = open(path, "rb").read()
    open(path, "wb").write(text[: len(text) // 2])  # cut short in the middle of a line
    open(f"{folder}/b/sample-shards/000001.sha256.json", "w").write("{}")
    put(folder, "d", 0, range(2))
    plan = spark.createDataFrame([("a", 12), ("b", 3), ("c", 5), ("d", 2)], "key string, episodes long")
    scanned = CS.scan(spark, folder)
    got = {(r["job"], r["shard"], r["problem"], r["found"], r["expected"]) for r in CS.problems(scanned, plan).collect()}
    assert got == {
        ("a", 1, "digest mismatch", None, None), ("a", 2, "missing digest", None, None), ("a", 3, "unreadable digest", None, None),
        ("b", 0, "digest mismatch", None, None), ("b", 1, "missing shard", None, None), ("b", None, "row count", 2, 3), ("c", None, "no shards", None, 5),
    }
    lone = CS.problems(scanned, plan.where("key <> 'd'")).where("job = 'd'").collect()
    assert [(r["problem"], r["found"]) for r in lone] == [("not planned", 2)]
    cut = CS.parsed(scanned, CAMPAIGN_ROW).where("job = 'b'").orderBy("ordinal").collect()
    assert [r["failure"] for r in cut] == [True, None]


def test_lines_over_blocks(monkeypatch, tmp_path):
    text = "\n".join(["", "a" * 50, "  ", "b", "é" * 20, "", "last"])
    (tmp_path / "x").write_text(text)
    for size in (1, 3, 7, 1000):
        monkeypatch.setattr(CS, "BLOCK", size)
        digest = hashlib.sha256()
        with open(tmp_path / "x", "rb") as f:
            assert list(CS._lines(f, digest)) == ["a" * 50, "b", "é" * 20, "last"]
        assert digest.hexdigest() == hashlib.sha256(text.encode()).hexdigest()


def test_written_shards_come_back(spark, folder):
    rows = spark.range(250).select(
        F.concat(F.lit("job"), F.col("id") % 3).alias("job"), F.floor(F.col("id") / 30).cast("int").alias("shard"), F.col("id").alias("ordinal"),
        F.to_json(F.struct(F.col("id").alias("x"))).alias("line"),
    ).repartition(7)
    CS.write(rows, folder)
    back = CS.scan(spark, folder)
    assert back.where("problem IS NOT NULL").isEmpty()
    want = sorted((r["job"], r["shard"], r["line"]) for r in rows.collect())
    assert sorted((r["job"], r["shard"], r["line"]) for r in back.collect()) == want
    order = back.withColumn("x", F.from_json("line", "x long")["x"]).orderBy("job", "shard", "ordinal").collect()
    assert all(a["x"] < b["x"] for a, b in zip(order, order[1:]) if a["job"] == b["job"])
    assert not [f for _, _, files in os.walk(folder) for f in files if "draft" in f]


def test_cursor_of_each_job(spark, folder):
    def run():
        query = CS.stream(spark, f"{folder}/in").writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp")
        query.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        return sorted((r["job"], r["shard"], r["n"]) for r in spark.read.parquet(f"{folder}/out").groupBy("job", "shard").agg(F.count("line").alias("n")).collect())

    put(f"{folder}/in", "a", 0, range(3))
    put(f"{folder}/in", "b", 0, range(2))
    put(f"{folder}/in", "b", 1, range(2), digest=None)  # not complete yet
    put(f"{folder}/in", "b", 2, range(9))
    assert run() == [("a", 0, 3), ("b", 0, 2)]
    put(f"{folder}/in", "b", 1, range(2))
    put(f"{folder}/in", "c", 0, range(1))
    assert run() == [("a", 0, 3), ("b", 0, 2), ("b", 1, 2), ("b", 2, 9), ("c", 0, 1)]


def test_small_shards_share_a_task(spark, folder, monkeypatch):
    for shard in range(60):
        put(folder, "j", shard, range(shard, shard + 2), digest="wrong" if shard == 7 else "right")
    scanned = CS.scan(spark, folder)
    assert scanned.rdd.getNumPartitions() == 1
    got = scanned.where("problem IS NULL").orderBy("shard", "ordinal").collect()
    assert [(r["shard"], r["ordinal"]) for r in got] == [(s, i) for s in range(60) for i in range(2)]
    assert [r["shard"] for r in scanned.where("problem IS NOT NULL").collect()] == [7]
    monkeypatch.setattr(CS, "PARTITION_BYTES", 10 * CS.OPEN_BYTES)
    runs = CS.packed(CS.shards(folder))
    assert [x.shard for run in runs for x in run.shards] == list(range(60)) and 6 <= len(runs) <= 7


def test_the_driver_learns_runs_not_shards(spark, folder, monkeypatch):
    for job in "ab":
        for shard in range(30):
            put(folder, job, shard, range(shard, shard + 2), digest="wrong" if shard == 7 else "right")
    monkeypatch.setattr(CS, "shards", None)  # planning lists no shard
    runs = CS.listed(spark, folder)
    monkeypatch.setattr(CS, "PARTITION_BYTES", 1)
    reader = CS.Reader(folder, runs)
    parts = reader.partitions()
    assert [len(p.names) for p in parts] == [1, 1]  # a run per job, whatever its shards
    got = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert [(r["job"], r["shard"], r["ordinal"]) for r in got if r["problem"] is None] == [(j, s, i) for j in "ab" for s in range(30) for i in range(2)]
    assert [(r["job"], r["shard"]) for r in got if r["problem"]] == [("a", 7), ("b", 7)]


def test_renames_are_handed_out_in_bounded_numbers(folder, monkeypatch):
    at_once = []

    class Pool(CS.ThreadPoolExecutor):
        def map(self, fn, names):
            at_once.append(len(names))
            return super().map(fn, names)

    monkeypatch.setattr(CS, "ThreadPoolExecutor", Pool)
    monkeypatch.setattr(CS, "NAMED", 8)
    rows = [{"job": "j", "shard": s, "line": "{}"} for s in range(25)]
    writer = CS.Writer(folder)
    writer.commit([writer.write(iter(rows)), None])
    assert max(at_once) <= 8 and sum(at_once) == 50
    assert [x.shard for x in CS.shards(folder) if x.path and x.digest] == list(range(25))


def test_every_shard_that_was_checked_leaves_a_row(spark, folder):
    put(folder, "empty", 0, [])
    put(folder, "empty", 1, [])
    put(folder, "twice", 7, range(3))
    put(folder, "other", 7, range(2), digest="wrong")
    for end in ("jsonl", "sha256.json"):  # the same number by another name
        os.rename(f"{folder}/other/sample-shards/000007.{end}", f"{folder}/twice/sample-shards/7.{end}")
    scanned = CS.scan(spark, folder)
    got = scanned.groupBy("job").agg(F.count("line").alias("rows"), F.bool_and(F.col("problem").isNull()).alias("ok")).collect()
    assert {tuple(r) for r in got} == {("empty", 0, True), ("twice", 5, False)}
    assert scanned.where("job = 'empty'").count() == 2 and CS.parsed(scanned, CAMPAIGN_ROW).where("job = 'empty'").isEmpty()
    plan = spark.createDataFrame([("empty", 4), ("twice", 5)], "key string, episodes long")
    said = {tuple(r) for r in CS.problems(scanned, plan).collect()}
    assert said == {("empty", None, "row count", 0, 4), ("twice", 7, "digest mismatch", None, None)}
