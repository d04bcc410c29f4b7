"""Trace documents in files of their own and as lines of larger files."""

import glob

from sparkassay import session
from sparkassay.sources import campaigns
from workloads import traces as W

SMALL = "/root/testdata/sf0.001"


def test_files_do_not_grow_in_number_with_the_episodes(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{folder}/{name}")
    episodes = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()
    assert W.trace_scan(spark, SMALL).count() == episodes > 4
    assert len(glob.glob(f"{folder}/traces/*.json")) <= 4  # one per task, not one per episode


def test_documents_of_either_kind_read_alike(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: f"{folder}/{name}")
    want = sorted(map(str, W.trace_scan(spark, SMALL).collect()))
    packed = campaigns.read_traces(spark, f"{folder}/traces", lines=True)
    packed.write.option("maxRecordsPerFile", 1).json(f"{folder}/single")
    single = campaigns.read_traces(spark, f"{folder}/single")
    assert len(want) == single.count() and sorted(map(str, single.collect())) == sorted(map(str, packed.collect()))
