"""The benchmark tables as streams of files."""

import glob

from workloads import streams as W


def test_files_grow_in_number_with_the_table(spark, folder, monkeypatch):
    spark.range(4000).write.parquet(f"{folder}/part.parquet")
    monkeypatch.setattr(W, "FILE_ROWS", 100)
    monkeypatch.setattr(W, "scratch_path", lambda spark, name: f"{folder}/files")
    src = W.stream(spark, folder, "part")
    sizes = [spark.read.parquet(f).count() for f in glob.glob(f"{folder}/files/*.parquet")]
    assert sum(sizes) == 4000 and max(sizes) < 200
    query = src.writeStream.format("parquet").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(4000))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == W.PARTS
