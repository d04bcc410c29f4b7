import corpus_pipeline
import __spark_entry__ as entry


def test_stages_keep_the_columns_and_follow_each_other(spark, sf, folder):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema, rows = docs.schema, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert docs.schema == schema
            assert docs.count() <= rows
            rows = docs.count()
            kept = {r["doc_id"]: r for r in docs.collect()}
    assert {r["doc_id"] for r in docs.collect()} == set(kept)
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())


def test_stages_take_edges(spark, sf, edge, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge, empty):
            out = stage(spark, docs, sf)
            out.count()
            if name != "packing":
                assert out.columns == docs.columns


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
