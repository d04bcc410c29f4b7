import numpy as np

from sparkassay.llm import forest
from sparkassay.llm.queries import QUERIES


def exact(ids, vectors, q, k=20):
    score = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        score += vectors[:, d] * vectors[q, d]
    score[q] = -np.inf
    order = np.lexsort((ids, -score))[:k]
    return ids[order], score[order]


def test_recall_on_the_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.asarray([r["vec_id"] for r in rows]), np.asarray([r["embedding"] for r in rows], float)
    found = {}
    for r in QUERIES["op5_forest"](spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r)
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = total = 0
    for q, got in found.items():
        best, score = exact(ids, vectors, int(np.flatnonzero(ids == q)[0]))
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert all(a["score"] > b["score"] or (a["score"] == b["score"] and a["vec_id"] < b["vec_id"]) for a, b in zip(got, got[1:]))
        hits += len({r["vec_id"] for r in got} & set(best.tolist()))
        total += 20
    assert hits / total >= 0.9


def test_ties_lengths_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = {i: (rng.normal(size=8) * (1 + i % 3)).tolist() for i in range(1, 60)}
    vectors |= {i: [1.0] * 8 for i in range(60, 100)}
    odd = [(200, None), (220, [0.0] * 8), (240, [1.0, None] + [0.0] * 6), (260, [float("nan")] * 8), (280, [float("inf")] * 8), (300, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(list(vectors.items()) + odd, "vec_id long, embedding array<double>").selectExpr("*", "0 AS id", "1 AS v", "2 AS level")
    rows = forest.nearest(df).collect()
    assert {r["query_id"] for r in rows} == {20, 40, 60, 80}
    ids = np.asarray(list(vectors))
    table = np.asarray(list(vectors.values()))
    mine = sorted((r for r in rows if r["query_id"] == 60), key=lambda r: r["rank"])
    tied = [r["vec_id"] for r in mine if r["score"] == 8.0]
    assert tied == sorted(tied) and set(tied) <= set(range(61, 100))
    best, score = exact(ids, table, int(np.flatnonzero(ids == 60)[0]))
    assert len({r["vec_id"] for r in mine} & set(best.tolist())) >= 18 and len(mine) == 20


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in forest.nearest(few).orderBy("query_id", "rank").collect()] == [(0, 1), (0, 20), (20, 1), (20, 0)]
    assert forest.nearest(few.limit(0)).collect() == []


def recall(spark, table):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(table.tolist())], "vec_id long, embedding array<double>")
    found, ids = {}, np.arange(len(table))
    for r in forest.nearest(df).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert set(found) == set(range(0, len(table), 20))
    return np.mean([len(got & set(exact(ids, table, q)[0].tolist())) / 20 for q, got in found.items()])


def test_recall_with_varied_lengths(spark):
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(3000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert recall(spark, unit * rng.uniform(0.2, 1, 3000)[:, None]) >= 0.85
    assert recall(spark, unit * np.where(rng.random(3000) < 0.1, 3, 1)[:, None]) >= 0.85


def test_squares_beyond_a_double(spark):
    rows = [(i, [1e-200 * (1 + i), 1e-200]) for i in range(3)]
    assert {r["query_id"] for r in forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == {0}
    rows = [(i, [1e160 * (1 + i), 1.0]) for i in range(3)] + [(20, [1e-150, 0.0])]
    found = forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 20] == [2, 1, 0]
