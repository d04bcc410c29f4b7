import numpy as np
import pytest

from sparkassay.llm import quantised
from sparkassay.llm.queries import QUERIES


def brute(ids, vectors):
    """id -> (links, component) by all pairs; None is a vector that links with nothing."""
    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in vectors]
    links = np.zeros(len(ids), int)
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for s in {len(v) for v, good in zip(vectors, usable) if good}:
        at = [i for i, good in enumerate(usable) if good and len(vectors[i]) == s]
        x = np.asarray([vectors[i] for i in at], float)
        x /= np.abs(x).max(1)[:, None]
        x /= np.linalg.norm(x, axis=1)[:, None]
        for k, i in enumerate(at):
            near = np.flatnonzero(x @ x[k] >= 0.95)
            links[i] = len(near) - 1
            for j in near:
                root[max(top(i), top(at[j]))] = min(top(i), top(at[j]))
    groups = {}
    for i, name in enumerate(ids):
        groups.setdefault(top(i), []).append(name)
    lowest = {k: min((n for n in g if n is not None), default=None) for k, g in groups.items()}
    return sorted(((n, int(links[i]), lowest[top(i)], lowest[top(i)] is None or n == lowest[top(i)]) for i, n in enumerate(ids)), key=str)


def frame(spark, ids, vectors):
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    return df.selectExpr("*", "0 AS id", "'a' AS v", "1 AS class", "2 AS n", "3 AS size").repartition(5)


def check(spark, ids, vectors):
    got = quantised.near_duplicates(frame(spark, ids, vectors)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == brute(ids, vectors)


def planted(rng, groups, size, spread):
    """Groups of near copies of random directions; many pairs lie near the limit."""
    out = []
    for n in groups:
        centre = rng.normal(size=size)
        noise = rng.normal(size=(n, size)) * np.linalg.norm(centre) / np.sqrt(size) * rng.uniform(0, spread, size=n)[:, None]
        out += (centre + noise).tolist()
    return out


@pytest.fixture()
def small(monkeypatch):
    """Limits that cut these tables into many lists, parts and lanes."""
    for name, value in (("CELL_ROWS", 16), ("BLOCK_ROWS", 64), ("LEAST_ROWS", 40), ("VISITORS", 150), ("STEP", 17)):
        monkeypatch.setattr(quantised, name, value)


def test_many_blocks(spark, small):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(500, 24)).tolist() + planted(rng, [150, 40, 5, 2], 24, 0.45)
    vectors += vectors[500:505] * 3 + [[2 * c for c in vectors[0]]]
    check(spark, rng.permutation(len(vectors)).tolist(), vectors)


def test_few_dimensions(spark, small):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 3)).tolist()
    check(spark, list(range(300)), vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 1.0], [1.0, 1.01], [1.0, 1.0, 0.0], [1e300, 1e300], [1e-300, 1e-300], [-0.0, 1.0], [0.0, 1.0], [1.0, 1.0]]
    check(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, None], vectors)
    check(spark, [5, 5, 5, 4, None, None], [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0], [0.0, 1.0], [-1.0, 0.0]])
    assert quantised.near_duplicates(frame(spark, [], [])).collect() == []


def test_borders_between_lists():
    """Each pair within reach is within half of it of the plane between its lists, from one side at least."""
    rng = np.random.default_rng(3)
    x = np.asarray(planted(rng, [2] * 600, 8, 0.6))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    q = quantised.Quantiser(u[::3], 40, 0.95)
    cell, codes, length, error = q.encode(u)
    asks = q.probed(u, cell, np.arange(len(q.centres)))
    a, b = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    apart = cell[a] != cell[b]
    assert apart.sum() > 20 and (asks[a, cell[b]] | asks[b, cell[a]] | ~apart).all()
    stood = q.centres[cell] + np.concatenate([book[codes[:, m]] for m, book in enumerate(q.books)], 1)[:, :8]
    assert np.allclose(np.linalg.norm(u - stood, axis=1), error) and np.allclose((stood**2).sum(1), length)
    look = q.tables(u).reshape(len(u), len(q.books), -1)
    dots = (u[:50] @ q.centres[cell].T) + sum(look[:50, m][:, codes[:, m]] for m in range(len(q.books)))
    assert np.allclose(dots, u[:50] @ stood.T, atol=1e-5)


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = QUERIES["op11_vector_duplicates"](spark, sf).collect()
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows), key=str)
    assert got == brute([r["vec_id"] for r in table], [r["embedding"] for r in table])
