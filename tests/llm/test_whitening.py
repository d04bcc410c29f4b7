import numpy as np
import pytest

from sparkassay.llm import eigen, whitening
from sparkassay.llm.queries import QUERIES


def whole(vectors):
    return [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]


def brute(vectors, k=16):
    """n, deviations, covariance of the distinct whole vectors, its falling eigenvalues."""
    x = whole(vectors)
    fit = sorted({tuple(r) for r in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    mean = np.asarray([s / n for s in sums])
    y = np.asarray(fit, float) - mean
    cov = y.T @ y / n
    return n, deviation, cov, np.linalg.eigvalsh(cov)[::-1][:k], np.asarray(x, float) - mean


def matrix(rows, ids, k):
    out = np.full((len(ids), k), np.nan)
    at = {v: i for i, v in enumerate(ids)}
    for r in rows:
        out[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    return out


def check(rows, ids, vectors):
    n, deviation, cov, values, centred = brute(vectors)
    values = values[values > 1e-9 * values[0]]
    k = len(values)
    assert len(rows) == len(ids) * k and {r["component"] for r in rows} == set(range(1, k + 1))
    assert {r["n"] for r in rows} == {n}
    expected = dict(zip(ids, deviation))
    assert all(int(r["deviation"]) == expected[r["vec_id"]] for r in rows)
    for r in rows:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        assert 0 <= r["identity_error"] <= 1e-9
    z = matrix(rows, ids, k)
    turn, *_ = np.linalg.lstsq(centred, z, rcond=None)  # vectors over the roots of their eigenvalues
    unit = turn * np.sqrt(values)
    assert np.abs(unit.T @ unit - np.eye(k)).max() < 1e-7
    assert np.abs(cov @ unit - unit * values).max() < 1e-7 * values[0]


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in table]
    rows = QUERIES["op13_whitening"](spark, sf).collect()
    check(rows, ids, [r["embedding"] for r in table])
    assert dict(QUERIES["op13_whitening"](spark, sf).dtypes)["deviation"] == "bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS id", "1 AS x", "2 AS size", "'a' AS component").repartition(5)


def test_repeats_count_once(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(40, 6)).tolist()
    ids = list(range(300))
    rows = [vectors[i] if i < 40 else [c + 1e-9 for c in vectors[7]] for i in ids]
    check(whitening.whiten(frame(spark, list(zip(ids, rows)))).collect(), ids, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(30, 3)).tolist()
    nan, inf = float("nan"), float("inf")
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 1.0, 1.0]), (104, []), (105, [1.0]), (None, good[0]), (3, good[0])]
    rows = whitening.whiten(frame(spark, list(enumerate(good)) + odd)).collect()
    assert {r["vec_id"] for r in rows} == set(range(30)) | {None}
    assert len([r for r in rows if r["vec_id"] == 3]) == 6  # a repeated key has the rows of both
    again = sorted((r["component"], r["whitened"]) for r in rows if r["vec_id"] is None)
    assert again == sorted((r["component"], r["whitened"]) for r in rows if r["vec_id"] == 0)


def test_sizes_ranks_and_none(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    flat = [[float(i), 2.0 * i, 0.0] for i in range(10)]
    pair = [[1.0, 5.0], [2.0, 1.0], [4.0, 4.0]]
    rows = whitening.whiten(frame(spark, list(enumerate(flat)) + [(20 + i, v) for i, v in enumerate(pair)])).collect()
    check([r for r in rows if r["vec_id"] < 20], list(range(10)), flat)
    check([r for r in rows if r["vec_id"] >= 20], [20, 21, 22], pair)


def test_wide_numbers(spark):
    rng = np.random.default_rng(8)
    vectors = (rng.normal(size=(20, 2)) * [1e9, 3.0]).tolist()
    check(whitening.whiten(frame(spark, list(enumerate(vectors)))).collect(), list(range(20)), vectors)
    far = whitening.whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])])).collect()
    assert {r["vec_id"] for r in far} == {1, 2, 3} and all(np.isfinite(r["whitened"]) for r in far)


@pytest.mark.parametrize("size", [1, 2, 3, 17, 90])
def test_eigen(size):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(2 * size, size))
    for m in (x.T @ x, np.eye(size) * 3, np.diag(np.arange(size) // 3 + 1.0), x.T @ x * 1e-200):
        values, vectors = eigen.principal(m, 16)
        true = np.linalg.eigvalsh(m)[::-1][:16]
        assert np.abs(values - true).max() <= 1e-12 * true[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
        assert np.abs(m @ vectors - vectors * values).max() <= 1e-11 * true[0]


def test_many_components_of_a_long_vector(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(120, 40)).tolist()
    check(whitening.whiten(frame(spark, list(enumerate(vectors)))).collect(), list(range(120)), vectors)
