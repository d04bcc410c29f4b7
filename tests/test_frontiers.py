import numpy as np
import pandas as pd
import pytest

from sparkassay.operators import frontiers as FR


def area(points, ref):
    hv, prev = 0.0, ref[1]
    for x, y in sorted(points):
        hv += (ref[0] - x) * max(0.0, prev - y)
        prev = min(prev, y)
    return hv


@pytest.mark.parametrize("n,levels", [(1, 5), (60, 8), (200, 50)])
def test_frontier_against_pairs(spark, n, levels):
    rng = np.random.default_rng(n)
    pts = pd.DataFrame({"run": rng.integers(0, 2, n), "c": rng.integers(0, levels, n) * 1.0, "p": rng.integers(0, levels, n) * 1.0})
    got = FR.non_dominated(spark.createDataFrame(pts), ["run"], "c", "p").toPandas()
    keep = [
        not any(((o.run == r.run) and o.c <= r.c and o.p <= r.p and (o.c < r.c or o.p < r.p)) for o in pts.itertuples())
        for r in pts.itertuples()
    ]
    key = lambda d: sorted(map(tuple, d[["run", "c", "p"]].to_numpy().tolist()))
    assert key(got) == key(pts[keep])


def test_history_with_small_blocks(spark):
    rng = np.random.default_rng(2)
    rows = [(r, i, float(rng.integers(0, 12)), float(rng.integers(0, 12))) for r in range(3) for i in range(70)]
    df = spark.createDataFrame(rows, "run int, iter long, cost double, perf double")
    got = FR.hypervolume_history(df, ["run"], (11.0, 11.0), block=8).toPandas().sort_values(["run", "iter"])
    want = []
    for r in range(3):
        seen = []
        for rr, _, c, p in rows:
            if rr == r:
                seen.append((min(c, 11.0), p))
                want.append(area(seen, (11.0, 11.0)))
    assert np.allclose(got["hv"], want)


def test_point_outside_the_reference(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 0.5)], "c double, p double")
    out = FR.hypervolume_2d(df, [], "c", "p", (4.0, 2.0)).first()
    assert out["outside"] == 1 and out["hv"] is None
    assert FR.hypervolume_2d(df, [], "c", "p", (6.0, 2.0)).first()["hv"] == pytest.approx(5.5)


def test_constant_objective_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 1.0, 7.0), (2, 3.0, 7.0)], "gidx int, a double, b double")
    rows = {r["gidx"]: r["scalar"] for r in FR.augmented_chebyshev(df, ["a", "b"], [0.5, 0.5]).collect()}
    assert rows == {1: 0.0, 2: pytest.approx(0.525)}


def test_gate_warms_up_and_excludes_the_prefix(spark):
    rows = [(i, 100.0 if i == 0 else 10.0, 0) for i in range(8)]
    df = spark.createDataFrame(rows, "iter int, seconds double, retries int")
    args = dict(window=3, trials=1, scenarios=2, max_seconds=12, max_retries=10)
    status = lambda **k: [r["status"] for r in FR.rolling_gate(df, [], **args, **k).orderBy("iter").collect()]
    assert status() == ["warming"] * 2 + ["stopped"] + ["passed"] * 5
    assert status(prefix=1) == ["warming"] * 2 + ["passed"] * 5
