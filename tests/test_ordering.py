import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkassay.operators import ordering as O
from sparkassay.operators.quantiles import exact_quantiles, rank_limits


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3000
    # one key holds most rows, times repeat, some values are missing
    return pd.DataFrame(
        {
            "key": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)),
            "t": rng.integers(0, 500, n),
            "id": np.arange(n),
            "x": rng.normal(size=n).round(3),
        }
    )


def test_running_equals_pandas(spark, frame):
    df = spark.createDataFrame(frame)
    out = O.running(
        df, ["key"], ["t", "id"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "lo": ("min", F.col("x")), "hi": ("max", F.col("x"))}, slices=16
    ).toPandas().sort_values("id")
    want = frame.sort_values(["key", "t", "id"])
    g = want.groupby("key")["x"]
    want = want.assign(n=g.cumcount() + 1, s=g.cumsum(), lo=g.cummin(), hi=g.cummax()).sort_values("id")
    assert (out["n"].to_numpy() == want["n"].to_numpy()).all()
    for c in ("s", "lo", "hi"):
        assert np.allclose(out[c], want[c])


def test_excluding_the_current_row(spark, frame):
    df = spark.createDataFrame(frame)
    out = O.running(df, ["key"], ["t", "id"], {"lo": ("min", F.col("x"))}, include_current=False).toPandas().sort_values("id")
    want = frame.sort_values(["key", "t", "id"])
    want = want.assign(lo=want.groupby("key")["x"].cummin().groupby(want["key"]).shift()).sort_values("id")
    assert out["lo"].isna().sum() == want["lo"].isna().sum() == frame["key"].nunique()
    assert np.allclose(out["lo"].fillna(9), want["lo"].fillna(9))


def test_neighbours_across_slices(spark, frame):
    out = O.with_neighbours(spark.createDataFrame(frame), ["key"], ["t", "id"], ["x"], slices=32)
    got = out.select("id", "prev.x", F.col("next.x").alias("y")).toPandas().sort_values("id")
    want = frame.sort_values(["key", "t", "id"])
    g = want.groupby("key")["x"]
    want = want.assign(p=g.shift(), q=g.shift(-1)).sort_values("id")
    assert np.allclose(got["x"].fillna(9), want["p"].fillna(9)) and np.allclose(got["y"].fillna(9), want["q"].fillna(9))


def test_last_rows_with_small_blocks(spark, frame):
    out = O.last_rows(spark.createDataFrame(frame), ["key"], ["t", "id"], 5, {"s": F.col("x")}, block=8).toPandas().sort_values("id")
    want = frame.sort_values(["key", "t", "id"])
    s = want.groupby("key")["x"].rolling(5, min_periods=1).sum().reset_index(level=0, drop=True)
    assert len(out) == len(frame) and np.allclose(out["s"], s.sort_index())


@pytest.mark.parametrize("slices", [16, 64])
def test_exact_quantiles(spark, frame, slices):
    df = spark.createDataFrame(frame)
    got = exact_quantiles(df, ["key"], F.col("x"), {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.99, "e": 1.0}, slices).toPandas().set_index("key").sort_index()
    for c, q in zip("abcde", (0.0, 0.37, 0.5, 0.99, 1.0)):
        assert np.allclose(got[c], frame.groupby("key")["x"].quantile(q).sort_index())


def test_quantile_of_one_value(spark):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "key int, x double")
    assert [tuple(r) for r in exact_quantiles(df, ["key"], F.col("x"), {"m": 0.5}).collect()] == [(1, 2.5)]


def test_slice_number_matches_searchsorted(spark):
    bounds = [1.0, 2.5, 2.75, 9.0, 11.0]
    xs = [-1.0, 1.0, 1.5, 2.5, 2.6, 2.75, 8.0, 9.0, 10.0, 11.0, 12.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(O.slice_number(F.col("x"), bounds).alias("s")).collect()
    assert [r["s"] for r in got] == list(np.searchsorted(bounds, xs, side="left"))


def odd_values(n, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=n), rng.normal(size=n) * 1e-300, np.repeat([0.0, -0.0, 7.5], n // 3), rng.lognormal(0, 30, n)])
    return rng.permutation(np.concatenate([x, [np.inf, -np.inf] * 3]))


@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_narrowed_quantiles_equal_sorting(spark, n):
    x = np.sort(odd_values(max(n, 3), n)[:n] if n < 3000 else odd_values(n, n))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
    levels = {f"q{i}": q for i, q in enumerate([0.0, 0.1, 0.333, 0.5, 0.999, 1.0])}
    rank = lambda total: F.ceil(F.lit(0.9) * total) - 1
    got = exact_quantiles(df, [], F.col("v"), levels | {"rank": rank}).first()
    for name, q in levels.items():
        at = q * (len(x) - 1)
        low = int(np.floor(at))
        a, b = x[low], x[min(low + 1, len(x) - 1)]
        want = a + (b - a) * (at - low)
        assert got[name] == want or (np.isnan(want) and np.isnan(got[name]))
    assert got["rank"] == x[int(np.ceil(0.9 * len(x))) - 1]


def test_narrowed_quantiles_by_level_and_nan(spark):
    rng = np.random.default_rng(5)
    rows = [(q, float(v)) for q in (0.1, 0.5, 0.9) for v in rng.normal(size=2000)] + [(None, 1.0), (0.7, float("nan")), (0.7, 2.0), (0.2, None)]
    df = spark.createDataFrame(rows, "q double, v double").repartition(4)
    few = {r["q"]: r["d"] for r in exact_quantiles(df, ["q"], F.col("v"), {"d": F.col("q")}, few=True).collect()}
    many = {r["q"]: r["d"] for r in exact_quantiles(df, ["q"], F.col("v"), {"d": F.col("q")}).collect()}
    assert few.keys() == many.keys() and all(few[k] == many[k] or str(few[k]) == str(many[k]) for k in many)
    none = df.limit(0)
    assert exact_quantiles(none, [], F.col("v"), {"m": 0.5}).collect() == [(None,)]
    assert exact_quantiles(none, ["q"], F.col("v"), {"m": 0.5}, few=True).collect() == []


def test_only_values_near_a_rank_are_moved(spark):
    """Of many values the limits of a rank enclose a small part, and both ranks beside the position."""
    x = np.sort(np.random.default_rng(6).normal(size=60_000))
    values = spark.createDataFrame([(float(v),) for v in x], "_v double").repartition(8)
    for w in rank_limits(values, [], {str(q): q for q in (0.0, 0.25, 0.5, 0.987, 1.0)}).first()["_wanted"]:
        low = int(w["at"])
        assert w["lo"] <= x[low] and not x[min(low + 1, len(x) - 1)] > w["hi"]
        assert ((x >= w["lo"]) & ~(x > w["hi"])).sum() < 0.02 * len(x)


def test_noise_of_decimals_is_exact_in_any_order(spark):
    import random
    from decimal import Decimal
    from fractions import Fraction

    from sparkassay.operators import aggregates as A

    draw = random.Random(5)
    cents = [draw.randrange(1, 10**7) for _ in range(300)]
    whole = [Fraction(c, 100) for c in cents]
    mean = sum(whole) / 300
    want = (float(mean), sum((x - mean) ** 2 for x in whole) / 299 / 300)
    for turn in range(4):
        random.Random(turn).shuffle(cents)
        rows = [("a", "s", Decimal(c) / 100) for c in cents] + [("a", "s", None), ("b", "s", None), ("c", "s", Decimal(7))]
        df = spark.createDataFrame(rows, "gidx string, scenario string, value decimal(15,2)").repartition(turn + 2)
        got = {r["gidx"]: r for r in A.metric_agg_noise(df, ["gidx", "scenario"], "mean").collect()}
        assert got["a"]["value"] == want[0] and abs(got["a"]["var"] / float(want[1]) - 1) < 1e-15
        assert np.isnan(got["b"]["value"]) and got["b"]["var"] is None
        assert (got["c"]["value"], got["c"]["var"]) == (7.0, 0.0)
