"""Replay of campaigns from merged moments: values, refusals, extreme weights and stored shards."""

import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkassay.operators import families as FM
from sparkassay.operators import replay as RP
from sparkassay.plans import jobs as J

SCHEMA = (
    "job string, failure boolean, log_weight double, first_detection_ms double, first_external_message_age_ms double,"
    " route_signature string, sampling_component string, proposal_log_ratios map<string,double>"
)


def hit():
    return F.col("failure") & (F.col("route_signature") == "r")


def rows_of(job, n, seed, components=None, weights=True):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        component = None if components is None else components[i % len(components)]
        lw = float(rng.normal(0, 0.5)) if weights else 0.0
        late, old = float(rng.choice([1000.0, 4000.0])), float(rng.choice([100.0, 300.0]))
        out.append((job, bool(rng.random() < 0.5), lw, late, old, str(rng.choice(["r", "s"])), component, None if components is None else {"x": 0.0}))
    return out


def sums(spark, rows, jobs):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return RP.replay_sums(df, spark.createDataFrame(jobs, "job string, scheme string"), hit(), FM.failure_family())


def family(r):
    late, stale = r[3] > 2990, r[4] > 200
    return None if not r[1] else 0 if late else 1 if stale else 2


def by_hand(rows, scheme):
    """Estimate and error of the mode, estimates and covariance of the families."""
    w = np.exp([r[2] for r in rows])
    y = np.stack([w * [r[1] and r[5] == "r" for r in rows]] + [w * [family(r) == i for r in rows] for i in range(3)])
    n = len(rows)
    if scheme == "iid_single_proposal":
        cov = np.cov(y) / n
    elif scheme == "nominal_mc":
        cov = (np.diag(y.mean(1)) - np.outer(y.mean(1), y.mean(1))) / n
    else:
        cov = 0
        for s in {r[6] for r in rows}:
            at = [i for i, r in enumerate(rows) if r[6] == s]
            cov = cov + len(at) * np.cov(y[:, at]) / n**2
    return y, cov


@pytest.mark.parametrize("scheme", ["iid_single_proposal", "nominal_mc", "deterministic_mixture"])
def test_values_by_hand(spark, scheme):
    rows = rows_of("j", 200, 1, ["a", "b", "b"] if scheme == "deterministic_mixture" else None, scheme != "nominal_mc")
    s = sums(spark, rows, [("j", scheme)])
    y, cov = by_hand(rows, scheme)
    mode = RP.replay_modes(s).first()
    assert mode["reason"] is None and mode["n"] == 200
    assert mode["estimate"] == pytest.approx(y[0].mean()) and mode["se"] == pytest.approx(math.sqrt(cov[0, 0]))
    assert mode["events"] == sum(r[1] and r[5] == "r" for r in rows) and mode["failures"] == sum(r[1] for r in rows)
    if scheme == "deterministic_mixture":
        assert [(x["stratum"], x["n"]) for x in mode["strata"]] == [("a", 67), ("b", 133)]
        f = y[1:].sum(0)
        assert mode["aggregate_ess"] == pytest.approx(f.sum() ** 2 / (f**2).sum())
    got = {r["family"]: r for r in RP.replay_family_rows(s).collect()}
    e = y[1:].mean(1)
    for i, name in enumerate(FM.FAMILIES):
        assert got[name]["estimate"] == pytest.approx(e[i]) and got[name]["se"] == pytest.approx(math.sqrt(cov[1 + i, 1 + i]))
        grad = (np.eye(3)[i] - e[i] / e.sum()) / e.sum()
        assert got[name]["share_se"] == pytest.approx(math.sqrt(grad @ cov[1:, 1:] @ grad))


def test_every_rule_leaves_a_reason(spark):
    good = rows_of("ok", 30, 2, ["a", "b"])
    lone = rows_of("lone", 9, 3, ["a"]) + rows_of("lone", 1, 4, ["b"])
    no_ratio = [(*r[:7], None) for r in rows_of("ratio", 8, 5, ["a"])]
    bad = rows_of("bad", 8, 6)
    bad[3] = (*bad[3][:2], float("nan"), *bad[3][3:])
    rows = good + lone + no_ratio + bad + rows_of("iid", 8, 7, ["a"]) + rows_of("none", 8, 8) + rows_of("odd", 8, 9) + rows_of("off", 8, 10) + rows_of("new", 8, 11)
    mix, one, mc = "deterministic_mixture", "iid_single_proposal", "nominal_mc"
    jobs = [("ok", mix), ("lone", mix), ("ratio", mix), ("bad", one), ("iid", one), ("none", mix), ("odd", "grid"), ("off", mc), ("void", one)]
    s = sums(spark, rows, jobs)
    modes = {r["job"]: r for r in RP.replay_modes(s).collect()}
    assert {j: r["reason"] for j, r in modes.items()} == {
        "ok": None, "lone": "stratum_under_two_rows", "ratio": "mixture_without_ratios", "bad": "invalid_weight", "iid": "component_on_iid_job",
        "none": "mixture_without_component,mixture_without_ratios", "odd": "unknown_scheme", "off": None, "new": "unplanned", "void": "no_rows",
    }
    assert all((r["estimate"] is None) == (r["reason"] is not None) for r in modes.values())
    families = RP.replay_family_rows(s).collect()
    assert len(families) == 3 * len(modes)
    assert {r["reason"] for r in families if r["job"] == "off"} == {"weights_not_unit"}
    assert {r["reason"] for r in families if r["job"] == "ok"} == {None}


def test_bands_merge_without_overflow(spark):
    rows = [("j", i % 2 == 0, lw, 1.0, 1.0, "r", None, None) for i, lw in enumerate([-800.0, -801.0, -700.0, -1500.0, -math.inf, -640.5])]
    r = RP.replay_modes(sums(spark, rows, [("j", "iid_single_proposal")])).first()
    y = np.array([1 if i % 2 == 0 and np.isfinite(x[2]) else 0 for i, x in enumerate(rows)]) * np.exp(np.array([x[2] for x in rows]) + 700)
    assert r["rse"] == pytest.approx(y.std(ddof=1) / math.sqrt(6) / y.mean())
    assert r["event_ess"] == pytest.approx(y.sum() ** 2 / (y**2).sum()) and r["max_contrib"] == pytest.approx(y.max() / y.sum())
    assert r["estimate"] == pytest.approx(y.mean() * math.exp(-700))


def test_no_hits(spark):
    rows = [("a", False, 0.0, 1.0, 1.0, "s", None, None)] * 4 + [("b", False, 0.0, 1.0, 1.0, "s", "x", {"x": 0.0})] * 4
    got = {r["job"]: r for r in RP.replay_modes(sums(spark, rows, [("a", "iid_single_proposal"), ("b", "deterministic_mixture")])).collect()}
    assert (got["a"]["estimate"], got["a"]["ci_lo"], got["a"]["ci_hi"]) == (0.0, 0.0, None)
    assert (got["b"]["estimate"], got["b"]["ci_lo"], got["b"]["ci_hi"]) == (0.0, None, None)


def test_one_pass_over_the_rows(spark, folder):
    spark.createDataFrame(rows_of("j", 50, 1), SCHEMA).write.parquet(f"{folder}/rows")
    held = RP.moments(spark.read.parquet(f"{folder}/rows"), spark.createDataFrame([("j", "iid_single_proposal")], "job string, scheme string"), hit(), FM.failure_family())
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


@pytest.mark.parametrize("corrupt", [False, True])
def test_stored_campaign(spark, folder, corrupt):
    where = f"{folder}/estimate-x/sample-shards"
    os.makedirs(where)
    rows = [{"failure": i < 4, "log_weight": 0.0, "route_signature": "r", "first_detection_ms": 1.0, "first_external_message_age_ms": 1.0} for i in range(10)]
    text = "\n".join(json.dumps(r) for r in rows) + "\n"
    open(f"{where}/000000.jsonl", "w").write(text)
    open(f"{where}/000000.sha256.json", "w").write(json.dumps({"sha256": "0" * 64 if corrupt else hashlib.sha256(text.encode()).hexdigest()}))
    plan = spark.createDataFrame([("estimate-x", "iid_single_proposal", 10)], "key string, scheme string, episodes long")
    mode = RP.replay_modes(J.replay_shards(spark, folder, plan, hit(), FM.failure_family())).first()
    assert (mode["n"], mode["events"], mode["reason"]) == (10, 4, "digest mismatch" if corrupt else None)
    assert mode["estimate"] == (None if corrupt else pytest.approx(0.4))
    published = spark.createDataFrame([("estimate-x", 0.123)], "job string, estimate double")
    wrong = J.verify_campaign(RP.replay_modes(J.replay_shards(spark, folder, plan, hit(), FM.failure_family())), published, ["estimate"]).collect()
    assert len(wrong) == 1 and wrong[0]["field"] == "estimate"
