import math
import random

import pytest
from pyspark.sql import functions as F

from sparkassay.operators import sequential as S
from sparkassay.plans import jobs as J

RULE = S.SequentialRule()


def by_hand(flags, rule=RULE):
    """Plain loop over one sequence."""
    n = k = 0
    for bad in flags:
        n, k = n + 1, k + bad
        llr = k * math.log(0.5) + (n - k) * math.log((1 - 0.5 * rule.p) / (1 - rule.p))
        if k == 0 and n >= rule.clean_needed:
            return 1, "CP_K0", n, k
        if llr >= rule.log_a:
            return 1, "WALD_SAFE", n, k
        if llr <= rule.log_b:
            return 0, "WALD_UNSAFE", n, k
        if n >= rule.cap:
            return (1, "CP_CAP", n, k) if k <= rule.cap_k else (0, "CAP_UNSAFE", n, k)
    return None, "INSUFFICIENT_EPISODES", n, k


def label(spark, sequences, rule=RULE):
    rows = [(name, i, int(b)) for name, seq in sequences.items() for i, b in enumerate(seq)]
    df = spark.createDataFrame(rows, "gidx string, ord int, bad int")
    out = S.sprt_label(df, ["gidx"], ["ord"], F.col("bad") == 1, rule)
    return {r["gidx"]: (r["label"], r["mode"], r["n"], r["k"]) for r in out.collect()}


def test_constants():
    assert RULE.log_a == pytest.approx(2.772589, abs=1e-6) and RULE.log_b == pytest.approx(-1.558145, abs=1e-6)
    assert RULE.fail_step == pytest.approx(-0.693147, abs=1e-6) and RULE.clean_step == pytest.approx(0.025975, abs=1e-6)
    assert RULE.clean_needed == 59 and RULE.cap_k == 0


def test_known_cases(spark):
    got = label(spark, {"clean": [0] * 100, "three": [1, 1, 1], "one": [1] + [0] * 99, "few": [0] * 10, "late": [0] * 58 + [1] + [0] * 40})
    assert got["clean"] == (1, "CP_K0", 59, 0)
    assert got["three"] == (0, "WALD_UNSAFE", 3, 3)
    assert got["one"] == (0, "CAP_UNSAFE", 80, 1)
    assert got["few"] == (None, "INSUFFICIENT_EPISODES", 10, 0)
    assert got["late"] == (0, "CAP_UNSAFE", 80, 1)


def test_random_sequences_match_the_loop(spark):
    rng = random.Random(3)
    seqs = {f"s{i}": [rng.random() < rng.choice([0, 0.01, 0.05, 0.3]) for _ in range(rng.randint(1, 120))] for i in range(60)}
    for rule in (RULE, S.SequentialRule(p=0.2, confidence=0.9, cap=40), S.SequentialRule(p=0.3, p1_factor=0.1, cap=30)):
        got = label(spark, seqs, rule)
        for name, seq in seqs.items():
            want = by_hand(seq, rule) if rule is RULE else None
            if want is None:
                n = k = 0
                want = (None, "INSUFFICIENT_EPISODES", len(seq), sum(seq))
                for bad in seq:
                    n, k = n + 1, k + bad
                    llr = k * rule.fail_step + (n - k) * rule.clean_step
                    mode = (
                        "CP_K0" if k == 0 and n >= rule.clean_needed else "WALD_SAFE" if llr >= rule.log_a
                        else "WALD_UNSAFE" if llr <= rule.log_b else None if n < rule.cap
                        else "CP_CAP" if k <= rule.cap_k else "CAP_UNSAFE"
                    )
                    if mode:
                        want = (int(mode in ("CP_K0", "WALD_SAFE", "CP_CAP")), mode, n, k)
                        break
                if want[1] == "INSUFFICIENT_EPISODES" and len(seq) > rule.cap:
                    continue
            assert got[name] == want, (name, rule)


def test_group_limit_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("gidx"), F.col("id").alias("ord"), F.lit(0).alias("bad"))
    plan = S.sprt_label(df, ["gidx"], ["ord"], F.col("bad") == 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_remaining_is_zero_after_a_decision(spark):
    rows = [(59, 0), (10, 0), (0, 0), (70, 1), (3, 3)]
    out = S.sprt_remaining(spark.createDataFrame(rows, "n long, k long")).collect()
    assert {(r["n"], r["k"]): r["need"] for r in out} == {(59, 0): 0, (10, 0): 3, (0, 0): 3, (70, 1): 4, (3, 3): 0}


def test_a_limit_beyond_the_group_limit(spark):
    df = spark.range(3000).selectExpr("id % 2 AS g", "id AS ord")
    got = S.first_trials(df, ["g"], ["ord"], 1200)
    assert got.count() == 2400 and got.where("ord = 2 * (n - 1) + g").count() == 2400


def test_labels_are_stored_once_for_the_split(spark):
    rows = [(g, i, i % (2 + g % 9) == 0) for g in range(40) for i in range(90)]
    trials = spark.createDataFrame(rows, "gidx long, ord long, bad boolean")
    out = J.offline_labels(trials, ["ord"], F.col("bad"), calib=0.2, test=0.2, seed=1)
    assert "row_number" not in out._jdf.queryExecution().optimizedPlan().toString()  # no pass labels the trials again
    want = {r["gidx"]: r["label"] for r in S.sprt_label(trials, ["gidx"], ["ord"], F.col("bad")).collect()}
    got = {r["gidx"]: (r["label"], r["split"]) for r in out.collect()}
    assert {g: x[0] for g, x in got.items()} == want
    assert all((x[0] is None) == (x[1] is None) for x in got.values())
