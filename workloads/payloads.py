"""Payload decoding over JSON that Spark derives from lineitem, and flags and margins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.functions.numeric import finite_or_null
from sparkassay.operators import aggregates as A
from sparkassay.operators import payloads as P

from .adapters import D_SAFE, EP_ORDER, EP_ORDER_SQL, EP_SQL, by_part, episodes, table
from .registry import query

# lineitem -> payload text: min_d is a number, a bare NaN, text or absent, by tax
DOC_SQL = f"""{EP_SQL}, doc AS (SELECT *, CASE WHEN tax = 0.08 THEN NULL WHEN tax = 0.07 THEN NULL
  WHEN tax = 0.06 THEN NULL ELSE min_d END AS doc_min_d FROM ep)"""


def documents(spark, sf):
    ep = episodes(spark, sf)
    num = F.col("min_d").cast("string")
    text = (
        F.when(F.col("tax") == 0.08, F.lit("NaN"))
        .when(F.col("tax") == 0.07, F.lit('"broken"'))
        .when(F.col("tax") == 0.06, F.lit("null"))
        .otherwise(num)
    )
    body = F.concat(
        F.lit('{"kpi": {"aoi_avg": '),
        F.col("metric").cast("string"),
        F.lit('}, "safety_m": {"crash": '),
        F.when(F.col("flag") == "R", F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "min_d": '),
        text,
        F.lit("}}"),
    )
    return ep.withColumn("payload_json", body)


@query(
    "payload_metric",
    f"""WITH {DOC_SQL} SELECT ep_uid, gidx, part, metric AS aoi, (flag = 'R')::INT::DOUBLE AS crash, doc_min_d AS min_d
FROM doc""",
)
def payload_metric(spark, sf):
    paths = {"aoi": "kpi.aoi_avg", "crash": "safety_m.crash", "min_d": "safety_m.min_d"}
    docs = documents(spark, sf).select("ep_uid", "gidx", "part", "payload_json")
    return P.metrics(docs, paths).drop("payload_json")


@query(
    "violation_flag",
    f"""WITH {DOC_SQL} SELECT gidx, scenario, count(*) AS n,
  count(*) FILTER (WHERE NOT coalesce(doc_min_d >= 0.5, FALSE)) AS unsafe FROM doc GROUP BY ALL""",
)
def violation_flag(spark, sf):
    docs = documents(spark, sf).select("gidx", "scenario", "payload_json")
    rows = P.metrics(docs, {"min_d": "safety_m.min_d"})
    return rows.groupBy("gidx", "scenario").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(P.unsafe(F.col("min_d"), D_SAFE)).alias("unsafe")
    )


@query(
    "violation_flag_strict",
    f"""WITH {EP_SQL} SELECT ep_uid, gidx, part,
  CASE WHEN tax NOT IN (0.06, 0.07, 0.08) THEN min_d END AS min_d,
  CASE WHEN tax IN (0.06, 0.07, 0.08) THEN TRUE ELSE min_d < 0.5 END AS violation,
  tax IN (0.06, 0.07, 0.08) AS malformed FROM ep""",
)
def violation_flag_strict(spark, sf):
    raw = (
        F.when(F.col("tax") == 0.08, F.lit(float("nan")))
        .when(F.col("tax") == 0.07, F.lit(float("inf")))
        .when(F.col("tax") != 0.06, F.col("min_d"))
    )
    return episodes(spark, sf).select("ep_uid", "gidx", "part", *P.strict(raw, D_SAFE))


@query(
    "episode_margin",
    f"WITH {DOC_SQL} SELECT ep_uid, gidx, part, round(doc_min_d - 0.5, 9) AS margin FROM doc",
)
def episode_margin(spark, sf):
    docs = documents(spark, sf).select("ep_uid", "gidx", "part", "payload_json")
    rows = P.metrics(docs, {"min_d": "safety_m.min_d"})
    return rows.select("ep_uid", "gidx", "part", F.round(P.margin(F.col("min_d"), D_SAFE), 9).alias("margin"))


# margins per part x supplier group: small groups, some with a single row
MARGIN_SQL = """m AS (SELECT l_partkey * 100 + l_suppkey AS gidx, CASE WHEN l_tax <> 0.08 THEN l_quantity / 10 - 0.5 END AS margin
  FROM lineitem)"""


def margins(spark, sf):
    """Every row; a trial without a margin (tax 0.08) has null."""
    margin = F.when(F.col("l_tax") != 0.08, F.col("l_quantity") / 10 - 0.5)
    return table(spark, sf, "lineitem").select((F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("gidx"), margin.alias("margin"))


@query(
    "margin_stats",
    f"""WITH {MARGIN_SQL}, g AS (SELECT gidx, avg(margin) AS y, count(*) AS n,
  CASE WHEN count(*) > 1 THEN var_samp(margin) END AS v FROM m WHERE margin IS NOT NULL GROUP BY gidx),
f AS (SELECT *, greatest(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM g)), 1e-6) AS var FROM g)
SELECT gidx, round(y, 6) AS y, n, round(var, 6) AS var, round(greatest(var / n, 1e-5), 6) AS alpha,
  round(ln(var + 1e-6), 5) AS log_var, v IS NULL AS fallback FROM f""",
)
def margin_stats(spark, sf):
    out = A.margin_stats(margins(spark, sf))
    return out.withColumns({"y": F.round("y", 6), "var": F.round("var", 6), "alpha": F.round("alpha", 6),
                            "log_var": F.round("log_var", 5)})


TRAIN_SQL = f"""{EP_SQL}, firsts AS (SELECT gidx, min_d - 0.5 AS margin, tax,
  row_number() OVER (PARTITION BY gidx ORDER BY {EP_ORDER_SQL}, scenario) AS ord FROM
  (SELECT * REPLACE (part AS gidx, gidx AS part) FROM ep)),
kept AS (SELECT * FROM firsts WHERE ord <= 30 AND tax <> 0.08),
sized AS (SELECT *, count(*) OVER (PARTITION BY gidx) AS n_d FROM kept),
used AS (SELECT * FROM sized WHERE n_d >= 20)"""


def training(spark, sf):
    trials = by_part(episodes(spark, sf))
    margin = F.when(F.col("tax") == 0.08, F.lit(float("nan"))).otherwise(F.col("min_d")) - D_SAFE
    return A.training_rows(trials, [*EP_ORDER, "scenario"], margin, 20, 30)


@query(
    "episode_training_set",
    f"""WITH {TRAIN_SQL} SELECT gidx, ord::INT AS ord, round(margin, 6) AS margin,
  round((SELECT count(*) FROM used) / (n_d * (SELECT count(DISTINCT gidx) FROM used)), 9) AS weight FROM used""",
)
def episode_training_set(spark, sf):
    return training(spark, sf).withColumns({"margin": F.round("margin", 6), "weight": F.round("weight", 9)})


@query(
    "training_summary",
    f"""WITH {TRAIN_SQL}, c AS (SELECT gidx, count(*) AS c FROM used GROUP BY gidx)
SELECT count(*) AS designs, sum(c)::BIGINT AS rows, min(c) AS min_eps, max(c) AS max_eps,
  round(avg(c), 9) AS mean_eps FROM c""",
)
def training_summary(spark, sf):
    return A.training_summary(training(spark, sf)).withColumn("mean_eps", F.round("mean_eps", 9))


def values(spark, sf):
    v = F.when(F.col("tax") == 0.08, F.lit(float("nan"))).when(F.col("tax") != 0.07, F.col("metric"))
    return episodes(spark, sf).withColumn("value", v).drop("metric")


VALUE_SQL = f"""{EP_SQL}, v AS (SELECT * EXCLUDE (metric), metric AS value FROM ep WHERE tax NOT IN (0.07, 0.08))"""


@query(
    "metric_agg",
    f"""WITH {VALUE_SQL} SELECT gidx, scenario, min(value) AS lo, max(value) AS hi, round(avg(value), 9) AS mean,
  round(quantile_cont(value, 0.5), 4) AS median FROM v GROUP BY ALL""",
)
def metric_agg(spark, sf):
    rows, keys = values(spark, sf), ["gidx", "scenario"]
    out = None
    for mode, name in (("min", "lo"), ("max", "hi"), ("mean", "mean"), ("median", "median")):
        one = A.metric_agg(rows, keys, mode).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, keys)
    return out.withColumns({"mean": F.round("mean", 9), "median": F.round("median", 4)})


# Prices are whole cents, so their sums are exact; both sides divide the same two numbers and need no rounding.
NOISE_SQL = f"""{EP_SQL}, cents AS (SELECT part AS gidx, scenario, CASE WHEN tax NOT IN (0.07, 0.08) THEN round(metric * 100)::BIGINT END AS c FROM ep),
m AS (SELECT gidx, scenario, count(c)::DOUBLE AS n, sum(c)::HUGEINT AS s, sum(c::HUGEINT * c)::HUGEINT AS q FROM cents GROUP BY ALL),
noise AS (SELECT gidx, scenario, CASE WHEN n = 0 THEN 'NaN'::DOUBLE ELSE s::DOUBLE / (n * 100) END AS value,
  CASE WHEN n = 1 THEN 0 WHEN n > 1 THEN (n::HUGEINT * q - s * s)::DOUBLE / (n * n * (n - 1) * 10000) END AS var FROM m)"""


def cents(spark, sf):
    """Values per part as decimals; missing and not finite ones are null."""
    exact = finite_or_null(F.col("value")).cast("decimal(15,2)")
    return values(spark, sf).drop("gidx").withColumnRenamed("part", "gidx").withColumn("value", exact)


@query("metric_agg_noise", f"WITH {NOISE_SQL} SELECT gidx, scenario, value, var FROM noise")
def metric_agg_noise(spark, sf):
    return A.metric_agg_noise(cents(spark, sf), ["gidx", "scenario"], "mean")


VORDER = EP_ORDER_SQL.replace("metric", "value").replace("part", "gidx")


@query(
    "fixed_replication",
    f"""WITH {EP_SQL}, v AS (SELECT * EXCLUDE (metric), CASE WHEN tax NOT IN (0.07, 0.08) THEN metric END AS value FROM ep),
dd AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY part, scenario, ep_id ORDER BY {VORDER}) = 1),
r AS (SELECT part AS gidx, scenario, value, row_number() OVER (PARTITION BY part, scenario ORDER BY {VORDER}) AS ord FROM dd WHERE value IS NOT NULL)
SELECT gidx, scenario, ord::INT AS ord, value, count(*) OVER (PARTITION BY gidx, scenario) < 12 AS short
FROM r WHERE ord <= 12""",
)
def fixed_replication(spark, sf):
    rows = values(spark, sf)  # the operator skips values that are not finite
    order = ["value" if c == "metric" else c for c in EP_ORDER]
    return A.fixed_replication(by_part(rows), 12, order, seed="ep_id")


@query(
    "portfolio_objective",
    f"""WITH {NOISE_SQL} SELECT gidx, sum(value) / count(*) AS metric, -(sum(value) / count(*)) AS obj_perf,
  CASE WHEN count(var) = 2 THEN sum(var) / 4 END AS obs_var FROM noise GROUP BY gidx""",
)
def portfolio_objective(spark, sf):
    per = A.metric_agg_noise(cents(spark, sf), ["gidx", "scenario"], "mean")
    return A.portfolio_objective(per, 2, "mean", maximize=True)
