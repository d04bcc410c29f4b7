"""Sequential tests over lineitem episodes, one per (design, scenario)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import sequential as S

from .adapters import EP_ORDER, EP_ORDER_SQL, EP_SQL, by_part, episodes, table, unsafe_flag
from .registry import query

KEYS = ["gidx", "scenario"]

PATH_SQL = f"""{EP_SQL}, numbered AS (
  SELECT gidx, scenario, (min_d < 0.5)::INT AS u,
    row_number() OVER (PARTITION BY gidx, scenario ORDER BY {EP_ORDER_SQL}) AS n FROM ep),
path AS (SELECT gidx, scenario, n, sum(u) OVER (PARTITION BY gidx, scenario ORDER BY n)::BIGINT AS k
  FROM numbered WHERE n <= 80),
lpath AS (SELECT *, k * ln(0.5) + (n - k) * ln(0.975 / 0.95) AS llr FROM path)"""

LABEL_SQL = f"""{PATH_SQL}, moded AS (SELECT *, CASE
    WHEN k = 0 AND n >= 59 THEN 'CP_K0'
    WHEN llr >= ln(0.8 / 0.05) THEN 'WALD_SAFE'
    WHEN llr <= ln(0.2 / 0.95) THEN 'WALD_UNSAFE'
    WHEN n >= 80 AND k = 0 THEN 'CP_CAP'
    WHEN n >= 80 THEN 'CAP_UNSAFE' END AS mode FROM lpath),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gidx, scenario
    ORDER BY (mode IS NULL)::INT, CASE WHEN mode IS NULL THEN -n ELSE n END) AS r FROM moded),
lab AS (SELECT gidx, scenario,
    CASE WHEN mode IN ('CP_K0', 'WALD_SAFE', 'CP_CAP') THEN 1 WHEN mode IS NOT NULL THEN 0 END AS label,
    coalesce(mode, 'INSUFFICIENT_EPISODES') AS mode, n, k, llr FROM ranked WHERE r = 1)"""

LAST_SQL = "SELECT gidx, scenario, label, mode, n, k, round(llr, 9) AS llr FROM lab"


def labels(spark, sf):
    return S.sprt_label(episodes(spark, sf), KEYS, EP_ORDER, unsafe_flag())


@query("sprt_label", f"WITH {LABEL_SQL} {LAST_SQL}")
def sprt_label(spark, sf):
    return labels(spark, sf).withColumn("llr", F.round("llr", 9))


@query("sprt_path", f"WITH {PATH_SQL} SELECT gidx, scenario, n, k, round(llr, 9) AS llr FROM lpath")
def sprt_path(spark, sf):
    path = S.sprt_path(episodes(spark, sf), KEYS, EP_ORDER, unsafe_flag(), S.SequentialRule())
    return path.withColumn("llr", F.round("llr", 9))


@query(
    "cp_only_label",
    f"""WITH {PATH_SQL}, moded AS (SELECT *, CASE WHEN k > 0 THEN 'OBS_FAIL' WHEN n >= 59 THEN 'CP_K0'
    WHEN n >= 80 THEN 'CAP_UNSAFE' END AS mode FROM lpath),
ranked AS (SELECT *, row_number() OVER (PARTITION BY gidx, scenario
    ORDER BY (mode IS NULL)::INT, CASE WHEN mode IS NULL THEN -n ELSE n END) AS r FROM moded)
SELECT gidx, scenario, CASE WHEN mode = 'CP_K0' THEN 1 WHEN mode IS NOT NULL THEN 0 END AS label,
    coalesce(mode, 'INSUFFICIENT_EPISODES') AS mode, n, k, round(llr, 9) AS llr FROM ranked WHERE r = 1""",
)
def cp_only_label(spark, sf):
    out = S.cp_only_label(episodes(spark, sf), KEYS, EP_ORDER, unsafe_flag())
    return out.withColumn("llr", F.round("llr", 9))


NEED_SQL = """CASE WHEN mode <> 'INSUFFICIENT_EPISODES' THEN 0 ELSE greatest(0, least(
    CASE WHEN k = 0 AND n < 59 THEN 59 - n END,
    CASE WHEN llr < ln(16) THEN ceil((ln(16) - llr) / ln(0.975 / 0.95)) END,
    CASE WHEN llr > ln(0.2 / 0.95) THEN ceil((llr - ln(0.2 / 0.95)) / -ln(0.5)) END,
    CASE WHEN n < 80 THEN 80 - n END)) END::BIGINT"""

# part x scenario groups are short, so most of them stay undecided
SHORT_SQL = LABEL_SQL.replace("l_suppkey AS gidx, l_partkey AS part", "l_partkey AS gidx, l_suppkey AS part")


def short_trials(spark, sf):
    return by_part(episodes(spark, sf))


def short_labels(spark, sf):
    return S.sprt_label(short_trials(spark, sf), KEYS, EP_ORDER, unsafe_flag())


@query("sprt_remaining", f"WITH {SHORT_SQL} SELECT gidx, scenario, n, k, {NEED_SQL} AS need FROM lab")
def sprt_remaining(spark, sf):
    return S.sprt_remaining(short_labels(spark, sf)).select("gidx", "scenario", "n", "k", "need")


@query(
    "label_summary",
    f"""WITH {SHORT_SQL}, need AS (SELECT *, {NEED_SQL} AS need FROM lab),
d AS (SELECT p_partkey AS gidx FROM part WHERE p_size <= 30), s AS (SELECT DISTINCT scenario FROM lab),
g AS (SELECT scenario, d.gidx, label, need, n FROM s CROSS JOIN d LEFT JOIN need USING (scenario, gidx))
SELECT s.scenario, (SELECT count(*) FROM lab WHERE scenario = s.scenario) AS designs,
  (SELECT count(label) FROM lab WHERE scenario = s.scenario) AS labelled,
  (SELECT count(*) - count(label) FROM lab WHERE scenario = s.scenario) AS insufficient,
  (SELECT count(*) FROM d) AS grid_total,
  (SELECT count(label) FROM g WHERE scenario = s.scenario) AS grid_labelled,
  (SELECT count(*) - count(label) FROM g WHERE scenario = s.scenario) AS grid_missing,
  (SELECT sum(CASE WHEN n IS NULL THEN 80 WHEN label IS NULL THEN need ELSE 0 END)::BIGINT
     FROM g WHERE scenario = s.scenario) AS eps_needed,
  (SELECT round(min(min_d), 6) FROM ep JOIN lab USING (gidx, scenario) WHERE label = 0 AND scenario = s.scenario) AS min_d_lo,
  (SELECT round(max(min_d), 6) FROM ep JOIN lab USING (gidx, scenario) WHERE label = 0 AND scenario = s.scenario) AS min_d_hi
FROM s""",
)
def label_summary(spark, sf):
    trials = short_trials(spark, sf)
    designs = table(spark, sf, "part").where("p_size <= 30").select(F.col("p_partkey").alias("gidx"))
    out = S.label_summary(short_labels(spark, sf), trials, designs, trials.select("scenario").distinct())
    return out.withColumns({c: F.round(c, 6) for c in ("min_d_lo", "min_d_hi")})
