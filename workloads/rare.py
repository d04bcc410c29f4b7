"""Weighted rare-event estimates over lineitem campaign rows."""

from __future__ import annotations


from pyspark.sql import functions as F

from sparkassay.functions import binomial as B
from sparkassay.functions import gates as G
from sparkassay.functions.numeric import safe_exp
from sparkassay.operators import estimators as E
from sparkassay.operators import families as FM
from sparkassay.operators import reconcile as R
from sparkassay.operators import replay as RP
from sparkassay.operators.ordering import row_numbers
from sparkassay.schemas import CAMPAIGN_ROW
from sparkassay.plans import jobs as J
from sparkassay.session import scratch_path
from sparkassay.sources import campaign_shards as CS
from sparkassay.sources import campaigns

from .adapters import CAMPAIGN_SQL, campaign, table
from .registry import query

Z = E.z_two_sided(0.05)
HIT = "failure"


def rounded(df, digits: dict[str, int]):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "weight_diagnostics",
    f"""WITH {CAMPAIGN_SQL} SELECT job, sampling_component, count(*) AS n,
  round(sum(w) ** 2 / sum(w * w), 6) AS ess, round(sum(w) ** 2 / sum(w * w) / count(*), 9) AS ess_ratio,
  round(max(w) / sum(w), 9) AS max_norm_w, round(ln(avg(w)), 9) AS log_mean_w, round(avg(w), 9) AS mean_w
FROM ca GROUP BY ALL""",
)
def weight_diagnostics(spark, sf):
    out = E.weight_diagnostics(campaign(spark, sf), ["job", "sampling_component"])
    return rounded(out, {"ess": 6, "ess_ratio": 9, "max_norm_w": 9, "log_mean_w": 9, "mean_w": 9})


IS_COLS_SQL = f"""n, hits, round(est, 9) AS estimate, round(se, 9) AS se, round(rse, 9) AS rse,
  round(sy ** 2 / sy2, 6) AS hit_ess, round(exp(ln(est) - {Z!r} * rse), 9) AS ci_lo,
  round(least(1.0, exp(ln(est) + {Z!r} * rse)), 9) AS ci_hi, round(sy / sw, 9) AS snis, round(my / sy, 9) AS max_contrib"""


def is_sql(source: str, keys: str, hit: str) -> str:
    return f"""y AS (SELECT {keys}, w, {hit} AS hit, CASE WHEN {hit} THEN w ELSE 0 END AS y FROM {source}),
s AS (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, avg(y) AS est,
  stddev_samp(y) / sqrt(count(*)) AS se, stddev_samp(y) / sqrt(count(*)) / nullif(avg(y), 0) AS rse,
  sum(y) AS sy, nullif(sum(y * y), 0) AS sy2, sum(w) AS sw, max(y) AS my FROM y GROUP BY ALL)"""


IS_ROUND = {c: 9 for c in ("estimate", "se", "rse", "ci_lo", "ci_hi", "snis", "max_contrib")} | {"hit_ess": 6}
IS_COLS = ["n", "hits", "estimate", "se", "rse", "hit_ess", "ci_lo", "ci_hi", "snis", "max_contrib"]


@query(
    "is_estimate",
    f"""WITH {CAMPAIGN_SQL}, {is_sql('ca', 'job, sampling_component', 'failure')}
SELECT job, sampling_component, {IS_COLS_SQL} FROM s""",
)
def is_estimate(spark, sf):
    keys = ["job", "sampling_component"]
    return rounded(E.is_estimate(campaign(spark, sf), keys, HIT).select(*keys, *IS_COLS), IS_ROUND)


@query(
    "stratified_estimate",
    f"""WITH {CAMPAIGN_SQL}, y AS (SELECT *, CASE WHEN failure THEN w ELSE 0 END AS y FROM ca),
h AS (SELECT job, sampling_component, count(*) AS nh, var_samp(y) AS vh FROM y GROUP BY ALL),
v AS (SELECT job, sum(nh * vh) AS vs, string_agg(sampling_component || '=' || nh, ',' ORDER BY sampling_component) AS strata
  FROM h GROUP BY job),
s AS (SELECT job, count(*) AS n, count(*) FILTER (WHERE failure) AS events, avg(y) AS est, sum(y) AS sy,
  sum(y * y) AS sy2, max(y) AS my FROM y GROUP BY job),
j AS (SELECT *, sqrt(vs) / n AS se, sqrt(vs) / n / est AS rse FROM s JOIN v USING (job))
SELECT job, n, events, round(est, 9) AS estimate, round(se, 9) AS se, round(rse, 9) AS rse,
  round(exp(ln(est) - {Z!r} * rse), 9) AS ci_lo, round(least(1, exp(ln(est) + {Z!r} * rse)), 9) AS ci_hi,
  round(sy ** 2 / sy2, 6) AS event_ess, round(my / sy, 9) AS max_contrib, strata FROM j""",
)
def stratified_estimate(spark, sf):
    out = E.stratified_estimate(campaign(spark, sf), ["job"], "sampling_component", HIT, HIT)
    text = F.array_join(F.transform(F.map_entries("strata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    cols = ["job", "n", "events", "estimate", "se", "rse", "ci_lo", "ci_hi", "event_ess", "max_contrib"]
    return rounded(out.select(*cols, text.alias("strata")), {c: 9 for c in cols[3:8]} | {"event_ess": 6, "max_contrib": 9})


@query(
    "severity_curve",
    f"""WITH {CAMPAIGN_SQL}, t AS (SELECT unnest([-0.25, 0.0, 0.3, 0.5, 1.0, 2.5]) AS threshold),
x AS (SELECT ca.*, t.threshold::DOUBLE AS threshold FROM ca, t), {is_sql('x', 'job, threshold', 'min_d <= threshold')}
SELECT job, threshold, n, hits, coalesce(round(est, 9), 0) AS estimate, round(se, 9) AS se, round(rse, 9) AS rse,
  coalesce(round(sy ** 2 / sy2, 6), 0) AS hit_ess,
  coalesce(round(exp(ln(nullif(est, 0)) - {Z!r} * rse), 9), 0) AS ci_lo,
  CASE WHEN est > 0 THEN round(least(1.0, exp(ln(nullif(est, 0)) + {Z!r} * rse)), 9) END AS ci_hi FROM s""",
)
def severity_curve(spark, sf):
    out = E.severity_curve(campaign(spark, sf), ["job"], F.col("min_d"), [-0.25, 0.0, 0.3, 0.5, 1.0, 2.5])
    cols = ["n", "hits", "estimate", "se", "rse", "hit_ess", "ci_lo", "ci_hi"]
    return rounded(out.select("job", "threshold", *cols), {c: d for c, d in IS_ROUND.items() if c in cols})


FAM_SQL = f"""{CAMPAIGN_SQL}, fa AS (SELECT *, CASE WHEN NOT failure THEN NULL
    WHEN first_detection_ms IS NULL OR first_detection_ms > 1200 THEN 'late_detection'
    WHEN first_external_message_age_ms IS NULL OR first_external_message_age_ms > 40 THEN 'early_detection_stale_first_delivery'
    ELSE 'early_detection_fresh_first_delivery' END AS family FROM ca)"""
CUTS = {"detection_cut": 1200, "age_cut": 40}


@query(
    "failure_family",
    f"""WITH {FAM_SQL} SELECT job, sampling_component, coalesce(family, 'none') AS family, count(*) AS n,
  round(sum(w), 6) AS weight FROM fa GROUP BY ALL""",
)
def failure_family(spark, sf):
    rows = campaign(spark, sf).withColumn("family", F.coalesce(FM.failure_family(**CUTS), F.lit("none")))
    return rows.groupBy("job", "sampling_component", "family").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(safe_exp(F.col("log_weight"))), 6).alias("weight")
    )


@query(
    "principal_mode_hit",
    f"""WITH {CAMPAIGN_SQL} SELECT job, count(*) AS n, count(*) FILTER (WHERE failure AND route_signature = 'R|1') AS hits
FROM ca GROUP BY job""",
)
def principal_mode_hit(spark, sf):
    return campaign(spark, sf).groupBy("job").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(FM.principal_mode_hit("R|1")).alias("hits")
    )


FAMS = list(FM.FAMILIES)
Y_SQL = ", ".join(f"CASE WHEN family = '{f}' THEN w ELSE 0 END AS y{i}" for i, f in enumerate(FAMS))
VEC_SQL = f"""{FAM_SQL}, y AS (SELECT *, {Y_SQL} FROM fa),
a AS (SELECT job, count(*) AS n, {", ".join(f"sum(y{i}) AS s{i}, sum(y{i} * y{i}) AS q{i}, max(y{i}) AS m{i}, "
  f"count(*) FILTER (WHERE family = '{f}') AS c{i}" for i, f in enumerate(FAMS))}, avg(w * failure::INT) AS direct,
  count(*) FILTER (WHERE failure) AS failures FROM y GROUP BY job)"""


def cov_sql(scheme: str) -> str:
    pairs = FM._pairs()
    if scheme == "iid":
        cells = ", ".join(f"covar_samp(y{i}, y{j}) / count(*) AS v{i}{j}" for i, j in pairs)
        return f"c AS (SELECT job, {cells} FROM y GROUP BY job)"
    inner = ", ".join(f"covar_samp(y{i}, y{j}) * count(*) AS h{i}{j}" for i, j in pairs)
    outer = ", ".join(f"sum(h{i}{j}) / sum(nh) ** 2 AS v{i}{j}" for i, j in pairs)
    return f"""hh AS (SELECT job, sampling_component, count(*) AS nh, {inner} FROM y GROUP BY ALL),
c AS (SELECT job, {outer} FROM hh GROUP BY job)"""


def vector_sql(scheme: str) -> str:
    rows = []
    for i, f in enumerate(FAMS):
        var = []
        for a in range(3):
            for b in range(3):
                ga = f"((({1.0 if a == i else 0.0}) - s{i} / tot) / (tot / n))"
                gb = f"((({1.0 if b == i else 0.0}) - s{i} / tot) / (tot / n))"
                var.append(f"{ga} * {gb} * v{min(a, b)}{max(a, b)}")
        rows.append(
            f"SELECT job, n, '{f}' AS family, c{i} AS events, s{i} / n AS est, sqrt(v{i}{i}) AS se, "
            f"sqrt(v{i}{i}) / nullif(s{i} / n, 0) AS rse, s{i} * s{i} / nullif(q{i}, 0) AS ess, m{i} / nullif(s{i}, 0) AS mc, s{i} / tot AS share, "
            f"sqrt(greatest(0, {' + '.join(var)})) AS share_se FROM b"
        )
    return f"""{VEC_SQL}, {cov_sql(scheme)}, b AS (SELECT *, s0 + s1 + s2 AS tot FROM a JOIN c USING (job)),
vec AS ({' UNION ALL '.join(rows)})"""


ZS = E.z_two_sided(0.05 / 3)
# a family without weight has the interval (0, NULL), no relative error and ESS 0
FAMILY_OUT = f"""SELECT job, n, family, events, round(est, 9) AS estimate, round(se, 9) AS se, round(rse, 9) AS rse,
  coalesce(round(ess, 6), 0) AS ess, round(mc, 9) AS max_contrib, coalesce(round(exp(ln(nullif(est, 0)) - {Z!r} * rse), 9), 0) AS ci_lo,
  CASE WHEN est > 0 THEN round(least(1, exp(ln(nullif(est, 0)) + {Z!r} * rse)), 9) END AS ci_hi,
  coalesce(round(exp(ln(nullif(est, 0)) - {ZS!r} * rse), 9), 0) AS sim_lo,
  CASE WHEN est > 0 THEN round(least(1, exp(ln(nullif(est, 0)) + {ZS!r} * rse)), 9) END AS sim_hi FROM vec"""
FAMILY_ROUND = {c: 9 for c in ("estimate", "se", "rse", "max_contrib", "ci_lo", "ci_hi", "sim_lo", "sim_hi")} | {"ess": 6}
FAMILY_COLS = ["job", "n", "family", "events", "estimate", "se", "rse", "ess", "max_contrib", "ci_lo", "ci_hi", "sim_lo", "sim_hi"]


def sums(spark, sf, scheme):
    return FM.family_sums(campaign(spark, sf), ["job"], scheme, FM.failure_family(**CUTS))


@query("family_vector", f"WITH {vector_sql('iid')} {FAMILY_OUT}")
def family_vector(spark, sf):
    out = FM.family_vector(sums(spark, sf, "iid_is"), ["job"], "iid_is")
    return rounded(out.select(*FAMILY_COLS), FAMILY_ROUND)


@query("family_vector_stratified", f"WITH {vector_sql('strat')} {FAMILY_OUT}")
def family_vector_stratified(spark, sf):
    out = FM.family_vector(sums(spark, sf, "stratified_is"), ["job"], "stratified_is")
    return rounded(out.select(*FAMILY_COLS), FAMILY_ROUND)


@query(
    "family_covariance",
    f"""WITH {VEC_SQL}, {cov_sql('iid')} """
    + " UNION ALL ".join(
        f"SELECT job, '{FAMS[i]}' AS family, '{FAMS[j]}' AS other, round(v{min(i, j)}{max(i, j)} * 1e6, 6) AS cov_e6 FROM c"
        for i in range(3)
        for j in range(3)
    ),
)
def family_covariance(spark, sf):
    out = FM.family_covariance(sums(spark, sf, "iid_is"), ["job"])
    return out.select("job", "family", "other", F.round(F.col("cov") * 1e6, 6).alias("cov_e6"))


@query(
    "family_aggregate",
    f"""WITH {vector_sql('iid')} SELECT job, n, failures, round(tot / n, 9) AS estimate,
  round(sqrt(v00 + v11 + v22 + 2 * (v01 + v02 + v12)), 9) AS se,
  round(sqrt(v00 + v11 + v22 + 2 * (v01 + v02 + v12)) / (tot / n), 9) AS rse, abs(tot / n - direct) < 1e-12 AS partitioned FROM b""",
)
def family_aggregate(spark, sf):
    out = FM.family_aggregate(sums(spark, sf, "iid_is"), ["job"]).drop("residual")
    return rounded(out, {"estimate": 9, "se": 9, "rse": 9})


@query(
    "conditional_share",
    f"""WITH {vector_sql('iid')}, l AS (SELECT * EXCLUDE (share_se), CASE WHEN share > 0 AND share < 1 THEN share_se END AS share_se,
  CASE WHEN share > 0 AND share < 1 THEN ln(share / (1 - share)) END AS lg FROM vec),
l2 AS (SELECT *, {Z!r} * share_se / (share * (1 - share)) AS hw FROM l)
SELECT job, family, round(share, 9) AS share, round(share_se, 9) AS se, round(1 / (1 + exp(-(lg - hw))), 9) AS ci_lo,
  round(1 / (1 + exp(-(lg + hw))), 9) AS ci_hi FROM l2""",
)
def conditional_share(spark, sf):
    vec = FM.family_vector(sums(spark, sf, "iid_is"), ["job"], "iid_is")
    return rounded(FM.conditional_share(vec, ["job"]), {"share": 9, "se": 9, "ci_lo": 9, "ci_hi": 9})


# Exact bounds in SQL: halving on the binomial tail, written with log-gamma.
TAIL = """list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
      + i * ln(mid) + (n - i) * ln(1 - mid))))"""


def bound_sql(name: str, source: str, k: str, delta: str) -> str:
    """CTEs giving {name}(k, n, bound): the upper bound of every distinct ({k}, n) of ``source``."""
    return f"""{name}_in AS (SELECT DISTINCT ({k})::BIGINT AS k, n FROM {source}),
{name}_it AS (SELECT k, n, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM {name}_in WHERE k < n AND n > 0
  UNION ALL SELECT k, n, CASE WHEN tail > {delta} THEN mid ELSE lo END, CASE WHEN tail > {delta} THEN hi ELSE mid END, step + 1
  FROM (SELECT *, {TAIL.format(k='k')} AS tail FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_it WHERE step < 50))),
{name} AS (SELECT k, n, hi AS bound FROM {name}_it WHERE step = 50
  UNION ALL SELECT k, n, 1.0 FROM {name}_in WHERE k >= n OR n = 0)"""


NOM_SQL = f"""{CAMPAIGN_SQL}, cnt AS (SELECT job, sampling_component, first_external_message_age_ms::BIGINT AS age,
  count(*) AS n, count(*) FILTER (WHERE failure) AS k FROM ca GROUP BY ALL)"""


@query(
    "nominal_summary",
    f"""WITH RECURSIVE {NOM_SQL}, {bound_sql('u2', 'cnt', 'k', '0.025')}, {bound_sql('l2', 'cnt', 'n - k', '0.025')},
{bound_sql('u1', 'cnt', 'k', '0.05')}
SELECT job, sampling_component, coalesce(age, -1) AS age, cnt.n, cnt.k, round(cnt.k / cnt.n, 9) AS p,
  CASE WHEN cnt.k = 0 THEN 0 ELSE round(1 - l2.bound, 7) END AS lo, round(u2.bound, 7) AS hi, round(u1.bound, 7) AS upper
FROM cnt JOIN u2 ON u2.k = cnt.k AND u2.n = cnt.n JOIN l2 ON l2.k = cnt.n - cnt.k AND l2.n = cnt.n
JOIN u1 ON u1.k = cnt.k AND u1.n = cnt.n""",
)
def nominal_summary(spark, sf):
    rows = campaign(spark, sf).withColumn(
        "age", F.coalesce(F.col("first_external_message_age_ms").cast("bigint"), F.lit(-1))
    )
    out = E.nominal_summary(rows, ["job", "sampling_component", "age"], HIT)
    return rounded(out, {"p": 9, "lo": 7, "hi": 7, "upper": 7})


@query(
    "cp_upper",
    f"""WITH RECURSIVE cnt AS (SELECT l_partkey AS gidx, count(*) AS n, count(*) FILTER (WHERE l_quantity > 47) AS k
  FROM lineitem GROUP BY 1), {bound_sql('u', 'cnt', 'k', '0.005')}
SELECT gidx, cnt.n, cnt.k, round(bound, 7) AS upper FROM cnt JOIN u ON u.k = cnt.k AND u.n = cnt.n""",
)
def cp_upper(spark, sf):
    counts = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("gidx"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 47).alias("k"))
    )
    return rounded(B.with_cp_upper(counts, "k", "n", F.lit(0.005), "upper"), {"upper": 7})


SCHEMES_SQL = """CASE job WHEN 'A' THEN 'deterministic_mixture' WHEN 'N' THEN 'iid_single_proposal' ELSE 'nominal_mc' END"""


def jobs(spark, sf):
    """One job per return flag, one per sampling scheme."""
    flag = F.col("l_returnflag")
    scheme = (
        F.when(flag == "A", "deterministic_mixture").when(flag == "N", "iid_single_proposal").otherwise("nominal_mc")
    )
    return table(spark, sf, "lineitem").select(flag.alias("job"), scheme.alias("scheme")).distinct()


def job_rows(spark, sf):
    c = campaign(spark, sf)
    return c.withColumns(
        {"job": F.col("sampling_component"), "sampling_component": F.when(F.col("sampling_component") == "A", F.col("job"))}
    )


MODE_SQL = f"""{CAMPAIGN_SQL}, jr AS (SELECT sampling_component AS job, job AS stratum, failure, w,
  failure AND right(route_signature, 1) = '1' AS hit FROM ca),
y AS (SELECT *, CASE WHEN hit THEN w ELSE 0 END AS y FROM jr),
h AS (SELECT job, stratum, count(*) AS nh, var_samp(y) AS vh FROM y GROUP BY ALL),
v AS (SELECT job, sum(nh * vh) AS vs FROM h GROUP BY job),
s AS (SELECT job, {SCHEMES_SQL} AS scheme, count(*) AS n, count(*) FILTER (WHERE hit) AS events,
  count(*) FILTER (WHERE failure) AS failures, avg(y) AS wm, var_samp(y) AS wv, sum(y) AS sy, sum(y * y) AS sy2, max(y) AS my
  FROM y GROUP BY job),
e AS (SELECT s.*, CASE scheme WHEN 'nominal_mc' THEN events / n ELSE wm END AS est,
  CASE scheme WHEN 'nominal_mc' THEN sqrt(events / n * (1 - events / n) / n) WHEN 'deterministic_mixture' THEN sqrt(vs) / n
    ELSE sqrt(wv / n) END AS se FROM s JOIN v USING (job)),
cnt AS (SELECT n, events AS k FROM e WHERE scheme = 'nominal_mc'),
{bound_sql('u2', 'cnt', 'k', '0.025')}, {bound_sql('l2', 'cnt', 'n - k', '0.025')}, {bound_sql('u1', 'cnt', 'k', '0.05')},
mode AS (SELECT job, scheme, CASE scheme WHEN 'nominal_mc' THEN 'exact_binomial' WHEN 'deterministic_mixture' THEN 'stratified'
    ELSE 'iid_weighted' END AS estimator, est AS estimate, se, CASE WHEN scheme <> 'nominal_mc' THEN se / est END AS rse,
  CASE WHEN scheme = 'nominal_mc' THEN (SELECT 1 - bound FROM l2) ELSE exp(ln(est) - {Z!r} * se / est) END AS ci_lo,
  CASE WHEN scheme = 'nominal_mc' THEN (SELECT bound FROM u2) ELSE least(1, exp(ln(est) + {Z!r} * se / est)) END AS ci_hi,
  events, CASE WHEN scheme <> 'nominal_mc' THEN sy * sy / sy2 END AS event_ess, failures,
  CASE WHEN scheme <> 'nominal_mc' THEN my / sy END AS max_contrib,
  CASE WHEN scheme = 'nominal_mc' THEN (SELECT bound FROM u1) END AS one_sided FROM e)"""
MODE_ROUND = {c: 7 for c in ("estimate", "se", "rse", "ci_lo", "ci_hi", "max_contrib", "one_sided")} | {"event_ess": 5}
MODE_OUT = ", ".join(
    f"round({c}, {MODE_ROUND[c]}) AS {c}" if c in MODE_ROUND else c for c in FM.MODE_COLUMNS
)


def modes(spark, sf):
    hit = F.col("failure") & (F.substring("route_signature", -1, 1) == "1")
    return FM.mode_estimate(job_rows(spark, sf), jobs(spark, sf), hit)


@query("mode_estimate", f"WITH RECURSIVE {MODE_SQL} SELECT {MODE_OUT} FROM mode")
def mode_estimate(spark, sf):
    return rounded(modes(spark, sf), MODE_ROUND)


REFUSED_SQL = """re AS (SELECT 'U' AS job, 'other' AS scheme, 'unknown_scheme' AS reason, failure, route_signature FROM ca WHERE sampling_component = 'R'
  UNION ALL SELECT 'C', 'iid_single_proposal', 'component_on_iid_job', failure, route_signature FROM ca WHERE sampling_component = 'A'
  UNION ALL SELECT 'M', 'deterministic_mixture', 'mixture_without_component', failure, route_signature FROM ca WHERE sampling_component = 'N'
  UNION ALL SELECT 'P', NULL, 'unplanned', failure, route_signature FROM ca WHERE sampling_component = 'N')"""


def replayed(spark, sf):
    """Jobs A, N and R under their schemes, copies of them that break a rule each, and a planned job without rows."""
    rows = job_rows(spark, sf).withColumn("proposal_log_ratios", F.create_map(F.lit("speed"), F.lit(0.0)))
    for name, source in (("U", "R"), ("C", "A"), ("M", "N"), ("P", "N")):
        rows = rows.unionByName(rows.where(F.col("job") == source).withColumn("job", F.lit(name)))
    broken = [("U", "other"), ("C", "iid_single_proposal"), ("M", "deterministic_mixture"), ("Z", "nominal_mc")]
    plan = jobs(spark, sf).unionByName(spark.createDataFrame(broken, "job string, scheme string"))
    hit = F.col("failure") & (F.substring("route_signature", -1, 1) == "1")
    return RP.replay_sums(rows, plan, hit, FM.failure_family(detection_cut=1000, age_cut=50))


@query(
    "replay_modes",
    f"""WITH RECURSIVE {MODE_SQL}, {REFUSED_SQL},
agg AS (SELECT sum(w) ** 2 / sum(w * w) AS ess FROM jr WHERE failure AND job = 'A'),
st AS (SELECT string_agg(stratum || ':' || c, ',' ORDER BY stratum) AS strata FROM (SELECT stratum, count(*) AS c FROM jr WHERE job = 'A' GROUP BY 1))
SELECT {MODE_OUT}, CASE WHEN job = 'A' THEN (SELECT round(ess, 5) FROM agg) END AS aggregate_ess,
  CASE WHEN job = 'A' THEN (SELECT strata FROM st) ELSE '' END AS strata,
  CASE job WHEN 'A' THEN 'stratified log normal' WHEN 'N' THEN 'log normal' ELSE 'exact' END AS interval_method, NULL AS reason FROM mode
UNION ALL SELECT job, scheme, CASE job WHEN 'C' THEN 'iid_weighted' WHEN 'M' THEN 'stratified' END, NULL, NULL, NULL, NULL, NULL,
  count(*) FILTER (WHERE failure AND right(route_signature, 1) = '1'), NULL, count(*) FILTER (WHERE failure), NULL, NULL, NULL,
  '', NULL, reason FROM re GROUP BY job, scheme, reason
UNION ALL SELECT 'Z', 'nominal_mc', 'exact_binomial', NULL, NULL, NULL, NULL, NULL, 0, NULL, 0, NULL, NULL, NULL, '', NULL, 'no_rows'""",
)
def replay_modes(spark, sf):
    out = rounded(RP.replay_modes(replayed(spark, sf)), MODE_ROUND | {"aggregate_ess": 5})
    own = F.when(F.col("job") == "A", F.transform("strata", lambda x: F.concat_ws(":", x["stratum"], x["n"].cast("string"))))
    # the copy without components has one nameless stratum
    return out.drop("n").withColumn("strata", F.coalesce(F.array_join(own, ","), F.lit("")))


@query(
    "replay_verify",
    f"""WITH RECURSIVE {MODE_SQL}, p AS (SELECT job, 'estimate' AS field, estimate AS got, CASE job WHEN 'N' THEN estimate + 0.25 ELSE estimate END AS want FROM mode
  UNION ALL SELECT job, 'events', events, CASE job WHEN 'R' THEN events + 1 ELSE events END FROM mode)
SELECT job, field, round(got, 7) AS got, round(want, 7) AS want, FALSE AS absent FROM p WHERE got <> want
UNION ALL SELECT 'S', 'estimate', NULL, 0.5, TRUE UNION ALL SELECT 'S', 'events', NULL, 3.0, TRUE""",
)
def replay_verify(spark, sf):
    """A published analysis with one estimate and one count changed, and a job that the campaign does not have."""
    got = RP.replay_modes(replayed(spark, sf)).select("job", F.col("estimate"), F.col("events").cast("double").alias("events"))
    known = got.where(F.col("job").isin("A", "N", "R"))
    moved = {
        "estimate": F.col("estimate") + F.when(F.col("job") == "N", 0.25).otherwise(0.0),
        "events": F.col("events") + F.when(F.col("job") == "R", 1.0).otherwise(0.0),
    }
    published = known.withColumns(moved).unionByName(spark.createDataFrame([("S", 0.5, 3.0)], "job string, estimate double, events double"))
    out = J.verify_campaign(got, published, ["estimate", "events"])
    return out.select("job", "field", F.round("got", 7).alias("got"), F.round("want", 7).alias("want"), "absent")


@query(
    "replay_family_rows",
    f"""WITH {CAMPAIGN_SQL}, jr AS (SELECT sampling_component AS job, job AS stratum, failure, w,
  CASE WHEN failure THEN CASE WHEN first_detection_ms IS NULL OR first_detection_ms > 1000 THEN 0
    WHEN first_external_message_age_ms IS NULL OR first_external_message_age_ms > 50 THEN 1 ELSE 2 END END AS f FROM ca),
y AS (SELECT *, i, CASE WHEN f = i THEN w ELSE 0 END AS y FROM jr, (SELECT unnest([0, 1, 2]) AS i) WHERE job <> 'R'),
h AS (SELECT job, i, stratum, count(*) * var_samp(y) AS v FROM y GROUP BY ALL),
v AS (SELECT job, i, sum(v) AS v FROM h GROUP BY ALL),
s AS (SELECT job, i, count(*) AS n, count(*) FILTER (WHERE f = i) AS events, avg(y) AS est, var_samp(y) / count(*) AS vi,
  CASE WHEN sum(y) > 0 THEN max(y) / sum(y) END AS mc, CASE WHEN sum(y) > 0 THEN sum(y) ** 2 / sum(y * y) ELSE 0 END AS ess FROM y GROUP BY ALL),
e AS (SELECT *, sqrt(CASE WHEN job = 'A' THEN v / n / n ELSE vi END) AS se FROM s JOIN v USING (job, i)),
r AS (SELECT * FROM (VALUES ('R', 'weights_not_unit'), ('U', 'unknown_scheme'), ('C', 'component_on_iid_job'), ('M', 'mixture_without_component'),
  ('P', 'unplanned'), ('Z', 'no_rows')) AS x(job, reason))
SELECT job, (ARRAY['late_detection', 'early_detection_stale_first_delivery', 'early_detection_fresh_first_delivery'])[i + 1] AS family, events,
  round(est, 9) AS estimate, round(se, 9) AS se, round(ess, 5) AS ess, round(mc, 9) AS max_contrib,
  round(est / sum(est) OVER (PARTITION BY job), 9) AS share, NULL AS reason FROM e
UNION ALL SELECT job, unnest(['late_detection', 'early_detection_stale_first_delivery', 'early_detection_fresh_first_delivery']), NULL, NULL, NULL, NULL, NULL, NULL,
  reason FROM r""",
)
def replay_family_rows(spark, sf):
    out = RP.replay_family_rows(replayed(spark, sf)).select("job", "family", "events", "estimate", "se", "ess", "max_contrib", "share", "reason")
    return rounded(out, {"estimate": 9, "se": 9, "ess": 5, "max_contrib": 9, "share": 9})


@query(
    "precision_gates",
    f"""WITH RECURSIVE {MODE_SQL}, g AS (SELECT *, array_to_string(list_filter([
    CASE WHEN NOT coalesce(max_contrib <= 0.2, FALSE) THEN 'maximum_event_contribution' END,
    CASE WHEN NOT coalesce(rse <= 0.05, FALSE) THEN 'maximum_relative_standard_error' END,
    CASE WHEN NOT coalesce(event_ess >= 300, FALSE) THEN 'minimum_event_ess' END,
    CASE WHEN events < 20 THEN 'minimum_event_paths' END], lambda x: x IS NOT NULL), ',') AS weighted FROM mode)
SELECT job, CASE WHEN events = 0 THEN 'not_observed' WHEN scheme = 'nominal_mc' THEN 'mc_exact_but_imprecise'
    WHEN weighted = '' THEN 'precise' ELSE 'imprecise_exploratory' END AS status,
  CASE WHEN scheme = 'nominal_mc' THEN 'maximum_relative_standard_error' || CASE WHEN events < 20 THEN ',minimum_event_paths' ELSE '' END
    ELSE weighted END AS failed_gates,
  CASE WHEN scheme = 'nominal_mc' THEN 'mc_exact' WHEN weighted = '' THEN 'precise' ELSE 'imprecise_exploratory' END AS mode_status
FROM g""",
)
def precision_gates(spark, sf):
    g = G.PrecisionGates(ess=300, rse=0.05)
    args = [F.col(c) for c in ("scheme", "events", "event_ess", "max_contrib", "rse")]
    status, gates = G.precision_status(*args, g)
    mstatus, _ = G.mode_status(*args, g)
    return modes(spark, sf).select(
        "job", status.alias("status"), F.array_join(gates, ",").alias("failed_gates"), mstatus.alias("mode_status")
    )


GATE_IN_SQL = f"""{CAMPAIGN_SQL}, cg AS (SELECT *, first_external_message_age_ms::BIGINT AS age FROM ca),
{is_sql('cg', 'job, age', 'failure')},
q AS (SELECT *, CASE WHEN sy > 0 THEN exp(ln(nullif(est, 0)) - {Z!r} * rse) ELSE 0 END AS lo,
  CASE WHEN sy > 0 THEN least(1, exp(ln(nullif(est, 0)) + {Z!r} * rse)) END AS hi, sy * sy / sy2 AS hess FROM s),
d AS (SELECT job, age, sum(w) ** 2 / sum(w * w) / count(*) AS er, max(w) / sum(w) AS mx, ln(avg(w)) AS lm FROM y GROUP BY ALL),
wq AS (SELECT q.*, er, mx, lm, list_filter([CASE WHEN er < 0.8 * (1 - 1e-9) THEN 'ess_ratio_below_minimum' END,
  CASE WHEN mx > 0.006 * (1 + 1e-9) THEN 'max_normalized_weight_above_maximum' END,
  CASE WHEN abs(lm) > 0.12 * (1 + 1e-9) THEN 'mean_weight_inconsistent_with_one' END], lambda x: x IS NOT NULL) AS wr FROM q JOIN d ON q.job = d.job AND q.age IS NOT DISTINCT FROM d.age)"""


def gated(spark, sf):
    rows = campaign(spark, sf).withColumn("age", F.col("first_external_message_age_ms").cast("bigint"))
    est = E.is_estimate(rows, ["job", "age"], HIT)  # rows without age are a group of their own
    quality = G.weight_quality(
        F.col("ess_ratio"), F.col("max_norm_w"), F.col("log_mean_w"), min_ess_ratio=0.8, max_weight=0.006, max_log_mean=0.12
    )
    return est.withColumn("quality", quality)


@query("weight_quality_gates", f"WITH {GATE_IN_SQL} SELECT job, age, array_to_string(wr, ',') AS reasons, len(wr) = 0 AS passed FROM wq")
def weight_quality_gates(spark, sf):
    return gated(spark, sf).select(
        "job", "age", F.array_join("quality", ",").alias("reasons"), (F.size("quality") == 0).alias("passed")
    )


@query(
    "proposal_validation",
    f"""WITH {GATE_IN_SQL}, p AS (SELECT *, rse * sqrt(n / 1000.0) AS pr FROM wq),
r AS (SELECT *, list_concat(wr, list_filter([
  CASE WHEN NOT coalesce(pr <= 0.2 * (1 + 1e-9), FALSE) THEN 'projected_final_relative_standard_error_above_maximum' END,
  CASE WHEN hits < 10 THEN 'proposal_validation_failures_below_minimum' END], lambda x: x IS NOT NULL)) AS rs FROM p)
SELECT job, age, round(pr, 9) AS projected_rse, array_to_string(list_sort(rs), ',') AS reasons, len(rs) = 0 AS passed FROM r""",
)
def proposal_validation(spark, sf):
    projected, reasons = G.proposal_validation(
        F.col("quality"), F.col("n"), F.col("hits"), F.col("rse"), final_n=1000, min_failures=10, max_projected=0.2
    )
    return gated(spark, sf).select(
        "job",
        "age",
        F.round(projected, 9).alias("projected_rse"),
        F.array_join(F.array_sort(reasons), ",").alias("reasons"),
        (F.size(reasons) == 0).alias("passed"),
    )


@query(
    "final_estimate_gates",
    f"""WITH {GATE_IN_SQL}, r AS (SELECT *, list_concat(wr, list_filter([
  CASE WHEN hits < 10 THEN 'proposal_failures_below_minimum' END,
  CASE WHEN coalesce(hess, 0) < 8 * (1 - 1e-9) THEN 'failure_ess_below_minimum' END,
  CASE WHEN NOT coalesce(rse <= 0.3 * (1 + 1e-9), FALSE) THEN 'relative_standard_error_above_maximum'
       WHEN rse <= 0 THEN 'positive_relative_standard_error_unavailable' END,
  CASE WHEN NOT coalesce(lo > 0, FALSE) THEN 'positive_confidence_interval_lower_bound_unavailable' END,
  CASE WHEN hi IS NULL THEN 'finite_confidence_interval_unavailable' END], lambda x: x IS NOT NULL)) AS rs FROM wq)
SELECT job, age, array_to_string(list_sort(rs), ',') AS reasons, len(rs) = 0 AS passed FROM r""",
)
def final_estimate_gates(spark, sf):
    reasons = G.final_estimate(
        F.col("quality"), F.col("hits"), F.col("hit_ess"), F.col("rse"), F.col("ci_lo"), F.col("ci_hi"),
        min_failures=10, min_ess=8.0, max_rse=0.3,
    )
    return gated(spark, sf).select(
        "job", "age", F.array_join(F.array_sort(reasons), ",").alias("reasons"), (F.size(reasons) == 0).alias("passed")
    )


@query(
    "published_compare",
    """WITH g AS (SELECT l_suppkey AS job, l_linestatus AS field, avg(l_quantity) AS got FROM lineitem GROUP BY ALL),
w AS (SELECT l_suppkey AS job, l_linestatus AS field, avg(CASE WHEN l_suppkey % 3 = 0 AND l_tax = 0 THEN l_quantity + 1 ELSE l_quantity END) AS want
  FROM lineitem GROUP BY ALL)
SELECT job, field, round(got, 6) AS got, round(want, 6) AS want, FALSE AS absent FROM w JOIN g USING (job, field)
WHERE abs(got - want) > 1e-9 * want UNION ALL
SELECT job + 1000000, 'extra', NULL, 1.0, TRUE FROM w WHERE job < 3 AND field = 'O'""",
)
def published_compare(spark, sf):
    li = table(spark, sf, "lineitem").withColumnsRenamed({"l_suppkey": "job", "l_linestatus": "field"})
    text = F.lit(None).cast("string").alias("text")
    q = F.col("l_quantity")
    moved = F.when((F.col("job") % 3 == 0) & (F.col("l_tax") == 0), q + 1).otherwise(q)
    got = li.groupBy("job", "field").agg(F.avg(q).alias("number")).select("job", "field", "number", text)
    want = li.groupBy("job", "field").agg(F.avg(moved).alias("number")).select("job", "field", "number", text)
    extra = want.where("job < 3 AND field = 'O'").select(
        (F.col("job") + 1000000).alias("job"), F.lit("extra").alias("field"), F.lit(1.0).alias("number"), text
    )
    out = R.published_compare(got, want.unionByName(extra), ["job"], rel=1e-9)
    return out.select("job", "field", F.round("got", 6).alias("got"), F.round("want", 6).alias("want"), "absent")


@query(
    "campaign_scan",
    """SELECT l_returnflag AS job, count(*) + CASE WHEN l_returnflag = 'N' THEN 5 ELSE 0 END AS planned, count(*) AS rows
FROM lineitem GROUP BY 1 HAVING l_returnflag = 'N'""",
)
def campaign_scan(spark, sf):
    rows = CS.parsed(CS.scan(spark, written_campaign(spark, sf)), CAMPAIGN_ROW)
    return campaigns.count_check(rows, campaign_plan(spark, sf))


SHARD_ROWS = 400
SHARD_ORDER = ["l_orderkey", "l_linenumber", "l_quantity", "l_suppkey", "l_discount"]  # rows that tie here are equal
PLACES_SQL = f"""pl AS (SELECT l_returnflag AS job, (n - 1) // {SHARD_ROWS} AS shard, (n - 1) % {SHARD_ROWS} AS ordinal,
  l_returnflag || '|' || l_linenumber AS route_signature, l_quantity > 50 - l_suppkey % 5 AS failure, 0.5 + 10 * l_discount AS w
  FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity, l_suppkey, l_discount) AS n
  FROM lineitem))"""


def written_campaign(spark, sf):
    """lineitem as a campaign: a job per return flag, its rows in order, ``SHARD_ROWS`` to a shard, all jobs in one write."""
    root = scratch_path(spark, "campaign")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("job"), *SHARD_ORDER,
        F.to_json(
            F.struct(
                (F.col("l_quantity") > 50 - F.col("l_suppkey") % 5).alias("failure"),
                F.ln(0.5 + 10 * F.col("l_discount")).alias("log_weight"),
                F.concat(F.col("l_returnflag"), F.lit("|"), F.col("l_linenumber").cast("string")).alias("route_signature"),
            )
        ).alias("line"),
    )
    at = row_numbers(rows, ["job"], SHARD_ORDER, "n").withColumn("n", F.col("n") - 1)
    CS.write(at.select("job", F.floor(F.col("n") / SHARD_ROWS).alias("shard"), (F.col("n") % SHARD_ROWS).alias("ordinal"), "line"), root)
    return root


def campaign_plan(spark, sf):
    """The planned episodes: those there are, and five more for job N."""
    rows = job_rows(spark, sf).groupBy(F.col("job").alias("key"))
    return rows.agg((F.count(F.lit(1)) + F.when(F.first("job") == "N", 5).otherwise(0)).alias("episodes"))


@query(
    "campaign_rows",
    f"WITH {PLACES_SQL} SELECT job, shard::INT AS shard, ordinal, route_signature, failure, round(w, 9) AS w FROM pl",
)
def campaign_rows(spark, sf):
    rows = CS.parsed(CS.scan(spark, written_campaign(spark, sf)), CAMPAIGN_ROW)
    return rows.select("job", "shard", "ordinal", "route_signature", "failure", F.round(F.exp("log_weight"), 9).alias("w"))


@query(
    "campaign_problems",
    f"""WITH {PLACES_SQL} SELECT DISTINCT job, 1 AS shard, 'digest mismatch' AS problem, NULL::BIGINT AS found, NULL::BIGINT AS expected
FROM pl WHERE shard = 1
UNION ALL SELECT DISTINCT job, 2, 'missing digest', NULL, NULL FROM pl WHERE shard = 2
UNION ALL SELECT job, NULL, 'row count', count(*), count(*) + 5 FROM pl WHERE job = 'N' GROUP BY job
UNION ALL SELECT 'planned', NULL, 'no shards', NULL, 7
UNION ALL SELECT 'lone', 3, 'missing shard', NULL, NULL
UNION ALL SELECT 'lone', NULL, 'not planned', 0, NULL""",
)
def campaign_problems(spark, sf):
    """A wrong digest beside every shard 1, none beside shard 2, a digest without a shard and a job that has not run."""
    root = written_campaign(spark, sf)
    CS.spoil(root, {1: "0" * 64, 2: None}, lone=("lone", 3))
    plan = campaign_plan(spark, sf).unionByName(spark.createDataFrame([("planned", 7)], "key string, episodes long"))
    return CS.problems(CS.scan(spark, root), plan)


@query(
    "scheme_violations",
    f"""SELECT l_returnflag AS job, 'mixture_without_ratios' AS rule, count(*) AS rows FROM lineitem
WHERE l_returnflag = 'A' GROUP BY 1""",
)
def scheme_violations(spark, sf):
    rows = job_rows(spark, sf).withColumn("proposal_log_ratios", F.lit(None).cast("map<string,double>"))
    return FM.scheme_violations(rows, jobs(spark, sf))


@query(
    "safe_exp",
    """SELECT l_partkey AS gidx, count(*) AS n, count(*) FILTER (WHERE x > 709.5) AS overflow,
  round(sum(CASE WHEN x <= 709.5 AND x >= -708.39 THEN exp(x) * 1e-307 END), 9) AS total,
  count(*) FILTER (WHERE x < -708.39) AS zero FROM (SELECT l_partkey, (l_quantity - 25) * 29.6 AS x FROM lineitem)
GROUP BY 1""",
)
def safe_exp_query(spark, sf):
    x = ((F.col("l_quantity") - 25) * 29.6).alias("x")
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("gidx"), x).withColumn("e", safe_exp(F.col("x")))
    return rows.groupBy("gidx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("e").isNull()).alias("overflow"),
        F.round(F.sum(F.col("e") * 1e-307), 9).alias("total"),
        F.count_if(F.col("e") == 0).alias("zero"),
    )


@query(
    "zero_failure_budget",
    """SELECT l_suppkey AS gidx, count(*) AS n, ceil(ln(0.05) / ln(1 - p))::BIGINT AS budget FROM (
  SELECT l_suppkey, 0.001 + l_discount / 2 AS p FROM lineitem) GROUP BY l_suppkey, p""",
)
def zero_failure_budget(spark, sf):
    p = (0.001 + F.col("l_discount") / 2).alias("p")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("gidx"), p)
    per = rows.groupBy("gidx", "p").agg(F.count(F.lit(1)).alias("n"))
    return per.select("gidx", "n", B.zero_failure_budget(F.col("p"), F.lit(0.05)).alias("budget"))




@query(
    "shard_digest_check",
    """SELECT l_returnflag AS job, count(*) AS rows, TRUE AS ok FROM lineitem GROUP BY 1
UNION ALL SELECT 'tampered', 0, FALSE""",
)
def shard_digest_check(spark, sf):
    """Every shard against the digest beside it; an extra digest has no shard."""
    root = written_campaign(spark, sf)
    CS.spoil(root, {}, lone=("tampered", 0))
    scanned = CS.scan(spark, root)
    return scanned.groupBy("job").agg(F.count("line").alias("rows"), F.bool_and(F.col("problem").isNull()).alias("ok"))
