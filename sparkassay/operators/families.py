"""Failure families, the joint estimate of their probabilities and the scheme-dependent mode estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binomial import with_cp_lower, with_cp_upper
from ..functions.numeric import ratio, safe_exp
from ..session import small_side
from .estimators import is_estimate, stratified_estimate, z_two_sided

# Family names and cuts, and the signature of the principal failure mode.
FAMILIES = (
    "late_detection",
    "early_detection_stale_first_delivery",
    "early_detection_fresh_first_delivery",
)
DETECTION_CUT_MS = 2990
AGE_CUT_MS = 200
PRINCIPAL_MODE = (
    "det=early|out=before_detection|fresh=late|age=fresh"
    "|brake=normal|ghost=0|wrong=0|miss=1|drop=0"
)
# Sampling scheme of a job -> estimator of its families.
FAMILY_SCHEME = {
    "iid_single_proposal": "iid_is",
    "deterministic_mixture": "stratified_is",
    "nominal_mc": "nominal_mc",
}
LEVEL = 0.05


def failure_family(detection_cut: float = DETECTION_CUT_MS, age_cut: float = AGE_CUT_MS) -> Column:
    """Exhaustive partition of failures by detection time and age of the first message; NULL otherwise."""
    det, age = F.col("first_detection_ms"), F.col("first_external_message_age_ms")
    late = det.isNull() | (det > detection_cut)
    stale = age.isNull() | (age > age_cut)
    return F.when(
        F.col("failure"), F.when(late, FAMILIES[0]).when(stale, FAMILIES[1]).otherwise(F.lit(FAMILIES[2]))
    )


def principal_mode_hit(signature: str = PRINCIPAL_MODE) -> Column:
    return F.coalesce(F.col("failure") & (F.col("route_signature") == signature), F.lit(False))


def _pairs() -> list[tuple[int, int]]:
    m = len(FAMILIES)
    return [(i, j) for i in range(m) for j in range(i, m)]


def family_sums(
    rows: DataFrame, keys: list[str], scheme: str, family: Column, stratum: str = "sampling_component"
) -> DataFrame:
    """One row per key: counts, means, covariance of the mean, ESS and largest contribution per family."""
    if scheme not in ("iid_is", "nominal_mc", "stratified_is"):
        raise ValueError(f"unknown scheme {scheme!r}")
    w = safe_exp(F.col("log_weight"))
    by = [*keys, "_h"] if scheme == "stratified_is" else list(keys)
    wide = rows.select(
        *keys,
        (F.col(stratum) if scheme == "stratified_is" else F.lit(None)).alias("_h"),
        family.alias("_f"),
        F.col("failure").alias("_fail"),
        w.alias("_w"),
    )
    ys = [F.when(F.col("_f") == name, F.col("_w")).otherwise(F.lit(0.0)) for name in FAMILIES]
    wide = wide.select("*", *[y.alias(f"_y{i}") for i, y in enumerate(ys)])
    n = F.count(F.lit(1))
    part = wide.groupBy(*by).agg(
        n.alias("n"),
        F.count_if("_fail").alias("failures"),
        F.sum(F.when(F.col("_fail"), F.col("_w")).otherwise(0.0)).alias("total"),
        F.count_if(F.abs(F.col("_w") - 1.0) > 1e-15).alias("off_nominal"),
        *[F.count_if(F.col("_f") == name).alias(f"c{i}") for i, name in enumerate(FAMILIES)],
        *[F.sum(f"_y{i}").alias(f"s{i}") for i in range(len(FAMILIES))],
        *[F.sum(F.col(f"_y{i}") * F.col(f"_y{i}")).alias(f"q{i}") for i in range(len(FAMILIES))],
        *[F.max(f"_y{i}").alias(f"m{i}") for i in range(len(FAMILIES))],
        *[F.covar_samp(f"_y{i}", f"_y{j}").alias(f"v{i}{j}") for i, j in _pairs()],
    )
    if scheme == "stratified_is":
        part = part.groupBy(*keys).agg(
            F.sum("n").alias("n"),
            *[F.sum(c).alias(c) for c in ("failures", "total", "off_nominal")],
            *[F.sum(f"{k}{i}").alias(f"{k}{i}") for k in "csq" for i in range(len(FAMILIES))],
            *[F.max(f"m{i}").alias(f"m{i}") for i in range(len(FAMILIES))],
            *[F.sum(F.col("n") * F.col(f"v{i}{j}")).alias(f"v{i}{j}") for i, j in _pairs()],
            F.count_if(F.col("n") < 2).alias("bad_strata"),
        )
        cov = {f"v{i}{j}": F.col(f"v{i}{j}") / (F.col("n") * F.col("n")) for i, j in _pairs()}
    elif scheme == "iid_is":
        cov = {f"v{i}{j}": F.col(f"v{i}{j}") / F.col("n") for i, j in _pairs()}
    else:
        mean = lambda i: F.col(f"s{i}") / F.col("n")
        cov = {
            f"v{i}{j}": ((mean(i) if i == j else F.lit(0.0)) - mean(i) * mean(j)) / F.col("n") for i, j in _pairs()
        }
    if scheme != "stratified_is":
        part = part.withColumn("bad_strata", F.when(F.col("n") < 2, F.lit(1)).otherwise(F.lit(0)))
    return part.withColumns(cov).withColumns({f"e{i}": F.col(f"s{i}") / F.col("n") for i in range(len(FAMILIES))})


def _cov(i: int, j: int) -> Column:
    return F.col(f"v{min(i, j)}{max(i, j)}")


def _log_normal_ci(est: Column, rse: Column, level: float) -> tuple[Column, Column]:
    z = z_two_sided(level)
    known = (est > 0) & rse.isNotNull()
    return (
        F.when(known, F.exp(F.ln(est) - z * rse)).otherwise(F.lit(0.0)),
        F.when(known, F.least(F.lit(1.0), F.exp(F.ln(est) + z * rse))),
    )


def _share_se(i: int) -> Column:
    """Delta-method error of e_i / sum(e)."""
    m = range(len(FAMILIES))
    tot = sum((F.col(f"e{k}") for k in m[1:]), F.col("e0"))
    grad = [(F.lit(1.0 if k == i else 0.0) - F.col(f"e{i}") / tot) / tot for k in m]
    var = F.lit(0.0)
    for a in m:
        for b in m:
            var = var + grad[a] * grad[b] * _cov(a, b)
    return F.sqrt(F.greatest(F.lit(0.0), var))


def family_vector(sums: DataFrame, keys: list[str], scheme: str) -> DataFrame:
    """Long form, one row per (key, family): estimate, error, intervals, gates' inputs and share."""
    m = len(FAMILIES)
    tot = sum((F.col(f"e{k}") for k in range(1, m)), F.col("e0"))
    nominal = scheme == "nominal_mc"
    structs = []
    for i, name in enumerate(FAMILIES):
        est = F.col(f"e{i}")
        se = F.sqrt(F.greatest(F.lit(0.0), _cov(i, i)))
        rse = F.when(est > 0, se / est)
        ess = F.coalesce(ratio(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"q{i}")), F.lit(0.0))
        share = F.when(tot > 0, est / tot)
        lo, hi = _log_normal_ci(est, rse, LEVEL)
        slo, shi = _log_normal_ci(est, rse, LEVEL / m)
        null = F.lit(None).cast("double")
        structs.append(
            F.struct(
                F.lit(name).alias("family"),
                F.col(f"c{i}").alias("events"),
                est.alias("estimate"),
                se.alias("se"),
                rse.alias("rse"),
                (null if nominal else ess).alias("ess"),
                (null if nominal else ratio(F.col(f"m{i}"), F.col(f"s{i}"))).alias("max_contrib"),
                (null if nominal else lo).alias("ci_lo"),
                (null if nominal else hi).alias("ci_hi"),
                (null if nominal else slo).alias("sim_lo"),
                (null if nominal else shi).alias("sim_hi"),
                share.alias("share"),
                F.when((share > 0) & (share < 1), _share_se(i)).alias("share_se"),
            )
        )
    out = sums.select(*keys, "n", F.explode(F.array(*structs)).alias("f")).select(*keys, "n", "f.*")
    if nominal:
        out = out.drop("ci_lo", "ci_hi", "sim_lo", "sim_hi")
        for d, lo, hi in ((LEVEL / 2, "ci_lo", "ci_hi"), (LEVEL / m / 2, "sim_lo", "sim_hi")):
            out = with_cp_upper(with_cp_lower(out, "events", "n", F.lit(d), lo), "events", "n", F.lit(d), hi)
        return with_cp_upper(out, "events", "n", F.lit(LEVEL), "one_sided")
    return out.withColumn("one_sided", F.lit(None).cast("double"))


def conditional_share(vector: DataFrame, keys: list[str], level: float = LEVEL) -> DataFrame:
    """Family share of all failures with a logit-scale interval; NULL interval at 0 and 1."""
    z = z_two_sided(level)
    inside = (F.col("share") > 0) & (F.col("share") < 1)
    logit = F.ln(F.col("share") / (1 - F.col("share")))
    half = z * F.col("share_se") / (F.col("share") * (1 - F.col("share")))
    inv = lambda x: 1.0 / (1.0 + F.exp(-x))
    return vector.select(
        *keys,
        "family",
        "share",
        F.when(inside, F.col("share_se")).alias("se"),
        F.when(inside, inv(logit - half)).alias("ci_lo"),
        F.when(inside, inv(logit + half)).alias("ci_hi"),
    )


def family_covariance(sums: DataFrame, keys: list[str]) -> DataFrame:
    cells = [
        F.struct(F.lit(FAMILIES[i]).alias("family"), F.lit(FAMILIES[j]).alias("other"), _cov(i, j).alias("cov"))
        for i in range(len(FAMILIES))
        for j in range(len(FAMILIES))
    ]
    return sums.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def family_aggregate(sums: DataFrame, keys: list[str]) -> DataFrame:
    """All families together, with the residual of the partition and its verdict."""
    m = range(len(FAMILIES))
    est = sum((F.col(f"e{k}") for k in m[1:]), F.col("e0"))
    var = sum((_cov(i, j) for i in m for j in m if (i, j) != (0, 0)), _cov(0, 0))
    direct = F.col("total") / F.col("n")
    counted = sum((F.col(f"c{k}") for k in m[1:]), F.col("c0"))
    out = sums.withColumns({"estimate": est, "se": F.sqrt(F.greatest(F.lit(0.0), var)), "residual": est - direct})
    close = F.abs(F.col("residual")) <= F.greatest(
        F.lit(1e-15), 1e-12 * F.greatest(F.abs("estimate"), F.abs(direct))
    )
    return out.select(
        *keys,
        "n",
        "failures",
        "estimate",
        "se",
        ratio(F.col("se"), F.col("estimate")).alias("rse"),
        "residual",
        ((counted == F.col("failures")) & close).alias("partitioned"),
    )


def scheme_violations(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs whose rows carry fields that contradict their sampling scheme: (job, rule, rows)."""
    has = F.col("sampling_component").isNotNull()
    ratios = F.col("proposal_log_ratios").isNotNull()
    rule = (
        F.when(~F.col("scheme").isin(*FAMILY_SCHEME), "unknown_scheme")
        .when((F.col("scheme") == "deterministic_mixture") & ~has, "mixture_without_component")
        .when((F.col("scheme") == "deterministic_mixture") & ~ratios, "mixture_without_ratios")
        .when((F.col("scheme") == "iid_single_proposal") & has, "component_on_iid_job")
    )
    return (
        rows.join(small_side(jobs.select("job", "scheme")), "job")
        .withColumn("rule", rule)
        .where("rule IS NOT NULL")
        .groupBy("job", "rule")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


MODE_COLUMNS = [
    "job", "scheme", "estimator", "estimate", "se", "rse", "ci_lo", "ci_hi", "events", "event_ess",
    "failures", "max_contrib", "one_sided",
]


def mode_estimate(rows: DataFrame, jobs: DataFrame, hit: Column) -> DataFrame:
    """One event per job, each job with the estimator of its sampling scheme.

    A job may hold most of the rows, so the job list is broadcast (after a size check) instead of
    shuffling the rows by job.
    """
    tagged = rows.withColumn("_hit", hit).join(small_side(jobs.select("job", "scheme")), "job")
    null = F.lit(None).cast("double")
    mixed = tagged.where(F.col("scheme") == "deterministic_mixture")
    strat = stratified_estimate(mixed, ["job", "scheme"], "sampling_component", F.col("_hit"), F.col("failure"))
    strat = strat.withColumn("estimator", F.lit("stratified")).withColumn("one_sided", null)

    single = tagged.where(F.col("scheme") == "iid_single_proposal")
    iid = is_estimate(single, ["job", "scheme"], F.col("_hit"))
    fails = single.groupBy("job").agg(F.count_if("failure").alias("failures"))
    iid = iid.join(fails, "job").withColumnsRenamed({"hits": "events", "hit_ess": "event_ess"})
    iid = iid.withColumn("estimator", F.lit("iid_weighted")).withColumn("one_sided", null)

    plain = tagged.where(F.col("scheme") == "nominal_mc")
    nom = plain.groupBy("job", "scheme").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("events"), F.count_if("failure").alias("failures")
    )
    nom = nom.withColumn("estimate", F.col("events") / F.col("n"))
    nom = nom.withColumn("se", F.sqrt(F.col("estimate") * (1 - F.col("estimate")) / F.col("n")))
    nom = with_cp_upper(with_cp_lower(nom, "events", "n", F.lit(0.025), "ci_lo"), "events", "n", F.lit(0.025), "ci_hi")
    nom = with_cp_upper(nom, "events", "n", F.lit(0.05), "one_sided")
    nom = nom.withColumns(
        {"rse": null, "event_ess": null, "max_contrib": null, "estimator": F.lit("exact_binomial")}
    )
    out = strat.select(*MODE_COLUMNS)
    for other in (iid, nom):
        out = out.unionByName(other.select(*MODE_COLUMNS))
    return out
