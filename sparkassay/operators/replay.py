"""Replay of a whole campaign from one pass over its rows.

Each row enters one buffer of mergeable moments, keyed by job, stratum and band of 64 log units of its weight: counts,
sums, sums of squares and greatest values of the weights of each event, and counts of everything that forbids an
estimate. Bands and strata are then merged in a table of a few rows per job, from which the mode estimate and the
family vector of every sampling scheme follow. A job that breaks a rule keeps its counts and gets a reason instead of
an estimate; a job without rows, or outside the plan, is listed too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binomial import with_cp_lower, with_cp_upper
from ..functions.numeric import ratio, safe_exp
from ..session import durable, small_side
from .estimators import z_two_sided
from .families import FAMILIES, FAMILY_SCHEME, LEVEL, family_vector

BAND = 64.0
NOMINAL, MIXED, SINGLE = "nominal_mc", "deterministic_mixture", "iid_single_proposal"
EVENTS = ("hit", "failure", *(f"f{i}" for i in range(len(FAMILIES))))
BUFFER = ("c", "s", "q", "m")  # count, sum, sum of squares and greatest of the weights of an event
FLAGS = ("bad_weights", "off_nominal", "without_component", "without_ratios", "with_component", "unlabelled")


def _scheme(name: str) -> Column:
    return F.coalesce(F.col("scheme") == name, F.lit(False))


def moments(rows: DataFrame, jobs: DataFrame, hit: Column, family: Column) -> DataFrame:
    """(job, scheme, stratum, band, n, flags, buffers): what one pass over the rows leaves, merged map-side.

    ``rows``: job, log_weight, failure, sampling_component, proposal_log_ratios. ``jobs``: job, scheme. Weight zero is
    -inf; a weight that is null, NaN or +inf counts as bad.
    """
    lw = F.col("log_weight")
    bad = lw.isNull() | F.isnan(lw) | (lw == F.lit(float("inf")))
    zero = lw == F.lit(float("-inf"))
    band = F.when(~bad & ~zero, F.floor(lw / BAND).cast("long"))
    w = F.when(band.isNull(), F.lit(0.0)).otherwise(F.exp(lw - band * BAND))
    known = rows.join(small_side(jobs.select("job", "scheme").distinct()), "job", "left")
    component, label = F.col("sampling_component"), family.alias("_f")
    slim = known.select(
        "job", "scheme", F.when(_scheme(MIXED), component.cast("string")).alias("stratum"), band.alias("band"), w.alias("_w"), label,
        F.coalesce(hit, F.lit(False)).alias("hit"), F.coalesce("failure", F.lit(False)).alias("failure"),
        bad.alias("bad_weights"), (~bad & (F.abs(safe_exp(lw) - 1.0) > 1e-15)).alias("off_nominal"),
        component.isNull().alias("without_component"), F.col("proposal_log_ratios").isNull().alias("without_ratios"),
        component.isNotNull().alias("with_component"),
    )
    slim = slim.withColumns({f"f{i}": F.coalesce(F.col("_f") == name, F.lit(False)) for i, name in enumerate(FAMILIES)})
    slim = slim.withColumn("unlabelled", F.col("failure") & ~F.coalesce(F.col("_f").isin(*FAMILIES), F.lit(False)))
    y = lambda e: F.when(F.col(e), F.col("_w")).otherwise(F.lit(0.0))
    buffers = [
        part
        for e in EVENTS
        for part in (F.count_if(e).alias(f"c_{e}"), F.sum(y(e)).alias(f"s_{e}"), F.sum(y(e) * y(e)).alias(f"q_{e}"), F.max(y(e)).alias(f"m_{e}"))
    ]
    flags = [F.count_if(f).alias(f) for f in FLAGS]
    return slim.groupBy("job", "scheme", "stratum", "band").agg(F.count(F.lit(1)).alias("n"), *flags, *buffers)


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(FAMILIES)) for j in range(i, len(FAMILIES))]


def replay_sums(rows: DataFrame, jobs: DataFrame, hit: Column, family: Column) -> DataFrame:
    """One row per job: merged buffers, variances of the means by scheme, strata, and the reasons against an estimate."""
    held = moments(rows, jobs, hit, family)
    top = F.max("band").over(Window.partitionBy("job"))
    scale = F.coalesce(F.exp((F.col("band") - F.col("_top")) * BAND), F.lit(0.0))
    power = {"s": scale, "m": scale, "q": scale * scale}
    one = held.withColumn("_top", top).withColumns({f"{k}_{e}": F.col(f"{k}_{e}") * x for e in EVENTS for k, x in power.items()})
    merged = lambda k: F.max if k == "m" else F.sum
    strata = one.groupBy("job", "scheme", "stratum").agg(
        F.max("_top").alias("_top"), F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in FLAGS], *[merged(k)(f"{k}_{e}").alias(f"{k}_{e}") for e in EVENTS for k in BUFFER]
    )
    n = F.col("n")

    def spread(n, sx, sy, q) -> Column:
        """Sample covariance from sums; different families never meet in one row."""
        return F.when(n > 1, (q - sx * sy / n) / (n - 1))

    within = {f"w_{e}": n * spread(n, F.col(f"s_{e}"), F.col(f"s_{e}"), F.col(f"q_{e}")) for e in ("hit", "failure")}
    cross = lambda i, j: F.col(f"q_f{i}") if i == j else F.lit(0.0)
    within |= {f"w_{i}{j}": n * spread(n, F.col(f"s_f{i}"), F.col(f"s_f{j}"), cross(i, j)) for i, j in _pairs()}
    strata = strata.withColumns(within)
    total = strata.groupBy("job", "scheme").agg(
        F.max("_top").alias("_top"), F.sum("n").alias("n"), *[F.sum(f).alias(f) for f in FLAGS],
        *[merged(k)(f"{k}_{e}").alias(f"{k}_{e}") for e in EVENTS for k in BUFFER],
        *[F.sum(c).alias(c) for c in within],
        F.count_if(n < 2).alias("short_strata"),
        F.array_sort(F.collect_list(F.when(_scheme(MIXED), F.struct("stratum", "n")))).alias("strata"),
    )
    planned = jobs.select("job", "scheme").distinct()
    lone = planned.join(total.select("job"), "job", "left_anti").select("job", "scheme", F.lit(0).cast("long").alias("n"))
    total = durable(total.unionByName(lone, allowMissingColumns=True))

    def variance(i, j, within: str, q: Column) -> Column:
        sx, sy = F.col(f"s_{i}"), F.col(f"s_{j}")
        mean = lambda s: s / n
        exact = ((mean(sx) if i == j else F.lit(0.0)) - mean(sx) * mean(sy)) / n
        return F.when(_scheme(MIXED), F.col(within) / (n * n)).when(_scheme(NOMINAL), exact).otherwise(spread(n, sx, sy, q) / n)

    columns = {f"var_{e}": variance(e, e, f"w_{e}", F.col(f"q_{e}")) for e in ("hit", "failure")}
    columns |= {f"v{i}{j}": variance(f"f{i}", f"f{j}", f"w_{i}{j}", cross(i, j)) for i, j in _pairs()}
    direct, parts = F.col("s_failure"), sum((F.col(f"s_f{i}") for i in range(1, len(FAMILIES))), F.col("s_f0"))
    whole = F.abs(parts - direct) <= 1e-12 * F.greatest(F.abs(parts), F.abs(direct))
    columns |= {"shift": F.coalesce(F.col("_top") * BAND, F.lit(0.0)), "residual": (parts - direct) / n}
    rules = {
        "no_rows": n == 0,
        "unplanned": F.col("scheme").isNull(),
        "unknown_scheme": ~F.col("scheme").isin(*FAMILY_SCHEME),
        "invalid_weight": F.col("bad_weights") > 0,
        "mixture_without_component": _scheme(MIXED) & (F.col("without_component") > 0),
        "mixture_without_ratios": _scheme(MIXED) & (F.col("without_ratios") > 0),
        "stratum_under_two_rows": _scheme(MIXED) & (F.col("short_strata") > 0),
        "component_on_iid_job": _scheme(SINGLE) & (F.col("with_component") > 0),
        "under_two_rows": (n == 1) & ~_scheme(NOMINAL),
    }
    families = {
        "weights_not_unit": _scheme(NOMINAL) & (F.col("off_nominal") > 0),
        "under_two_rows": n == 1,
        "failures_not_partitioned": F.col("unlabelled") > 0,
        "families_do_not_sum": ~whole,
    }
    told = lambda checks: F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in checks.items()]))
    out = total.withColumns(columns)
    return out.withColumns({"reasons": told(rules), "family_reasons": told(rules | families)})


MODE_FIELDS = [
    "job", "scheme", "estimator", "n", "estimate", "se", "rse", "ci_lo", "ci_hi", "events", "event_ess", "failures", "aggregate_ess",
    "max_contrib", "one_sided", "strata", "interval_method", "reason",
]


def _reason(column: str) -> Column:
    return F.when(F.size(column) > 0, F.array_join(column, ","))


def replay_modes(sums: DataFrame, level: float = LEVEL) -> DataFrame:
    """The mode estimate of every job with interval, counts, effective sizes and strata; NULL with a reason if a rule is broken.

    ``sums`` comes from ``replay_sums``. ``strata`` lists (stratum, n) of a mixture. An estimate without hits has the
    interval (0, NULL), of a mixture (NULL, NULL).
    """
    n, good = F.col("n"), F.size("reasons") == 0
    exact = _scheme(NOMINAL)
    scaled = F.col("s_hit") / n
    log_estimate = F.ln(F.when(scaled > 0, scaled)) + F.col("shift")
    estimate = F.when(exact, F.col("c_hit") / n).otherwise(F.coalesce(safe_exp(log_estimate), F.lit(0.0)))
    p = F.col("c_hit") / n
    rse = F.when(~exact & (scaled > 0), F.sqrt(F.greatest(F.lit(0.0), F.col("var_hit"))) / scaled)
    se = F.when(exact, F.sqrt(p * (1 - p) / n)).otherwise(F.coalesce(rse * estimate, F.lit(0.0)))
    half = z_two_sided(level) * rse
    ess = lambda e: F.coalesce(ratio(F.col(f"s_{e}") * F.col(f"s_{e}"), F.col(f"q_{e}")), F.lit(0.0))
    counts = {"hits_": F.when(exact & (n > 0), F.col("c_hit")).otherwise(F.lit(0)), "rows_": F.when(exact & (n > 0), n).otherwise(F.lit(1))}
    bounded = with_cp_upper(with_cp_lower(sums.withColumns(counts), "hits_", "rows_", F.lit(level / 2), "_lo"), "hits_", "rows_", F.lit(level / 2), "_hi")
    bounded = with_cp_upper(bounded, "hits_", "rows_", F.lit(level), "_one")
    only = lambda c: F.when(good, c)
    weighted_low = F.when(rse.isNotNull(), safe_exp(log_estimate - half)).when(_scheme(SINGLE), F.lit(0.0))
    out = bounded.withColumns(
        {
            "estimator": F.when(exact, "exact_binomial").when(_scheme(MIXED), "stratified").when(_scheme(SINGLE), "iid_weighted"),
            "estimate": only(estimate),
            "se": only(se),
            "rse": only(rse),
            "ci_lo": only(F.when(exact, F.col("_lo")).otherwise(weighted_low)),
            "ci_hi": only(F.when(exact, F.col("_hi")).when(rse.isNotNull(), F.least(F.lit(1.0), safe_exp(log_estimate + half)))),
            "events": F.coalesce("c_hit", F.lit(0)),
            "event_ess": only(F.when(~exact, ess("hit"))),
            "failures": F.coalesce("c_failure", F.lit(0)),
            "aggregate_ess": only(F.when(_scheme(MIXED), ess("failure"))),
            "max_contrib": only(F.when(~exact, ratio(F.col("m_hit"), F.col("s_hit")))),
            "one_sided": only(F.when(exact, F.col("_one"))),
            "interval_method": only(F.when(exact, "exact").when(_scheme(MIXED), "stratified log normal").otherwise("log normal")),
            "reason": _reason("reasons"),
        }
    )
    return out.select(*MODE_FIELDS)


def replay_family_rows(sums: DataFrame) -> DataFrame:
    """The family vector of every job under its own scheme, one row per (job, family); NULL with a reason where a rule is broken."""
    names = {"c": "c_f", "s": "s_f", "q": "q_f", "m": "m_f"}
    up = safe_exp(F.col("shift"))
    square = {"q", "v"}
    columns = {f"{k}{i}": F.col(f"{v}{i}") * (up * up if k in square else up if k != "c" else F.lit(1)) for k, v in names.items() for i in range(len(FAMILIES))}
    plain = sums.where(F.size("family_reasons") == 0).withColumns(columns)
    weighted = {f"v{i}{j}": F.col(f"v{i}{j}") * up * up for i, j in _pairs()}
    plain = plain.withColumns(weighted).withColumns({f"e{i}": F.col(f"s{i}") / F.col("n") for i in range(len(FAMILIES))})
    out = None
    for nominal in (False, True):
        some = plain.where(_scheme(NOMINAL) if nominal else ~_scheme(NOMINAL))
        vector = family_vector(some, ["job", "scheme"], NOMINAL if nominal else "stratified_is")
        out = vector if out is None else out.unionByName(vector)
    refused = sums.where(F.size("family_reasons") > 0).select(
        "job", "scheme", "n", F.explode(F.array(*[F.lit(f) for f in FAMILIES])).alias("family"), _reason("family_reasons").alias("reason")
    )
    return out.withColumn("reason", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True)
