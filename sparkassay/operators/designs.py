"""Design grids: a finite parameter space whose row position is the key of every other table."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import is_finite


@dataclass(frozen=True)
class Space:
    """One dimension: ``choices`` are tuples whose members (named by ``fields``) move together."""

    fields: tuple[str, ...]
    choices: tuple[tuple[float, ...], ...]


def discrete(name: str, *values: float) -> Space:
    return Space((name,), tuple((float(v),) for v in values))


def locked(fields: tuple[str, ...], *choices: tuple[float, ...]) -> Space:
    return Space(tuple(fields), tuple(tuple(float(v) for v in c) for c in choices))


# The published design space, in its declared order (the last space varies fastest).
DESIGN_SPACE = (
    discrete("prob", 0.75, 0.975),
    discrete("gen_t", 20, 50, 100),
    discrete("fault", 0, 200, 500, 1000, 2000),
    discrete("unc_p", -1.0, -0.5, -0.2, 0.0, 0.2, 0.5, 1.0),
    discrete("unc_v", -2.0, -1.5, -1.0, -0.5, -0.2, 0.0, 0.2, 0.5, 1.0, 1.5, 2.0),
    discrete("ego_ad_period", 10, 50),
    discrete("packet_drop_rate", 0.01, 0.001),
    locked(
        ("network_delay_min", "network_delay_avg", "network_jit"),
        (20.0, 25.0, 10.0),
        (40.0, 55.0, 50.0),
        (50.0, 100.0, 100.0),
    ),
)


def grid_size(spaces) -> int:
    return prod(len(s.choices) for s in spaces)


def params(spaces) -> list[str]:
    return [f for s in spaces for f in s.fields]


def strides(spaces) -> list[int]:
    out, step = [], 1
    for s in reversed(spaces):
        out.append(step)
        step *= len(s.choices)
    return out[::-1]


def decode(gidx: Column, spaces) -> list[Column]:
    """Parameter columns of a grid position by mixed-radix arithmetic; NULL outside the grid."""
    cols = []
    inside = gidx.between(0, grid_size(spaces) - 1)
    for s, step in zip(spaces, strides(spaces)):
        digit = F.when(inside, F.floor(gidx / step) % len(s.choices)).cast("int")
        for j, name in enumerate(s.fields):
            values = F.array(*[F.lit(c[j]) for c in s.choices])
            cols.append(F.get(values, digit).alias(name))
    return cols


def encode(spaces, digits: int = 8) -> Column:
    """Grid position of parameter columns (compared after rounding); NULL if no design matches."""
    total = F.lit(0).cast("bigint")
    for s, step in zip(spaces, strides(spaces)):
        key = [F.round(F.col(f), digits) for f in s.fields]
        choices = [[F.lit(round(v, digits)) for v in c] for c in s.choices]
        if len(s.fields) == 1:
            pos = F.array_position(F.array(*[c[0] for c in choices]), key[0])
        else:
            pos = F.array_position(F.array(*[F.array(*c) for c in choices]), F.array(*key))
        total = total + F.when(pos > 0, pos - 1) * step
    return total


def grid_build(spark: SparkSession, spaces) -> DataFrame:
    """The whole grid; each task decodes its own range of positions, no join and no shuffle."""
    return spark.range(grid_size(spaces)).select(F.col("id").alias("gidx"), *decode(F.col("id"), spaces))


def with_design(rows: DataFrame, spaces) -> DataFrame:
    """Rows with the parameters of their design; rows outside the grid are left out."""
    return rows.where(F.col("gidx").between(0, grid_size(spaces) - 1)).select("*", *decode(F.col("gidx"), spaces))


def grid_lookup(rows: DataFrame, spaces) -> DataFrame:
    return rows.withColumn("gidx", encode(spaces))


def grid_normalize(grid: DataFrame, names: list[str]) -> DataFrame:
    """Min-max per column over the whole table; a constant column has span 1."""
    stats = grid.agg(
        F.struct(*[F.min(n).alias(f"lo_{n}") for n in names], *[F.max(n).alias(f"hi_{n}") for n in names]).alias("s")
    ).scalar()
    out = []
    for n in names:
        lo, hi = stats[f"lo_{n}"], stats[f"hi_{n}"]
        span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        out.append(((F.col(n) - lo) / span).alias(f"{n}_01"))
    return grid.select("gidx", *out)


def accept_threshold(scores: DataFrame, tau: float, score: str = "f_min") -> DataFrame:
    """Designs whose score reaches tau; the filter is a plain comparison that Parquet can skip on.

    Callers that need a non-empty set check it with ``DataFrame.isEmpty``.
    """
    return scores.where((F.col(score) >= tau) & ~F.isnan(score)).select("gidx", score)


def portfolio_score(p_safe: DataFrame) -> DataFrame:
    """Worst scenario decides."""
    return p_safe.groupBy("gidx").agg(F.min("p_safe").alias("f_min"))


def portfolio_union_risk(p_viol: DataFrame) -> DataFrame:
    """Union bound over scenarios, clipped to [0, 1]."""
    return p_viol.groupBy("gidx").agg(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sum("p_viol"))).alias("p_viol")
    )


def score_check(scores: DataFrame, designs: DataFrame, score: str = "p_safe") -> DataFrame:
    """Rows that break "one finite score in [0, 1] per design": (gidx, rule)."""
    per = scores.groupBy("gidx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~(is_finite(F.col(score)) & F.col(score).between(0, 1))).alias("bad"),
    )
    d = designs.select(F.col("gidx").alias("_g"))
    joined = d.join(per, d["_g"] == per["gidx"], "full")
    rules = F.filter(
        F.array(
            F.when(F.col("gidx").isNull(), F.lit("missing_score")),
            F.when(F.col("_g").isNull(), F.lit("unknown_design")),
            F.when(F.col("n") > 1, F.lit("repeated_score")),
            F.when(F.col("bad") > 0, F.lit("invalid_score")),
        ),
        lambda r: r.isNotNull(),
    )
    return joined.select(F.coalesce("_g", "gidx").alias("gidx"), F.explode(rules).alias("rule"))


def accepted_equals_threshold(accepted: DataFrame, scores: DataFrame, tau: float) -> DataFrame:
    """Symmetric difference between a stored set and the recomputed one: (gidx, side)."""
    again = accept_threshold(scores, tau).select(F.col("gidx").alias("_r"))
    both = accepted.select("gidx").distinct().join(again, F.col("gidx") == F.col("_r"), "full")
    return both.where(F.col("gidx").isNull() | F.col("_r").isNull()).select(
        F.coalesce("gidx", "_r").alias("gidx"),
        F.when(F.col("_r").isNull(), F.lit("stored_only")).otherwise(F.lit("recomputed_only")).alias("side"),
    )
