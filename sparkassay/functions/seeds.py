"""Deterministic, call-order-free seeds and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the domain tag of sampler seeds.
SAMPLER_DOMAIN = "simreq-sampler-v1"
UINT32_MAX = 0xFFFFFFFF


def hash_int(*parts: Column) -> Column:
    """First 32 bits of sha1 over the ``:``-joined parts, as BIGINT."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts: Column) -> Column:
    """A reproducible number strictly inside (0, 1)."""
    return (hash_int(*parts) + 0.5) / F.lit(4294967296.0)


def fresh_seed(base: Column, design: Column, scenario: Column, counter: Column) -> Column:
    return hash_int(base, design, scenario, counter)


def plan_counter(trial: Column, scenario_pos: Column, scenarios: int) -> Column:
    """Position of (trial, scenario) in the order in which a plan is laid out, from 1."""
    return trial * scenarios + scenario_pos + 1


def partitioned_seed(
    offset: int, gidx: Column, scenario_pos: Column, ordinal: Column, *, scenarios: int, repetitions: int
) -> Column:
    """Injective seed of a (design, scenario, ordinal) cell; NULL outside the declared bounds."""
    seed = F.lit(offset).cast("bigint") + (
        (gidx.cast("bigint") * scenarios + scenario_pos) * repetitions + ordinal
    )
    inside = (
        (F.lit(offset) >= 0)
        & (gidx >= 0)
        & scenario_pos.between(0, scenarios - 1)
        & ordinal.between(0, repetitions - 1)
        & (seed <= UINT32_MAX)
    )
    return F.when(inside, seed)


def sampler_seed(simulation_seed: Column, configured: Column | None = None) -> Column:
    """Lossless big-endian hex of the domain-separated seed text (wider than any SQL integer)."""
    token = F.lit("none") if configured is None else F.coalesce(configured.cast("string"), F.lit("none"))
    text = F.concat_ws(":", F.lit(SAMPLER_DOMAIN), token, simulation_seed.cast("string"))
    return F.hex(F.encode(text, "UTF-8"))


def identity_digest(*names: str) -> Column:
    """sha256 over the JSON of the named columns in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(names)])), 256)
