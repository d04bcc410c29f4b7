"""Table-driven design costs. Premium tables are configuration (a few dozen entries) and become map
literals, so a cost is a projection over the designs without any join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Component:
    id: str
    subsystem: str
    keys: tuple[str, ...]
    transform: str  # identity, absolute or tuple
    premiums: tuple[tuple[tuple[float, ...], float], ...]


@dataclass(frozen=True)
class Profile:
    id: str
    subsystems: dict[str, float]
    components: dict[str, float] = field(default_factory=dict)

    def factor(self, c: Component) -> float:
        return self.subsystems[c.subsystem] * self.components.get(c.id, 1.0)


@dataclass(frozen=True)
class CostModel:
    base: float
    components: tuple[Component, ...]
    profiles: dict[str, Profile]
    ratio_bound: float
    hv_multiplier: float
    hv_performance: float


def cost_profile_load(doc: dict) -> CostModel:
    """Cost configuration document -> lookup tables; dots in parameter names become underscores.

    Each value must have exactly one premium.
    """
    comps = []
    for c in doc["components"]:
        if c["transform"] == "tuple":
            rows = [(tuple(map(float, r["values"])), float(r["premium"])) for r in c["premiums"]]
        else:
            rows = [((float(k),), float(v)) for k, v in c["premiums"].items()]
        if len({k for k, _ in rows}) != len(rows):
            raise ValueError(f"component {c['id']}: a value has two premiums")
        names = tuple(k.replace(".", "_") for k in c["keys"])
        comps.append(Component(c["id"], c["subsystem"], names, c["transform"], tuple(rows)))
    profiles = {
        name: Profile(name, dict(p["subsystem_multipliers"]), dict(p.get("component_multipliers", {})))
        for name, p in doc["profiles"].items()
    }
    policy = doc["hypervolume_policy"]
    return CostModel(
        float(doc["base_cost"]),
        tuple(comps),
        profiles,
        float(doc["bounds"]["maximum_total_to_base_ratio"]),
        float(policy["cost_reference"]["multiplier"]),
        float(policy["performance_reference"]),
    )


def premium(c: Component) -> Column:
    """Premium of the design's value; NULL when the table has none."""
    vals = [F.col(k).cast("double") + F.lit(0.0) for k in c.keys]  # + 0.0 folds the negative zero
    if c.transform == "absolute":
        vals = [F.abs(vals[0])]
    if len(vals) == 1:
        table = F.create_map(*[F.lit(x) for (k,), p in c.premiums for x in (k + 0.0, p)])
        return table[vals[0]]
    out = F.lit(None).cast("double")
    for choice, p in c.premiums:
        hit = F.lit(True)
        for v, want in zip(vals, choice):
            hit = hit & (v == want)
        out = F.when(hit, F.lit(p)).otherwise(out)
    return out


def cost_components(designs: DataFrame, model: CostModel, profile: str) -> DataFrame:
    """Long form (gidx, component, cost); cost is NULL where the value has no premium."""
    p = model.profiles[profile]
    cells = [
        F.struct(F.lit(c.id).alias("component"), (premium(c) * p.factor(c)).alias("cost")) for c in model.components
    ]
    return designs.select("gidx", F.explode(F.array(*cells)).alias("c")).select("gidx", "c.*")


def missing_premiums(designs: DataFrame, model: CostModel) -> DataFrame:
    """(gidx, component) pairs without a premium."""
    gaps = F.filter(
        F.array(*[F.when(premium(c).isNull(), F.lit(c.id)) for c in model.components]), lambda x: x.isNotNull()
    )
    return designs.select("gidx", F.explode(gaps).alias("component"))


def total_cost(model: CostModel, profile: str) -> Column:
    p = model.profiles[profile]
    out = F.lit(model.base)
    for c in model.components:
        out = out + premium(c) * p.factor(c)
    return out


def design_cost(designs: DataFrame, model: CostModel, profiles: list[str] | None = None) -> DataFrame:
    """(gidx, profile, cost) of every design under every profile."""
    names = profiles or sorted(model.profiles)
    cells = [F.struct(F.lit(n).alias("profile"), total_cost(model, n).alias("cost")) for n in names]
    return designs.select("gidx", F.explode(F.array(*cells)).alias("c")).select("gidx", "c.*")


def cost_manifest(costs: DataFrame, model: CostModel) -> DataFrame:
    out = costs.groupBy("profile").agg(F.min("cost").alias("cost_min"), F.max("cost").alias("cost_max"))
    return out.withColumn("ratio_ok", F.col("cost_max") / model.base <= model.ratio_bound)


def hv_reference(costs: DataFrame, candidates: DataFrame, model: CostModel) -> DataFrame:
    """Reference point per profile over the candidate set; ``valid`` when it is worse than all of them."""
    used = costs.join(candidates.select("gidx"), "gidx", "left_semi")
    out = used.groupBy("profile").agg(F.max("cost").alias("cost_max"), F.count(F.lit(1)).alias("candidates"))
    ref = F.ceil(F.col("cost_max") * model.hv_multiplier).cast("double")
    return out.select(
        "profile",
        "candidates",
        ref.alias("ref_cost"),
        F.lit(model.hv_performance).alias("ref_perf"),
        (ref > F.col("cost_max")).alias("valid"),
    )
