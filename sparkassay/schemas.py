"""Explicit schemas of the stored records; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _I, _S, _B = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in kinds.items()])


def episode(params: list[str]) -> T.StructType:
    """A stored episode of a design space with the given parameter columns."""
    head = fields(ep_uid=_S, ep_id=_L, sc_name=_S, gidx=_L, stamp=_L)
    tail = fields(split=_S, provenance=_S, payload_json=_S)
    return T.StructType(head.fields + [T.StructField(p, _D, True) for p in params] + tail.fields)


TRACE_POINT = fields(time_ms=_I, distance_m=_D)
PAYLOAD = fields(
    meta=fields(
        simulator_seed=_L,
        root_simulation_seed=_L,
        simulator_episode_index=_I,
        simulator_trajectory_path=_S,
        seed=_L,
        requested_seed=_L,
    ),
    kpi=fields(aoi_avg=_D, aoi_peak_avg=_D, aoi_95=_D, aoi_99=_D, aoi_100=_D, vel_at_min_d=_D),
    safety_m=fields(crash=_B, min_d=_D),
    extra=fields(first_msg_t=_L, min_dist_t_ms=_L, distance_trace=T.ArrayType(TRACE_POINT)),
    rare_event=fields(
        enabled=_B,
        seed=_S,
        simulation_seed=_L,
        log_weight=_D,
        weight=_D,
        component_log_ratio=_D,
        component_log_ratios=T.MapType(_S, _D),
        component_draw_counts=T.MapType(_S, _L),
        audit_proposal_log_ratios=T.MapType(_S, _D),
        proposal_component=_S,
        draw_count=_L,
    ),
)

CAMPAIGN_ROW = fields(
    failure=_B,
    log_weight=_D,
    first_detection_ms=_D,
    first_external_message_age_ms=_D,
    route_signature=_S,
    sampling_component=_S,
    proposal_log_ratios=T.MapType(_S, _D),
)
JOB_PLAN = fields(key=_S, scheme=_S, design=_S, episodes=_L)

_PERCEPTION = fields(t=T.ArrayType(_L), dist_to_target=T.ArrayType(_D))
_TACTICAL = fields(t=T.ArrayType(_L), aoi=T.ArrayType(_D), msg_id=T.ArrayType(_L))
_ACTOR = fields(
    data=fields(t=T.ArrayType(_L), vel=T.ArrayType(_D), acc=T.ArrayType(_D)),
    perception_data=fields(blocks=T.MapType(_S, _PERCEPTION)),
    tactical_data=fields(blocks=T.MapType(_S, _TACTICAL)),
)
TRACE_DOCUMENT = fields(
    version=_I,
    scenario=fields(t_start=_L, t_end=_L, delta_t=_D, cause=_S, name=_S),
    ego=_ACTOR,
    adv=_ACTOR,
    obps=fields(
        data=T.MapType(_S, T.ArrayType(fields(t=_L, id=_L, reg=_S, result=_S, payload=_S)))
    ),
    comm=fields(
        online=T.ArrayType(_B), dropped_packets=T.ArrayType(fields(sim_time=_L, sender=_S, id=_L))
    ),
)

FRONTIER_TABLES = {
    "baseline": fields(design_id=_L, cost=_D, heldout_r240_metric_mean=_D),
    "combined": fields(design_id=_L, cost=_D, metric=_D, source=_S, verified_safe=_B, mean_min_d=_D),
    "heldout": fields(design_id=_L, seed_ordinal=_I, paired_metric=_D, paired_min_d=_D),
    "history": fields(
        iter=_I, gidx=_L, obj_cost=_D, metric_agg=_D, obj_perf=_D, time=_D, obs_var=_D, profile=_S
    ),
    "hypervolume": fields(iter=_I, gidx=_L, hypervolume=_D, delta_hv=_D, ref_cost=_D, ref_perf=_D),
}
