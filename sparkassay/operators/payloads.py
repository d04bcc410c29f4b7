"""From stored JSON payloads to typed columns, flags and margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite_or_null, is_finite
from ..schemas import PAYLOAD


def decode(df: DataFrame, column: str = "payload_json") -> DataFrame:
    """Typed payload as one struct column; unused fields are pruned from the parse."""
    return df.withColumn("payload", F.from_json(column, PAYLOAD)).drop(column)


def _text_schema(paths: list[list[str]]) -> T.DataType:
    """Smallest schema that holds the given paths, with text leaves."""
    if any(not p for p in paths):
        return T.StringType()
    heads = dict.fromkeys(p[0] for p in paths)
    return T.StructType([T.StructField(h, _text_schema([p[1:] for p in paths if p[0] == h]), True) for h in heads])


def metrics(df: DataFrame, paths: dict[str, str], column: str = "payload_json") -> DataFrame:
    """Add the finite numbers at dotted paths (name -> path) from one parse; anything else is NULL.

    ``from_json`` keeps working where a document holds a bare NaN, unlike ``get_json_object``.
    """
    split = {name: path.split(".") for name, path in paths.items()}
    parsed = df.withColumn("_doc", F.from_json(column, _text_schema(list(split.values()))))
    cols = {}
    for name, parts in split.items():
        leaf = F.col("_doc")
        for p in parts:
            leaf = leaf[p]
        truth = F.when(leaf == "true", F.lit(1.0)).when(leaf == "false", F.lit(0.0))
        cols[name] = finite_or_null(truth.otherwise(leaf.try_cast("double")))
    return parsed.withColumns(cols).drop("_doc")


def flatten(features: DataFrame) -> DataFrame:
    """Trace features as the payload's four blocks. The peak average comes from the peak feature."""

    def block(name: str, **cols: str) -> Column:
        have = [
            (F.col(src) if src in features.columns else F.lit(None)).alias(out) for out, src in cols.items()
        ]
        return F.struct(*have).alias(name)

    keep = [c for c in ("episode", "ep_uid") if c in features.columns]
    return features.select(
        *keep,
        block(
            "kpi",
            aoi_avg="aoi_mean",
            aoi_peak_avg="mean_peak",
            aoi_95="aoi_p95",
            aoi_99="aoi_p99",
            aoi_100="aoi_p100",
            vel_at_min_d="ego_vel",
        ),
        block("safety_m", crash="collided", min_d="min_d"),
        block("extra", first_msg_t="first_msg_t", min_dist_t_ms="t_ms", distance_trace="distance_trace"),
        block("meta", simulator_seed="seed", simulator_episode_index="episode_index"),
    )


def unsafe(min_d: Column, d_safe: float) -> Column:
    """Unsafe unless a distance of at least ``d_safe`` was recorded; +inf counts as safe, NaN does not."""
    return ~F.coalesce((min_d >= d_safe) & ~F.isnan(min_d), F.lit(False))


def strict(min_d: Column, d_safe: float) -> list[Column]:
    """Audit form: missing or non-finite distances are malformed and unsafe."""
    ok = is_finite(min_d)
    return [
        F.when(ok, min_d).alias("min_d"),
        F.when(ok, min_d < d_safe).otherwise(F.lit(True)).alias("violation"),
        (~ok).alias("malformed"),
    ]


def margin(min_d: Column, d_safe: float) -> Column:
    return min_d - F.lit(d_safe)


__all__ = ["decode", "metrics", "flatten", "unsafe", "strict", "margin"]
