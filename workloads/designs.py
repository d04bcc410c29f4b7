"""Design grids, scores and thresholds. The benchmark's designs are lineitem's (quantity, discount, tax) cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import designs as D

from .adapters import table
from .registry import query

QUANTITIES = tuple(range(1, 51))
PERCENTS = tuple(i / 100 for i in range(11))
RATES = tuple(i / 100 for i in range(9))
# quantity x (discount, its square) x tax; the middle space is a locked pair
SPACES = (
    D.discrete("quantity", *QUANTITIES),
    D.locked(("discount", "discount_sq"), *[(p, p * p) for p in PERCENTS]),
    D.discrete("tax", *RATES),
)

GRID_SQL = """q AS (SELECT unnest(range(1, 51))::BIGINT AS qv), d AS (SELECT unnest(range(0, 11))::BIGINT AS dv),
t AS (SELECT unnest(range(0, 9))::BIGINT AS tv),
grid AS (SELECT ((qv - 1) * 11 + dv) * 9 + tv AS gidx, qv::DOUBLE AS quantity, dv / 100 AS discount,
  (dv / 100) * (dv / 100) AS discount_sq, tv / 100 AS tax FROM q, d, t)"""

CELL_SQL = """cell AS (SELECT *, ((l_quantity::BIGINT - 1) * 11 + round(l_discount * 100)::BIGINT) * 9
  + round(l_tax * 100)::BIGINT AS gidx FROM lineitem)"""


def cells(spark, sf):
    """lineitem rows with the design columns, ready for a lookup."""
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        (F.col("l_discount") * F.col("l_discount")).alias("discount_sq"),
        F.col("l_tax").alias("tax"),
        F.col("l_linestatus").alias("scenario"),
        F.col("l_extendedprice").alias("metric"),
        F.col("l_partkey").alias("part"),
    )


def p_safe_rows(spark, sf):
    """Share of rows at or below 45 units per (part, scenario): a score table derived from lineitem."""
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("gidx"), F.col("l_linestatus").alias("scenario")).agg(
        (F.count_if(F.col("l_quantity") <= 45) / F.count(F.lit(1))).alias("p_safe")
    )


P_SAFE_SQL = """p AS (SELECT l_partkey AS gidx, l_linestatus AS scenario,
  count(*) FILTER (WHERE l_quantity <= 45) / count(*) AS p_safe FROM lineitem GROUP BY ALL)"""


@query(
    "grid_build",
    f"""WITH {GRID_SQL}, {CELL_SQL}, n AS (SELECT gidx, count(*) AS episodes FROM cell GROUP BY gidx)
SELECT grid.*, coalesce(episodes, 0)::BIGINT AS episodes FROM grid LEFT JOIN n USING (gidx)""",
)
def grid_build(spark, sf):
    seen = D.grid_lookup(cells(spark, sf), SPACES).groupBy("gidx").agg(F.count(F.lit(1)).alias("episodes"))
    return (
        D.grid_build(spark, SPACES)
        .join(seen, "gidx", "left")
        .withColumn("episodes", F.coalesce("episodes", F.lit(0)).cast("bigint"))
    )


@query(
    "grid_lookup",
    f"""WITH {CELL_SQL} SELECT gidx, count(*) AS n, round(sum(l_extendedprice), 2) AS metric_sum
FROM cell GROUP BY gidx""",
)
def grid_lookup(spark, sf):
    return (
        D.grid_lookup(cells(spark, sf), SPACES)
        .groupBy("gidx")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metric"), 2).alias("metric_sum"))
    )


@query(
    "grid_normalize",
    """WITH s AS (SELECT min(p_size) lo1, max(p_size) hi1, min(p_retailprice) lo2, max(p_retailprice) hi2 FROM part)
SELECT p_partkey AS gidx, round((p_size - lo1) / CASE WHEN hi1 > lo1 THEN hi1 - lo1 ELSE 1 END, 9) AS size_01,
  round((p_retailprice - lo2) / CASE WHEN hi2 > lo2 THEN hi2 - lo2 ELSE 1 END, 9) AS price_01, 0.0::DOUBLE AS one_01
FROM part, s""",
)
def grid_normalize(spark, sf):
    grid = table(spark, sf, "part").select(
        F.col("p_partkey").alias("gidx"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.lit(1.0).alias("one"),
    )
    out = D.grid_normalize(grid, ["size", "price", "one"])
    return out.select("gidx", *[F.round(c, 9).alias(c) for c in ("size_01", "price_01", "one_01")])


@query(
    "accept_threshold",
    f"""WITH {P_SAFE_SQL}, f AS (SELECT gidx, min(p_safe) AS f_min FROM p GROUP BY gidx)
SELECT gidx, round(f_min, 9) AS f_min FROM f WHERE f_min >= 0.9""",
)
def accept_threshold(spark, sf):
    hit = D.accept_threshold(D.portfolio_score(p_safe_rows(spark, sf)), 0.9)
    return hit.withColumn("f_min", F.round("f_min", 9))


@query(
    "portfolio_score",
    f"WITH {P_SAFE_SQL} SELECT gidx, round(min(p_safe), 9) AS f_min FROM p GROUP BY gidx",
)
def portfolio_score(spark, sf):
    return D.portfolio_score(p_safe_rows(spark, sf)).withColumn("f_min", F.round("f_min", 9))


@query(
    "portfolio_union_risk",
    f"""WITH {P_SAFE_SQL} SELECT gidx, round(least(1.0, greatest(0.0, sum(4 * (1 - p_safe)))), 9) AS p_viol
FROM p GROUP BY gidx""",
)
def portfolio_union_risk(spark, sf):
    risk = p_safe_rows(spark, sf).withColumn("p_viol", 4 * (1 - F.col("p_safe")))
    return D.portfolio_union_risk(risk).withColumn("p_viol", F.round("p_viol", 9))


@query(
    "score_scan",
    """WITH s AS (SELECT l_partkey AS gidx, sum(l_quantity - 25) / 100 AS p FROM lineitem GROUP BY 1),
d AS (SELECT p_partkey AS gidx FROM part WHERE p_size <= 40)
SELECT gidx, 'missing_score' AS rule FROM d WHERE gidx NOT IN (SELECT gidx FROM s)
UNION ALL SELECT gidx, 'unknown_design' FROM s WHERE gidx NOT IN (SELECT gidx FROM d)
UNION ALL SELECT gidx, 'invalid_score' FROM s WHERE p < 0 OR p > 1""",
)
def score_scan(spark, sf):
    scores = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("gidx"))
        .agg((F.sum(F.col("l_quantity") - 25) / 100).alias("p_safe"))
    )
    designs = table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("gidx"))
    return D.score_check(scores, designs)


@query(
    "accepted_equals_threshold",
    f"""WITH {P_SAFE_SQL}, f AS (SELECT gidx, min(p_safe) AS f_min FROM p GROUP BY gidx),
a AS (SELECT DISTINCT l_partkey AS gidx FROM lineitem WHERE l_quantity = 50)
SELECT gidx, 'stored_only' AS side FROM a WHERE gidx NOT IN (SELECT gidx FROM f WHERE f_min >= 0.85)
UNION ALL SELECT gidx, 'recomputed_only' FROM f WHERE f_min >= 0.85 AND gidx NOT IN (SELECT gidx FROM a)""",
)
def accepted_equals_threshold(spark, sf):
    stored = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("gidx"))
    return D.accepted_equals_threshold(stored, D.portfolio_score(p_safe_rows(spark, sf)), 0.85)


@query(
    "episode_with_design",
    f"""WITH {GRID_SQL}, {CELL_SQL} SELECT grid.gidx, quantity, discount, discount_sq, tax,
  count(*) AS n FROM cell JOIN grid USING (gidx) GROUP BY ALL""",
)
def episode_with_design(spark, sf):
    keyed = D.grid_lookup(cells(spark, sf), SPACES).select("gidx")
    return (
        D.with_design(keyed, SPACES)
        .groupBy("gidx", *D.params(SPACES))
        .agg(F.count(F.lit(1)).alias("n"))
    )
