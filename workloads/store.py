"""Episode store operators over lineitem episodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkassay.operators import episodes as E
from sparkassay.session import scratch_path
from sparkassay.sources import episode_store, tables

from .adapters import EP_ORDER, EP_ORDER_SQL, EP_SQL, episodes, table
from .designs import CELL_SQL, SPACES
from .registry import query

COLS = ["ep_uid", "ep_id", "seq", "gidx", "part", "qty", "metric"]


@query(
    "episode_scan",
    f"""WITH {EP_SQL} SELECT ep_uid, ep_id, seq, gidx, part, qty, metric FROM ep WHERE scenario = 'F'
QUALIFY row_number() OVER (PARTITION BY ep_uid ORDER BY gidx, {EP_ORDER_SQL}) = 1""",
)
def episode_scan(spark, sf):
    df = episodes(spark, sf)
    return E.scan(df, "F", ["gidx", *EP_ORDER], "scenario").select(*COLS)


@query(
    "episode_repeats",
    f"WITH {EP_SQL} SELECT ep_uid, count(*) - 1 AS extra FROM ep GROUP BY ep_uid HAVING count(*) > 1",
)
def episode_repeats(spark, sf):
    return E.repeats(episodes(spark, sf))


@query(
    "episode_validate",
    f"""WITH {CELL_SQL} SELECT l_orderkey || '-' || l_linenumber AS ep_uid, gidx,
  CASE WHEN gidx > 4900 THEN 'outside_grid' ELSE 'params_differ' END AS rule FROM (
  SELECT * REPLACE (CASE WHEN l_partkey % 7 = 0 THEN gidx + 100 ELSE gidx END AS gidx) FROM cell) WHERE
  gidx > 4949 OR l_partkey % 7 = 0""".replace("gidx > 4900", "gidx > 4949"),
)
def episode_validate(spark, sf):
    li = table(spark, sf, "lineitem")
    cell = (F.col("l_quantity").cast("bigint") - 1) * 99 + F.round(F.col("l_discount") * 100).cast("bigint") * 9
    cell = cell + F.round(F.col("l_tax") * 100).cast("bigint")
    shifted = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ep_uid"),
        F.when(F.col("l_partkey") % 7 == 0, cell + 100).otherwise(cell).alias("gidx"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        (F.col("l_discount") * F.col("l_discount")).alias("discount_sq"),
        F.col("l_tax").alias("tax"),
    )
    return E.validate(shifted, SPACES)


@query(
    "episode_conflicts",
    f"""WITH {EP_SQL} SELECT ep_uid, count(DISTINCT (gidx, {EP_ORDER_SQL}, scenario)) AS versions,
  count(*) AS rows FROM ep GROUP BY ep_uid HAVING count(DISTINCT (gidx, {EP_ORDER_SQL}, scenario)) > 1""",
)
def episode_conflicts(spark, sf):
    return E.conflicts(episodes(spark, sf)).select("ep_uid", "versions", F.col("rows").cast("bigint").alias("rows"))


@query(
    "episode_compact",
    """WITH s AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_returnflag = 'A')
SELECT l_linestatus AS sc_name, l_suppkey AS gidx, count(*) AS episodes, round(sum(l_extendedprice), 2) AS metric_sum
FROM (SELECT DISTINCT * FROM s) GROUP BY ALL""",
)
def episode_compact(spark, sf):
    df = (
        episodes(spark, sf)
        .withColumn("ep_uid", F.sha2(F.concat_ws("|", "gidx", *[c for c in EP_ORDER], "scenario"), 256))
        .withColumnRenamed("scenario", "sc_name")
    )
    source, target = scratch_path(spark, "store"), scratch_path(spark, "compact")
    df.write.option("compression", "zstd").partitionBy("sc_name").parquet(source)
    df.where("flag = 'A'").write.mode("append").option("compression", "zstd").partitionBy("sc_name").parquet(source)
    out = episode_store.compact(spark, source, target)
    return out.groupBy("sc_name", "gidx").agg(
        F.count(F.lit(1)).alias("episodes"), F.round(F.sum("metric"), 2).alias("metric_sum")
    )


@query(
    "episode_append",
    f"""WITH {EP_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY {EP_ORDER_SQL}, gidx) AS id FROM ep WHERE scenario = 'O'),
f AS (SELECT *, row_number() OVER (ORDER BY {EP_ORDER_SQL}, gidx) + (SELECT count(*) FROM o) AS id FROM ep WHERE scenario = 'F')
SELECT scenario AS sc_name, gidx, id AS ep_id, seq, metric FROM o UNION ALL
SELECT scenario, gidx, id, seq, metric FROM f""",
)
def episode_append(spark, sf):
    path = scratch_path(spark, "store")
    df = episodes(spark, sf).drop("ep_uid").withColumnRenamed("scenario", "sc_name")
    uid_from, order = ["gidx", *EP_ORDER], [*EP_ORDER, "gidx"]
    renamed = {"ep_id": "src"}
    order = ["src" if c == "ep_id" else c for c in order]
    uid_from = ["src" if c == "ep_id" else c for c in uid_from]
    df = df.withColumnsRenamed(renamed)
    for name in ("O", "F", "F"):  # the repeated batch must add nothing
        part = df.where(F.col("sc_name") == name)
        episode_store.append(part, path, batch=f"batch-{name}", order=order, uid_from=uid_from)
    return episode_store.read(spark, path).select("sc_name", "gidx", "ep_id", "seq", "metric")


@query(
    "episode_merge_roots",
    f"""WITH {EP_SQL}, u AS (SELECT *, 0 AS root_rank FROM ep WHERE flag = 'A' UNION ALL
  SELECT *, 1 FROM ep WHERE flag <> 'N' UNION ALL SELECT *, 2 FROM ep)
SELECT ep_uid, ep_id, seq, gidx, part, qty, metric, root_rank FROM u
QUALIFY row_number() OVER (PARTITION BY ep_uid ORDER BY root_rank, {EP_ORDER_SQL}, gidx) = 1""",
)
def episode_merge_roots(spark, sf):
    df = episodes(spark, sf)
    roots = [df.where("flag = 'A'"), df.where("flag <> 'N'"), df]
    return E.merge_roots(roots, [*EP_ORDER, "gidx"]).select(*COLS, "root_rank")


CONSUMED_SQL = "used AS (SELECT DISTINCT ep_uid FROM ep WHERE disc = 0.05)"


def consumed(spark, sf):
    return episodes(spark, sf).where("disc = 0.05").select("ep_uid")


@query(
    "design_counts",
    f"""WITH {EP_SQL}, {CONSUMED_SQL} SELECT gidx, count(*) AS n,
  count(*) FILTER (WHERE ep_uid NOT IN (SELECT ep_uid FROM used)) AS n_unconsumed FROM ep GROUP BY gidx""",
)
def design_counts(spark, sf):
    return E.design_counts(episodes(spark, sf), consumed(spark, sf))


@query(
    "fifo_take",
    f"""WITH {EP_SQL}, {CONSUMED_SQL} SELECT ep_uid, ep_id, seq, gidx, part, qty, metric, n FROM (
  SELECT *, row_number() OVER (PARTITION BY gidx ORDER BY {EP_ORDER_SQL}, scenario)::INT AS n FROM ep
  WHERE ep_uid NOT IN (SELECT ep_uid FROM used)) WHERE n <= 25""",
)
def fifo_take(spark, sf):
    out = E.fifo_take(episodes(spark, sf), consumed(spark, sf), ["gidx"], [*EP_ORDER, "scenario"], 25)
    return out.select(*COLS, "n")


@query(
    "checkpoint_merge",
    """SELECT l_orderkey AS trial_index, l_linestatus AS scenario, count(*) AS rows, min(l_quantity) AS low
FROM lineitem WHERE (l_orderkey, l_linestatus) NOT IN (
  SELECT (l_orderkey, l_linestatus) FROM lineitem WHERE l_returnflag = 'A') GROUP BY ALL""",
)
def checkpoint_merge(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trial_index"), F.col("l_linestatus").alias("scenario"), "l_returnflag", "l_quantity"
    )
    keys = ["trial_index", "scenario"]
    path = scratch_path(spark, "log")
    li.where("l_returnflag = 'A'").select(*keys).distinct().write.parquet(path)
    new = li.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("l_quantity").alias("low"))
    return E.merge_log(spark.read.parquet(path), new, keys)


@query(
    "history_sink",
    """SELECT p_size::BIGINT AS gidx, round(avg(p_retailprice), 6) AS obj_perf, count(*) AS n
FROM part GROUP BY 1""",
)
def history_sink(spark, sf):
    path = scratch_path(spark, "history")
    hist = (
        table(spark, sf, "part")
        .groupBy(F.col("p_size").cast("bigint").alias("gidx"))
        .agg(F.round(F.avg("p_retailprice"), 6).alias("obj_perf"), F.count(F.lit(1)).alias("n"))
    )
    tables.write_history(hist, path)
    return spark.read.schema("gidx BIGINT, obj_perf DOUBLE, n BIGINT").option("header", True).csv(path)


@query(
    "tracker_sink",
    """SELECT l_returnflag AS mode, l_linenumber AS cycle, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def tracker_sink(spark, sf):
    path = scratch_path(spark, "tracker")
    rows = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("cycle")
    ).agg(F.count(F.lit(1)).alias("n"))
    tables.write_tracker(rows, path, by="cycle")
    return spark.read.schema("mode STRING, n BIGINT, cycle INT").parquet(path)


