"""Connected components of links between long ids, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every node of ``links`` (a, b).

    Every round takes the smallest root among the neighbours and then the root's root, so chains shorten by half; the
    labels are stored between rounds. Both sides of every join come straight from an exchange, so a node with very
    many links is split by the skew join.
    """
    edges = durable(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    roots = durable(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")))
    while True:
        near = (
            edges.join(roots.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        closer = durable(roots.join(near, "node").select("node", "root", F.least("root", "near").alias("next")))
        above = closer.select(F.col("node").alias("next"), F.col("next").alias("top"))
        found = durable(
            closer.join(above, "next").select("node", F.least("next", "top").alias("top"), "root")
        )
        changed = not found.filter("top <> root").isEmpty()
        roots = found.select("node", F.col("top").alias("root"))
        if not changed:
            return roots
