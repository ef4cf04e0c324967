"""Connected components by alternating large-star and small-star steps.

Every step is one minimum per node (combined before the shuffle) and one
join, never a list of neighbours, so a node with very many links is not
gathered anywhere.  Each round is written to the shared folder, which
cuts lineage and survives lost executors; the number of rounds follows
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges ``u`` > ``v``; the result again has ``u`` > ``v``, each once."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # Larger neighbours of a node move to the least node of its neighbourhood.
        linked = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        # Smaller neighbours of a node, and the node itself, move to the least of them.
        moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = moved.unionAll(least.select("u", F.col("m").alias("v")))
    return linked.distinct()


def component_ids(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of the undirected edges (``u``, ``v``)."""
    spark = edges.sparkSession
    edges = saved(
        spark,
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(),
        "components-edges",
    )
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")
        ).first()
        # Done when nothing moves and every node hangs on one other node.
        if tuple(state) == before and state[0] == state[2] or state[0] == 0:
            break
        before = tuple(state)
        last, edges = edges, saved(spark, star(star(edges, True), False), "components-round")
        forget(last)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
