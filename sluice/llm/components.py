"""Connected components by alternating large-star and small-star steps, all as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sluice.tables import keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a < b. Large-star hangs every larger neighbour of a node under the node's least
    neighbour; small-star hangs the smaller ones. The minima are written before the join, so that the join's two sides
    are plain shuffles and a node with very many neighbours is split among tasks."""
    pairs = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        pairs = pairs.unionByName(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = keep(pairs.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "star")
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        out = joined.select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(
            least.select(F.col("u").alias("b"), F.col("m").alias("a"))
        )
    return out.where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs, in any order, repeats and loops allowed -> (node, component), where component is the least
    node reachable. Nodes without a link to another node have no row. Only two totals reach the driver each round."""

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = keep(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    seen = state(now)
    while True:  # the rounds grow as the square of the logarithm of the number of nodes at most
        now = keep(_star(keep(_star(now, True), "large"), False), "small")
        was, seen = seen, state(now)
        if was == seen:
            break
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
