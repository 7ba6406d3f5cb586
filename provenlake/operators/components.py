"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialise import durable


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component, for every node that has an edge.

    ``edges``: u, v. Each step groups by node with a partial minimum and joins back, so a node with
    very many edges is never gathered in one task; the minima are written first, so that Spark can split
    a large partition of the join. Edges are written to the shared folder after each round; rounds grow
    with the logarithm of the size of the largest component, and end when all edges are stars: no node then has two smaller
    neighbours, or a smaller and a larger one.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = durable(large)
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rooted(nodes: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """nodes (with a column node) with their ``root`` after all maps (node, root), each of which names what the ones before lead to."""

    def one(found: DataFrame, roots: DataFrame) -> DataFrame:
        return found.join(roots.select(F.col("node").alias("root"), F.col("root").alias("__next")), "root", "left").withColumn("root", F.coalesce("__next", "root")).drop("__next")

    return reduce(one, maps, nodes.withColumn("root", F.col("node")))


def connected_further(maps: list[DataFrame], links: DataFrame) -> list[DataFrame]:
    """The maps and one more, after further links (a, b): only what the maps lead to is joined anew."""
    ends = rooted(rooted(links.select(F.col("a").alias("node"), "b"), maps).select(F.col("root").alias("u"), F.col("b").alias("node")), maps)
    return [*maps, durable(connected(ends.select("u", F.col("root").alias("v"))))]
