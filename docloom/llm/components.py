"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Each step is an aggregation with partial sums (the least neighbour of a node) and an equi join back to the edges, which
AQE can split where one node has very many edges; nothing is gathered in one task or on the driver. Steps repeat until
all components are stars, O(log^2 n) rounds at worst; each round is checkpointed, so lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """For every node, its larger neighbours go to the least node among it and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """For every node, it and its smaller neighbours go to the least of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u > v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Does every node but the roots have one edge, to a root? A node's edges are counted with partial sums, without a join."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) of any comparable type, u != v. Returns (u, v): every node but the least of its component, and that."""
    edges = checkpointed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    while not _stars(edges):
        edges = checkpointed(_small_star(_large_star(edges)))
    return edges
