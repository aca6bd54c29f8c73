"""Connected components by alternating large-star and small-star, in DataFrame operations.

Large-star ties every larger neighbour of a node to the smallest of the node
and its neighbours; small-star ties a node and its smaller neighbours to the
smallest of these. Both keep what is connected, and where neither changes
anything each component is a star around its smallest node. A node's minimum
is a plain aggregate, combined before the shuffle, and the joins may be split
where a node has very many links, so no task gathers a node's neighbours.
Each round is written to the shared folder.

Defined cases: links of a node to itself and null ends are left out; repeated
links count once; no links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table


def large_star(edges: DataFrame) -> DataFrame:
    """u, v (u > v) of u, v in any order."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u, v (u > v) of u, v with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def alternating(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """u, v: each node of the links a, b (long) that isn't its component's smallest, and that smallest."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = scratch_table(edges, "stars"), None
    for _ in range(most_rounds):
        # equal counts and equal sums of 64-bit hashes: nothing has changed
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before or not now.n:
            return edges
        before, edges = now, scratch_table(small_star(large_star(edges)), "stars")
    raise RuntimeError("components did not settle")
