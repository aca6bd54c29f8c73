"""Connected components by rounds of local union-find.

The components among each partition's own links become stars: each node and
its local root. A round moves every star to the smallest root that its node or
its root knows, ties the roots that met, and deals the links by their smaller
end for the next local union-find. It ends when no node has two roots and no
root has one. Each round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_table


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node that isn't its component's smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True):
        i, j = root(i), root(j)
        if i < j:
            parent[j] = i
        elif j < i:
            parent[i] = j
    roots = np.array([root(i) for i in range(len(nodes))], np.int64)
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    return nodes[moved], nodes[roots[moved]]


def _contract(links: DataFrame) -> DataFrame:
    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            node, root = local_stars(np.concatenate([x for x, _ in got]), np.concatenate([y for _, y in got]))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60, one_task: int = 500_000) -> DataFrame:
    """node, root (the component's smallest node) for each node of the links a, b, the roots included.

    At most `one_task` links that are left after the first round are joined by
    one task, which holds some 100 bytes a link; more go through the rounds.
    """
    links = scratch_table(links, "links")  # written first, so that no task has a Python worker for the links and one for the union
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = scratch_table(_contract(ends), "components")
    if stars.count() <= one_task:
        return _with_roots(scratch_table(_contract(stars.coalesce(1)), "components"))
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(most_rounds):
        # a node with several roots, or a root that has a root itself, is still open
        roots = stars.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
        above = stars.select(F.col("b").alias("a")).distinct()
        is_open = roots.join(above.withColumn("above", F.lit(1)), "a", "left").where("low <> high or above = 1")
        if not is_open.head(1):
            break
        # a star (a, b) moves to the smallest root that a or b knows, and b is tied to both
        lowest = roots.select("a", "low")
        up = stars.join(lowest.select(F.col("a").alias("b"), F.col("low").alias("b_low")), "b", "left")
        moved = up.join(lowest, "a").select("a", "low", "b", "b_low")
        pairs = (F.col("a"), F.least("low", "b_low")), (F.col("b"), F.col("low")), (F.col("b"), F.col("b_low"))
        tied = moved.select(F.explode(F.array(*(F.struct(x.alias("a"), y.alias("b")) for x, y in pairs))).alias("s")).select("s.a", "s.b")
        tied = tied.where("b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        stars = scratch_table(_contract(tied.repartition(n, "b")), "components")
    else:
        raise RuntimeError("components did not settle")
    return _with_roots(stars)


def _with_roots(stars: DataFrame) -> DataFrame:
    own = stars.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct()
    return own.unionByName(own.select(F.col("root").alias("node"), "root").distinct())
