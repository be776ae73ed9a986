"""Connected components by large-star and small-star rounds (DataFrame operations only).

Both rounds need only a minimum per node and a join on the node: the minimum is pre-aggregated before its shuffle, and
the join's skewed partitions (the star of a hot group) are split by adaptive execution. Edges stay on the cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.scratch import Scratch


def _lowest(sym: DataFrame) -> DataFrame:
    return sym.groupBy("u").agg(F.min("v").alias("mv")).select("u", F.least("u", "mv").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return sym.filter("v > u").join(_lowest(sym), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges with u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (u, v), any orderable type, no nulls; self-loops are ignored. Returns (node, root): every node that has an
    edge, with the smallest node of its component. No edges: no rows. Repeated edges count once."""
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    kept = None
    while True:
        after = scratch.keep(_small_star(_large_star(now)), "edges")
        if kept is not None:
            scratch.drop(kept)
        now = kept = after
        # Done once all edges lead to a root: no end of an edge is the start of another, and no node has two ends.
        starts = now.groupBy("u").agg(F.count("*").alias("ends"))
        if starts.join(now.select(F.col("v").alias("u"), F.lit(1).alias("low")), "u", "left").filter("ends > 1 or low = 1").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
