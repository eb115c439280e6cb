"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.sources.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that the edges (a, b) reach, for every node of an edge.

    Each round is two aggregates and two joins over the remaining edges, written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. A node with many edges
    is spread over the join's tasks by adaptive skew handling and summed before its shuffle.
    Edges from a node to itself, repeated edges and an empty table are fine.
    """
    now = stored(edges.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while True:
        # Large star: what is larger than a node moves to the smallest node around it.
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the smaller ones around a node move to the smallest of them, as the node does.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least).distinct())
        after = stored(small, "edges")
        before, seen = seen, _digest(after)
        if before == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                after.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        now = after


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
