"""Connected components of a large graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitway.llm.common import checkpointed

#: Edges of a partition, at least on average: rounds over few edges have few tasks, however many partitions a shuffle has.
EDGES = 1 << 16


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    edges: columns u and v of one orderable type; direction, self-loops and repeats don't matter.
    Returns node, root. Alternating large-star and small-star rounds: each round links the neighbours
    of a node to the smallest of them, so path lengths shrink geometrically, and a minimum is
    pre-aggregated before its shuffle. Rounds end when the edge set is a set of stars. Every round is
    checkpointed; only one count a round reaches the driver.
    """
    now = checkpointed(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    most = max(1, -(-now.count() // EDGES))  # rounds never add edges
    now = now.coalesce(most)
    while True:
        # Large star: every larger neighbour of a node links to the node's smallest neighbour (or itself).
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Both minima are checkpointed before they join what they were taken of: then a join may split a node that many link to.
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(most))
        large = checkpointed(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(most))
        # Small star: the node and its smaller neighbours link to the smallest of them.
        low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(most))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(most).unionByName(low.select("u", F.col("m").alias("v")))
        after = checkpointed(small.distinct().coalesce(most))
        # A star graph has no node that is both a child and a parent, and one parent for each child.
        parents = after.groupBy("u").agg(F.count("*").alias("n"))
        inner = after.select(F.col("v").alias("u")).distinct().join(parents.select("u"), "u", "left_semi")
        if parents.where("n > 1").isEmpty() and inner.isEmpty():
            break
        now = after
    roots = after.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
