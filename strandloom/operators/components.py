"""Connected components by alternating large-star and small-star steps.

Every step is one aggregation for each node's smallest neighbour and one join; the
neighbours of a node are never gathered, so a hub with millions of links is only
many rows of a join that Spark can split.  The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (large: the greater ones) to its smallest neighbour."""
    seen = _both_ways(edges) if large else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = seen.join(least, "a")
    if large:
        linked = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return linked.where("a > b").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its component's smallest node) for every node with a link.

    ``edges`` has two columns of one orderable type, the ends of undirected links.
    Self links, repeated links and null ends are ignored; without links the result
    is empty, and nodes without links are absent.
    """
    a, b = edges.columns[:2]
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    now = materialize(now, "links")
    before = _sum(now)
    while before[0]:
        now = materialize(_star(materialize(_star(now, large=True), "large-star"), large=False), "small-star")
        after = _sum(now)
        if after == before:
            break
        before = after
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct())
