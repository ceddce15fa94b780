"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, both with map-side combining, so a hub of any degree
is pre-aggregated; rounds grow with the logarithm of the longest path. Edges stay distributed:
only a row count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versicle.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these. ``u > v`` holds here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    across = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """``node, component`` for every end of an edge; the component is its smallest node.

    Self-loops, repeated and reversed edges change nothing (a node with only a self-loop has
    no row); null ends are dropped.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    edges = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = cut(edges), None
    while (now := _checksum(edges)) != seen and now[0]:
        seen = now
        edges = cut(_small_star(_large_star(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
