"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.session import cut_lineage


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end of the edges has one smaller neighbour, which is no larger end itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 OR up = 1 AND n > 1").isEmpty()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: every node of an edge with the smallest node it can reach, itself included.

    Nodes must be orderable and not null; loops and repeated edges are allowed. Each round moves the
    neighbours of a node to its smallest neighbour, first the larger ones, then the smaller ones; rounds grow
    with the logarithm of the longest path, and there is none for edges that are stars around their smallest node already.
    Neighbours are never gathered into one row, the driver sees one row a round at most.
    """
    u, v = F.col(a), F.col(b)
    edges = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    edges = cut_lineage(edges)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
