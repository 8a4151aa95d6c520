"""Connected components by alternating stars, on DataFrames.

Edges (a, b) of any ordered type; nulls and loops are ignored, repeated edges
count once. Each round lets every node's neighbours point at the least of them,
so a path shortens by a constant factor; rounds end when all are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Every neighbour below u, and u, point at the least of them."""
    joined = edges.join(_least_neighbour(edges), "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one least node, which points at none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return each.where("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node that has an edge; label is the least node of its component."""
    flat = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = settle(flat.distinct(), "edges")
    while not _settled(now):
        now = settle(_small_star(_large_star(now)), "stars")
    own = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(own)
