"""Connected components of a graph given as an edge table.

Alternating large-star and small-star steps turn every component into a star
around its least node, in about log2(size) rounds. Each step is an aggregation
with map-side combine and a join, so the many edges of a hub are never gathered
in one task; every round is staged in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.sources.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node that isn't the least of its component, from edges ``a, b``."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    stars, before = stage(pairs, "edges"), None
    while True:
        digest = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        now = stars.agg(F.count(F.lit(1)), digest).first()
        if now == before:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        stars = stage(_small_star(_large_star(stars)), "stars")
