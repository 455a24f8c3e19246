"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brainweave.llm import common


def _nearest(pairs: DataFrame) -> DataFrame:
    """(u, v) with m: the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is the smallest node of its component."""
    ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).union(pairs.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).filter("ups > 1 OR (ups > 0 AND downs > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): for every node of edges (a, b), the smallest node that it reaches.

    Each round shuffles the edges four times and writes them to the shared folder; the number of rounds grows with
    the logarithm of the longest path. No node's neighbours are ever collected.
    """
    spark = edges.sparkSession
    files = common.files_for(spark, edges.count(), 500_000, 1)
    stars = common.materialise(
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
        files,
    )
    while not _are_stars(stars):
        both = stars.union(stars.select("v", "u"))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _nearest(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        stars, old = common.materialise(small.filter("u != v").distinct(), "edges", files), stars
        common.remove(old)
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        stars.select("v", "v").distinct()
    )
