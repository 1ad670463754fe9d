"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node of its component) for each node of ``edges`` (columns a, b: numbers).

    Each round hangs every neighbour of a node on the smallest neighbour, first the larger ones, then the smaller ones
    (large-star and small-star); the rounds grow with the logarithm of the longest path. Each round is written to the
    shared folder. A node with many neighbours is one row on one side of its joins, so its other side can be split.
    """
    stars = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct()
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("u").alias("v"), F.col("v").alias("u")))  # u is a neighbour of v
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("x"), "m").filter("x > m").select(F.col("x").alias("v"), F.col("m").alias("u"))
        stars = materialise(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "stars")
        now = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"), F.bit_xor(F.xxhash64("u", "v")).alias("y")).first()
        if now == before:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = now
