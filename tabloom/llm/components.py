"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _towards_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of numbers give (u, component): every vertex with the least of its component.

    Each step only moves edges to smaller ends, so the table never grows beyond its first size; it is
    written after each pair of steps. Loops and repeated edges are allowed."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                 "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(seen) == mark or seen[0] == 0:
            return now.groupBy("u").agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("u")).distinct().join(now.select("u").distinct(), "u", "left_anti")
                .select("u", F.col("u").alias("component")))
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = _towards_least(large, small).unionByName(small.select("u", F.col("m").alias("v")))
        now = stored(moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                     "edges")
