"""Connected components of a graph given as a DataFrame of edges, by alternating large and small stars.

Each round hangs every vertex's larger neighbours (then its smaller ones) on its smallest neighbour; it ends when a
round changes nothing, after a number of rounds that grows with the logarithm of the longest path. Nothing but a
count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for each vertex of an edge but the components' smallest members; ids are longs."""
    now = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).where("v <> m").distinct().checkpoint()
    state = _state(now)
    while True:
        both = now.select(F.col("v").alias("u"), F.col("m").alias("w")).union(now.select("m", "v"))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("low"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(least, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).union(least.select("v", F.col("low").alias("m")))
        now = small.where("v <> m").distinct().checkpoint()
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("m").alias("component"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first()
    return tuple(row)
