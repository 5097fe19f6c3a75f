"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import materialize


def _least(both: DataFrame) -> DataFrame:
    """Least neighbour of each node, itself included."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of `edges` (u, v); root is the least node that it reaches.

    Each round hangs the greater neighbours of every node under its least neighbour (large star) and
    then the smaller ones (small star), until nothing changes: a number of rounds that grows with
    the logarithm of the size. Neighbour lists are never gathered; only minima and joins are used.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == sign:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        sign = seen
