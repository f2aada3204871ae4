"""Connected components by alternating large-star and small-star steps, edges as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import discard, written


def _least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least of u and all of u's neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the least node of its component, ``root``, for every node of an edge.

    ``edges`` has columns ``u`` and ``v`` of one orderable type.  A hub's edges are never
    gathered in a task: its minimum is combined before the shuffle, and the join that hands it
    back may be split.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large.where("u > v"))
        last, now = now, written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(last)
        if seen == before:
            break
        before = seen
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
