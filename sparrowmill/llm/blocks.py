"""Dealing rows into blocks of ascending ``doc_id``, for operators that need the global order.

Block bounds are quantiles of the ids, which a scan of the id column alone gives; rows are then
dealt by block, so no task holds more than its blocks and no single task sorts everything.
Null ids come first, in block 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import shuffle_partitions


def bounds(docs: DataFrame, blocks: int | None = None) -> list[int]:
    """Ascending ids at which a new block begins; at most ``blocks`` - 1 of them."""
    blocks = blocks or 4 * shuffle_partitions(docs.sparkSession)
    at = [i / blocks for i in range(1, blocks)]
    found = docs.select(F.col("doc_id").cast("double").alias("id")).approxQuantile("id", at, 1 / (4 * blocks)) if at else []
    return sorted({int(x) for x in found or []})


def block_of(edges: list[int]) -> Column:
    """The block of a row: how many bounds are not above its id."""
    if not edges:
        return F.lit(0)
    held = F.array(*[F.lit(e).cast("long") for e in edges])
    return F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(held, lambda e: e <= F.col("doc_id"))))
