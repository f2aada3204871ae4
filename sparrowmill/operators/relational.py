"""Keys, joins and windows: one row per key, flags, anti joins, interleaving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def left_joined(base: DataFrame, parts: list[tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """``base`` with aggregates of its child tables, one row per key throughout.

    Each part is (aggregate with a row per key, its count columns): counts of absent groups
    become 0, every other column of an absent group stays null.
    """
    for part, counts in parts:
        base = base.join(part, key, "left").fillna(0, counts)
    return base


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rn") -> DataFrame:
    """The first row of each key in ``order``; make the order total for a fixed result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def with_duplicate_flag(df: DataFrame, keys: list[str], flag: str = "is_duplicate") -> DataFrame:
    """Marks every row whose key occurs more than once."""
    return df.withColumn(flag, F.count("*").over(Window.partitionBy(*keys)) > 1)


def with_distinct_count(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Distinct non-null values of ``column`` over the rows of a key, beside each row."""
    return df.withColumn(name, F.size(F.collect_set(column).over(Window.partitionBy(*keys))))


def with_membership_flag(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """Whether a row's key occurs in ``other``: rows are flagged, never dropped or repeated."""
    held = other.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(held, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def null_safe_anti_join(left: DataFrame, right: DataFrame, equal: list[str], null_safe: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner; in the ``null_safe`` columns a null meets a null."""
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in equal] + [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in null_safe]
    return l.join(r, reduce(Column.__and__, on), "left_anti")


def distinct_concat(column: str, separator: str = " | ") -> Column:
    """Aggregate: sorted distinct values in one string, nulls left out."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def interleaved(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Rows numbered so that the first of each group come first, then the second of each."""
    inside = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return df.withColumn("round", inside)


def sharded(df: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """Round-robin shard numbers in a given order, without one task for all rows.

    Rows are counted per range partition, and each partition starts where the one before ends.
    """
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    inside = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = dealt.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = inside.join(F.broadcast(sizes.select("__part", "__before")), "__part")  # a row per partition
    return both.withColumn("shard", (F.col("__before") + F.col("__in") - 1) % shards).drop("__part", "__in", "__before")


def unpivoted(df: DataFrame, ids: list[str], columns: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    """Wide columns as rows."""
    return df.unpivot(ids, columns, name, value)


def matched_by_key(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float, a: str, b: str) -> DataFrame:
    """Left join with an audit: absent partners, and values apart by more than ``tolerance``."""
    both = left.join(right, keys, "left")
    return both.withColumn("missing", F.col(b).isNull()).withColumn("mismatch", F.coalesce(F.abs(F.col(a) - F.col(b)) > tolerance, F.lit(False)))
