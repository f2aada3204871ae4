"""Ranks inside groups of any size, without a task that sees a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Stretches of values that a group is cut into, about.
STRETCHES = 64


def ranked(df: DataFrame, keys: list[str], value: Column, then: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's place, from 1, in its group by a numeric value, ascending, and ``then``.

    Values are cut into stretches at quantiles of all of them, which a sketch gives; counts of the
    stretches say where each begins, and rows are ranked inside theirs.  So a group that holds most
    rows is many tasks' work, unless its values are equal.  Null values come first; a null key is a group.
    """
    rows = df.withColumn("__value", value.cast("double"))
    at = [i / STRETCHES for i in range(1, STRETCHES)]
    edges = sorted(set(rows.approxQuantile("__value", at, 1 / (4 * STRETCHES)) or []))
    held = F.array(*[F.lit(float(e)) for e in edges])
    stretch = F.when(F.col("__value").isNull(), -1).otherwise(F.size(F.filter(held, lambda e: e < F.col("__value"))) if edges else F.lit(0))
    rows = rows.withColumn("__stretch", stretch)
    counts = rows.groupBy(*keys, "__stretch").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*keys).orderBy("__stretch")  # a row a stretch
    begins = counts.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__stretch").alias("__of"), (F.sum("__n").over(upto) - F.col("__n")).alias("__before"))
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(begins[f"__key{i}"]) for i, k in enumerate(keys)], rows["__stretch"] == begins["__of"])
    inside = Window.partitionBy(*keys, "__stretch").orderBy(F.col("__value").asc_nulls_first(), *then)
    placed = rows.join(begins, same).withColumn(name, (F.col("__before") + F.row_number().over(inside)).cast("int"))
    return placed.select(*df.columns, name)
