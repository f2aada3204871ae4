"""Exact quantiles of groups of any size, without holding, sorting or ranking a group.

A mergeable sketch of each group, combined before it is shuffled, brackets each rank that is asked
for between two values.  Few rows lie inside; while they are still many, they alone are sketched
again.  What stays is counted by value, and running sums of these counts give the exact value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import discard, written

#: Ranks of a sketch are true up to one in so many; brackets begin and end at so many shares.
ACCURACY, SHARES = 10_000, 500
#: Values of one group and rank that running sums are taken over at most, unless all are equal.
RANKED = 200_000


def _sketch(value: Column) -> Column:
    return F.percentile_approx(value, [i / SHARES for i in range(SHARES + 1)], ACCURACY)


def _edges(sketch: Column, rank: Column, n: Column, low: Column, high: Column) -> list[Column]:
    """New ends of a bracket for a rank, from 0, and the next one, of ``n`` values from ``low`` to ``high``."""
    slack = 2.0 / ACCURACY
    first, last = F.floor((rank / n - slack) * SHARES).cast("int"), F.ceil(((rank + 2) / n + slack) * SHARES).cast("int")
    return [F.when(first > 0, F.get(sketch, first)).otherwise(low).alias("low"), F.when(last < SHARES, F.get(sketch, last)).otherwise(high).alias("high")]


def quantiles(df: DataFrame, keys: list[str], value: str, picks: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each pick: the quantile at its share, between two values in proportion.

    Null values don't count, and a group without another has no row; a null key is a group.  Values are
    taken as doubles, NaN as the greatest.
    """
    named = [F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]
    by = [f"key{i}" for i in range(len(keys))]
    rows = df.where(F.col(value).isNotNull()).select(*named, F.col(value).cast("double").alias("v"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), _sketch(F.col("v")).alias("sketch"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("pick"), F.lit(float(share)).alias("share")) for i, share in enumerate(picks.values())]))
    place = F.col("p.share") * (F.col("n") - 1)
    ranks = whole.withColumn("p", asked).withColumns({"pick": F.col("p.pick"), "rank": F.floor(place), "part": place - F.floor(place)})
    few = F.col("n") <= RANKED
    ends = _edges(F.col("sketch"), F.col("rank"), F.col("n"), F.col("least"), F.col("most"))
    names = [*by, "pick", "rank", "part", "n", "least", "most"]
    now = written(ranks.select(*names, F.when(few, F.col("least")).otherwise(ends[0]).alias("low"), F.when(few, F.col("most")).otherwise(ends[1]).alias("high")), "brackets")
    while True:
        counts = written(_joined(rows, now, by, F.col("v") <= F.col("high")).groupBy(*names, "low", "high").agg(F.count_if(F.col("v") < F.col("low")).alias("below"), F.count_if(F.col("v") >= F.col("low")).alias("inside"), _sketch(F.when(F.col("v") >= F.col("low"), F.col("v"))).alias("sketch")), "brackets")
        held = (F.col("below") <= F.col("rank")) & (F.least(F.col("rank") + 1, F.col("n") - 1) < F.col("below") + F.col("inside"))
        wide = (F.col("inside") > RANKED) & (F.col("low") < F.col("high"))
        discard(now)
        if not counts.where(wide | ~held).limit(1).count():
            break
        inner = _edges(F.col("sketch"), F.col("rank") - F.col("below"), F.col("inside"), F.col("low"), F.col("high"))
        low = F.when(~held, F.col("least")).when(wide, inner[0]).otherwise(F.col("low"))
        high = F.when(~held, F.col("most")).when(wide, inner[1]).otherwise(F.col("high"))
        now = written(counts.select(*names, low.alias("low"), high.alias("high")), "brackets")
    inside = _joined(rows, counts.drop("sketch"), by, F.col("v").between(F.col("low"), F.col("high")))
    each = inside.groupBy(*by, "pick", "rank", "part", "below", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by, "pick").orderBy("v"))
    found = each.withColumn("upto", upto).groupBy(*by, "pick", "part").agg(F.min(F.when(F.col("upto") > F.col("rank"), F.col("v"))).alias("lower"), F.min(F.when(F.col("upto") > F.col("rank") + 1, F.col("v"))).alias("upper"))
    exact = F.when(F.col("part") == 0, F.col("lower")).otherwise(F.col("lower") + F.col("part") * (F.col("upper") - F.col("lower")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("pick") == i, exact)).alias(name) for i, name in enumerate(picks)]).select(*[F.col(b).alias(k) for b, k in zip(by, keys)], *picks)


def _joined(rows: DataFrame, brackets: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Rows with the brackets of their group: a row a group and rank, which the planner broadcasts if few."""
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(brackets[k]) for k in by], F.lit(True))
    return rows.join(brackets, same).drop(*[brackets[k] for k in by]).where(keep)


def with_quantiles(aggregates: DataFrame, df: DataFrame, keys: list[str], value: str, picks: dict[str, float]) -> DataFrame:
    """A group's other figures with its quantiles, null where it has no value."""
    found = quantiles(df, keys, value, picks)
    if not keys:
        return aggregates.join(found, F.lit(True), "left")
    same = reduce(lambda a, b: a & b, [aggregates[k].eqNullSafe(found[k]) for k in keys])
    return aggregates.join(found, same, "left").drop(*[found[k] for k in keys])
