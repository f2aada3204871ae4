"""Deterministic splits, samples and bootstrap intervals from hashes instead of random draws."""

from __future__ import annotations

from functools import reduce
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window, functions as F


def draw(*parts: Column) -> Column:
    """A 32-bit integer from the md5 of the parts; the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def stratified_split(df: DataFrame, id_column: str, stratum: Column, seed: str, fractions: tuple[float, float], least: int) -> DataFrame:
    """train / val / test inside each stratum, in hash order; rare strata are folded together.

    Hash order inside a stratum is taken by ranking 256 hash ranges, so a stratum is never ranked
    in one task: counts of the ranges give where each begins.
    """
    key = draw(F.col(id_column), F.lit(seed))
    rows = df.select(id_column, stratum.alias("stratum")).withColumn("key", key).withColumn("range", F.shiftright("key", 24))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("size"))
    rows = rows.join(sizes, "stratum").withColumn("stratum", F.when(F.col("size") < least, "rare").otherwise(F.col("stratum"))).drop("size")
    counts = rows.groupBy("stratum", "range").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("stratum").orderBy("range")
    counts = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("size", F.sum("n").over(Window.partitionBy("stratum"))).drop("n")
    place = F.row_number().over(Window.partitionBy("stratum", "range").orderBy("key", id_column)) + F.col("before")
    placed = rows.join(counts, ["stratum", "range"]).withColumn("place", place)
    at = (F.col("place") - 1) / F.col("size")
    return placed.select(id_column, "stratum", F.when(at < fractions[0], "train").when(at < fractions[0] + fractions[1], "val").otherwise("test").alias("split"))


def sample_per_group(df: DataFrame, group: str, id_column: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each group, those of the least hashes."""
    w = Window.partitionBy(group).orderBy(draw(F.col(id_column), F.lit(seed)), id_column)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def bootstrap(items: DataFrame, replicates: int, statistic: dict[str, Column], seed: str) -> DataFrame:
    """One row a replicate: aggregates over as many draws with replacement as there are items.

    ``items`` has a dense ``item`` number from 0 and is small (aggregate to items first).
    """
    size = items.agg(F.count("*").alias("size"))
    draws = items.sparkSession.range(replicates).select(F.col("id").alias("replicate")).crossJoin(F.broadcast(size))  # one row
    draws = draws.select("replicate", "size", F.explode(F.expr("sequence(cast(0 as bigint), size - 1)")).alias("turn"))
    draws = draws.withColumn("item", draw(F.col("replicate"), F.col("turn"), F.lit(seed)) % F.col("size"))
    return draws.join(items, "item").groupBy("replicate").agg(*[c.alias(n) for n, c in statistic.items()])


def paired(df: DataFrame, arm: str, first: str, second: str, keys: list[str], value: str) -> DataFrame:
    """``delta``, second less first, of the keys that both arms have; an arm's mean per key counts."""
    side = lambda a, n: df.where(F.col(arm) == a).groupBy(*keys).agg(F.avg(value).alias(n))
    both = side(first, "__first").join(side(second, "__second"), keys)
    return both.select(*keys, F.col("__first").alias("before"), F.col("__second").alias("after"), (F.col("__second") - F.col("__first")).alias("delta"))


def interval(replicates: DataFrame, column: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return replicates.agg(F.percentile(column, low).alias("low"), F.percentile(column, high).alias("high"), F.avg((F.col(column) > 0).cast("int")).alias("share_above_0"))


#: Shares of Poisson(1), times 2**32, at which a draw's weight becomes 1, 2, 3, ...; the last are rounded up to one.
POISSON = [int(2**32 * sum(exp(-1) / factorial(j) for j in range(k + 1))) for k in range(12)]
#: Replicates whose draws one md5 gives.
DRAWS = 4


def _weight(u: Column) -> Column:
    """The weight of a 32-bit draw: how many of the bounds it has reached.

    The draw is eight small hexadecimal digits, whose order as text is that of the numbers.
    """
    out = F.lit(len(POISSON))
    for k, bound in reversed(list(enumerate(POISSON))):
        out = F.when(u < f"{bound:08x}" if bound < 1 << 32 else u.isNotNull(), k).otherwise(out)
    return out


def poisson_intervals(df: DataFrame, keys: list[str], unit: str, num: str, den: str | None = None, replicates: int = 200, seed: str = "0", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``keys``, ``n`` units, ``point`` and its interval ``low`` to ``high``: sum(num) / sum(den), or the mean without ``den``.

    One pass of a bootstrap: in each replicate a unit's rows count 0, 1, 2 ... times, a Poisson(1) weight
    from a hash of unit and replicate, so that units that several groups share move together.  A unit's rows are
    added up before anything is drawn for it.  Weighted sums
    are combined before they are shuffled: a group sends a row for every four replicates, however many
    rows it has.  Rows with a null figure don't count; a group of one unit has no interval, and replicates
    whose denominator is 0 are left out.
    """
    den_ = F.col(den) if den else F.lit(1)
    rows = df.where(F.col(num).isNotNull() & den_.isNotNull()).select(*keys, F.col(unit).alias("__unit"), F.col(num).alias("__num"), den_.alias("__den"))
    units = rows.groupBy(*keys, "__unit").agg(F.sum("__num").alias("__num"), F.sum("__den").alias("__den"))
    whole = units.groupBy(*keys).agg(F.count("__unit").alias("n"), (F.sum("__num") / F.nullif(F.sum("__den"), F.lit(0))).alias("point"))
    each = units.withColumn("__four", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // DRAWS) - 1)))).withColumn("__md5", F.md5(F.concat_ws("|", F.col("__unit").cast("string"), F.col("__four").cast("string"), F.lit(seed))))
    weighed = each.select(*keys, "__four", "__num", "__den", *[_weight(F.substring("__md5", 8 * i + 1, 8)).alias(f"__w{i}") for i in range(DRAWS)])
    sums = weighed.groupBy(*keys, "__four").agg(*[F.sum(F.col(f"__w{i}") * F.col(c)).alias(f"{c}{i}") for i in range(DRAWS) for c in ("__num", "__den")])
    of_four = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__num{i}").alias("num"), F.col(f"__den{i}").alias("den")) for i in range(DRAWS)]))
    values = sums.select(*keys, "__four", of_four.alias("r")).where((F.col("__four") * DRAWS + F.col("r.i") < replicates) & (F.col("r.den") != 0)).select(*keys, (F.col("r.num") / F.col("r.den")).alias("__value"))
    ends = values.groupBy(*keys).agg(F.percentile("__value", low).alias("low"), F.percentile("__value", high).alias("high"))  # of the replicates
    same = reduce(lambda a, b: a & b, [whole[k].eqNullSafe(ends[k]) for k in keys], F.lit(True))
    both = whole.join(ends, same, "left").drop(*[ends[k] for k in keys])
    return both.select(*keys, "n", "point", *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("low", "high")])


def paired_differences(df: DataFrame, arm: str, first, second, keys: list[str], unit: str, errors: str, size: str) -> DataFrame:
    """``keys``, unit, ``delta`` (errors of the second arm less the first's) and the second arm's ``size``, where both arms have the unit."""
    pick = lambda a, c: F.sum(F.when(F.col(arm) == F.lit(a), F.col(c)))
    sums = df.where(F.col(arm).isin(first, second)).groupBy(*keys, unit).agg(pick(first, errors).alias("__a"), pick(second, errors).alias("__b"), pick(second, size).alias("size"))
    return sums.where("__a is not null and __b is not null").select(*keys, unit, (F.col("__b") - F.col("__a")).alias("delta"), "size")
