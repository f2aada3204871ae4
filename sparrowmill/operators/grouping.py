"""Grouped tables: totals, shares, pivots, histograms and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import quantiles


def share_by_group(df: DataFrame, group: str, flag: Column, amount: str, least: int) -> DataFrame:
    """Per group: rows, flagged rows, their share, the sum of an amount; small groups left out."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"), F.sum(amount).alias("amount"))
    return out.where(F.col("n") >= least).withColumn("share", F.col("flagged") / F.col("n"))


def with_total(df: DataFrame, group: str, aggregates: list[Column], total: str = "TOTAL") -> DataFrame:
    """A table by group and its TOTAL row; a null group stays apart from the total."""
    out = df.rollup(group).agg(*aggregates, F.grouping(group).alias("__all"))
    return out.withColumn(group, F.when(F.col("__all") == 1, total).otherwise(F.col(group))).drop("__all")


def with_total_and_quantiles(df: DataFrame, group: str, aggregates: list[Column], value: str, picks: dict[str, float], total: str = "TOTAL") -> DataFrame:
    """:func:`with_total` and exact quantiles of a value, by group and of all rows."""
    of_groups = quantiles.quantiles(df, [group], value, picks)
    of_all = quantiles.quantiles(df, [], value, picks).select(F.lit(total).alias(group), *picks)
    found = of_groups.withColumn("__all", F.lit(0)).unionByName(of_all.withColumn("__all", F.lit(1)))
    out = df.rollup(group).agg(*aggregates, F.grouping(group).cast("int").alias("__all"))
    out = out.withColumn(group, F.when(F.col("__all") == 1, total).otherwise(F.col(group)))
    return out.join(found, out[group].eqNullSafe(found[group]) & (out["__all"] == found["__all"]), "left").drop(found[group], out["__all"], found["__all"])


def share_tables(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows and share of all rows by the first column, the second, and both."""
    one, two = F.col(first), F.col(second)
    sets = df.groupingSets([[one], [two], [one, two]], one, two).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return sets.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("level")))


def confusion(df: DataFrame, real: str, predicted: str, categories: list[int]) -> DataFrame:
    """Counts by real and predicted category, with empty rows and columns for absent ones."""
    spine = df.sparkSession.createDataFrame([(c,) for c in categories], f"{real} int")
    counts = df.groupBy(real).pivot(predicted, categories).count()
    out = spine.join(counts, real, "left").fillna(0)
    return out.select(real, *[F.col(str(c)).alias(f"predicted_{c}") for c in categories])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width counts of an integer column; the last bin takes the rest, empty bins show 0."""
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    ends = ends.withColumn("width", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / bins)))
    spine = ends.select("low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    place = F.least(F.floor((F.col(column) - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).count()  # one row of ends
    return spine.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("from"), F.coalesce("count", F.lit(0)).alias("n"))


def described(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Count, mean, median, 90th percentile and greatest of the non-null values."""
    c, keys = F.col(column), [group] if group else []
    rows = df.where(c.isNotNull())
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.max(c).alias("max"))
    return quantiles.with_quantiles(plain, rows, keys, column, {"median": 0.5, "p90": 0.9}).select(*keys, "n", "mean", "median", "p90", "max")


def nearest_rank(sorted_values: Column, percent: float, rule: str) -> Column:
    """A percentile of a sorted array by one of four index rules; null if it is empty.

    ``half_even`` and ``half_up`` round (n - 1) p, ``floor`` cuts n p, ``upper`` takes n / 2.
    """
    n = F.size(sorted_values)
    at = {
        "half_even": F.bround((n - 1) * F.lit(percent)).cast("int"),
        "half_up": F.floor((n - 1) * F.lit(percent) + 0.5).cast("int"),
        "floor": F.least(n - 1, F.floor(n * F.lit(percent)).cast("int")),
        "upper": F.floor(n / 2).cast("int"),
    }[rule]
    return F.get(sorted_values, at)


def ranked(df: DataFrame, group: str, value: str, picks: dict[str, tuple[float, str]]) -> DataFrame:
    """Nearest-rank percentiles of groups of any size, by the rules of :func:`nearest_rank`.

    Values are counted first; running sums over a group's distinct values then give the ranks, so
    no group is ever held as an array.  ``picks``: {name: (percent, rule)}; nulls don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(group).orderBy(value)
    sums = counts.withColumns({"__to": F.sum("__n").over(upto), "__size": F.sum("__n").over(Window.partitionBy(group))})
    n, out = F.col("__size"), []
    for name, (percent, rule) in picks.items():
        at = {"half_even": F.bround((n - 1) * F.lit(percent)), "half_up": F.floor((n - 1) * F.lit(percent) + 0.5), "floor": F.least(n - 1, F.floor(n * F.lit(percent))), "upper": F.floor(n / 2)}[rule].cast("long")
        out.append(F.max(F.when((at < F.col("__to")) & (at >= F.col("__to") - F.col("__n")), F.col(value))).alias(name))
    return sums.groupBy(group).agg(*out)


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def null_absorbing_sum(column: str) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count(column) == F.count("*"), F.sum(column))
