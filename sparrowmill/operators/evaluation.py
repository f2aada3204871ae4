"""Evaluation tables: ranks, thresholds, regression and classification figures, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def recall_and_mrr(ranks: DataFrame, cuts: list[int], rank: str = "rank") -> DataFrame:
    """Recall at each cut and mean reciprocal rank; a null rank is a miss."""
    r = F.col(rank)
    return ranks.agg(F.count("*").alias("n"), *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cuts], F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    """F-beta; 0 if the precision is unknown or both are 0."""
    b = beta * beta
    below = b * precision + recall
    return F.coalesce(F.when(below > 0, (1 + b) * precision * recall / below), F.lit(0.0))


def threshold_table(points: DataFrame, low: int, high: int, beta: float = 0.5) -> DataFrame:
    """Outcome counts at integer-stepped thresholds (thousandths) of (inside, similarity, hit) points.

    Points are counted by their similarity's step first, so the sweep meets a bounded number of
    counts, not the points.
    """
    step = F.floor(F.col("similarity") * 1000 + 1e-9).cast("int")  # answered at t exactly if step >= t
    counts = points.groupBy(step.alias("step"), "inside", "hit").count()
    grid = points.sparkSession.range(low, high + 1).select((F.col("id")).cast("int").alias("t"))
    both = grid.crossJoin(counts)
    answered = F.col("step") >= F.col("t")
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("long")
    table = both.groupBy("t").agg(n(answered & F.col("inside") & F.col("hit")).alias("correct"), n(answered & F.col("inside") & ~F.col("hit")).alias("wrong"), n(~answered & F.col("inside")).alias("abstained"), n(answered & ~F.col("inside")).alias("undue"))
    given = F.col("correct") + F.col("wrong") + F.col("undue")
    asked = F.col("correct") + F.col("wrong") + F.col("abstained")
    table = table.withColumn("precision", F.when(given > 0, F.col("correct") / given)).withColumn("coverage", F.when(asked > 0, F.col("correct") / asked))
    return table.withColumn("f", f_beta(F.col("precision"), F.col("coverage"), beta))


def plateau_centre(table: DataFrame) -> DataFrame:
    """The middle one of the thresholds that reach the greatest F; a table of bounded size."""
    best = table.withColumn("top", F.max("f").over(Window.partitionBy())).where("f = top")
    listed = best.groupBy("top").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return listed.select(F.get("ts", F.floor(F.size("ts") / 2).cast("int")).alias("t"), F.col("top").alias("f"))


def cautious(table: DataFrame, margin: int) -> DataFrame:
    """The greatest threshold of the best F less a margin, or the next lower one that the table has."""
    top = table.agg(F.max_by("t", F.struct("f", "t")).alias("top"))
    return table.join(top, F.col("t") <= F.col("top") - margin).agg(F.max_by(F.struct("t", "f"), "t").alias("x")).select("x.t", "x.f")


def without_undue(table: DataFrame) -> DataFrame:
    """Among thresholds without an undue answer that of the fewest abstentions, the greatest of equals."""
    return table.where("undue = 0").agg(F.min_by("t", F.struct("abstained", -F.col("t"))).alias("t"), F.min("abstained").alias("abstained"))


def sliced(ranks: DataFrame, slice_: str, cuts: list[int], rank: str = "rank") -> DataFrame:
    """:func:`recall_and_mrr` for each slice and for all rows, ``ALL``."""
    r = F.col(rank)
    figures = [F.count("*").alias("n"), *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in cuts], F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr")]
    out = ranks.rollup(slice_).agg(*figures, F.grouping(slice_).alias("__all"))
    return out.withColumn(slice_, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(slice_).cast("string"))).drop("__all")


def failures(ranks: DataFrame, k: int, rank: str = "rank") -> DataFrame:
    """Rows whose right answer isn't among the first ``k``."""
    return ranks.where(F.col(rank).isNull() | (F.col(rank) > k))


def ranges_as_text(runs: DataFrame, key: str) -> DataFrame:
    """Runs (``first``, ``last``) of a key as ``1-3, 7``."""
    one = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    held = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first", one.alias("t")))).alias("__r"))
    return held.select(key, F.array_join(F.transform("__r", lambda x: x["t"]), ", ").alias("ranges"))


def numbers_of_ranges(ranges: Column) -> Column:
    """The numbers of a text such as ``1-3, 7``; parts that aren't ranges give none."""
    each = F.filter(F.split(ranges, r"\s*,\s*"), lambda x: x.rlike(r"^\d+(-\d+)?$"))
    ends = F.transform(each, lambda x: F.split(x, "-"))
    return F.flatten(F.transform(ends, lambda e: F.sequence(e[0].cast("int"), F.element_at(e, -1).cast("int"))))


def regression_figures(df: DataFrame, real: str, predicted: str, within: list[float], edges: list[float] | None = None) -> DataFrame:
    """MAE, RMSE, R squared, bias, shares within given errors, and where ``edges`` part bands, the share
    ``same_band`` of rows whose real and predicted values lie in one, in one pass."""
    y, e = F.col(real), F.col(predicted) - F.col(real)
    band = lambda c: sum(((c >= edge).cast("int") for edge in edges or []), F.lit(0))
    same = [F.avg((band(y) == band(F.col(predicted))).cast("int")).alias("same_band")] if edges else []
    return df.agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"), F.avg(e).alias("bias"),
        *[F.avg((F.abs(e) <= w).cast("int")).alias(f"within_{w:g}") for w in within], *same)


def macro_f1(df: DataFrame, real: str, predicted: str, supported_only: bool) -> DataFrame:
    """Mean F1 over labels: all that occur on either side, or only those with support."""
    rows = df.select(F.col(real).alias("r"), F.col(predicted).alias("p")).groupBy("r", "p").count()
    side = lambda c: rows.select(F.col(c).alias("label"), F.when(F.col("r") == F.col("p"), F.col("count")).otherwise(0).alias("tp"), F.when(F.lit(c == "r"), F.col("count")).otherwise(0).alias("support"), F.when(F.lit(c == "p"), F.col("count")).otherwise(0).alias("given"))
    sums = side("r").withColumn("tp", F.col("tp")).unionByName(side("p").withColumn("tp", F.lit(0).cast("long"))).groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("given").alias("given"))
    if supported_only:
        sums = sums.where("support > 0")
    return sums.agg(F.avg(2 * F.col("tp") / (F.col("support") + F.col("given"))).alias("macro_f1"), F.count("*").alias("labels"))


def interval_union(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Islands of overlapping or touching ranges of a key.

    Equal ranges are one before they are ordered, so that no tie is open.  A range without a start
    comes last and opens no island; a key of nothing else has one without ends.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col(start) > reach, 1).otherwise(0)
    marked = df.select(key, start, end).distinct().withColumn("__open", opens).withColumn("__island", F.sum("__open").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def consecutive_runs(df: DataFrame, key: str, number: str) -> DataFrame:
    """Runs of consecutive integers of a key as ``first`` and ``last``."""
    rows = df.select(key, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number))
    return rows.withColumn("__i", island).groupBy(key, "__i").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("__i")


def interpolated(df: DataFrame, key: str, at: str, known: str, out: str) -> DataFrame:
    """As-of lookup between the nearest known points on both sides, linear, held flat outside."""
    order = Window.partitionBy(key).orderBy(at)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    place = F.when(F.col(known).isNotNull(), F.col(at))
    x0, y0 = F.last_value(place, True).over(back), F.last_value(known, True).over(back)
    x1, y1 = F.first_value(place, True).over(ahead), F.first_value(known, True).over(ahead)
    rows = df.withColumns({"__x0": x0, "__y0": y0, "__x1": x1, "__y1": y1})
    between = F.col("__y0") + (F.col("__y1") - F.col("__y0")) * (F.col(at) - F.col("__x0")) / (F.col("__x1") - F.col("__x0"))
    value = F.when(F.col("__y0").isNull(), F.col("__y1")).when(F.col("__y1").isNull() | (F.col("__x0") == F.col("__x1")), F.col("__y0")).otherwise(between)
    return rows.withColumn(out, value).drop("__x0", "__y0", "__x1", "__y1")


def side_switches(df: DataFrame, key: str, order: str, side: str) -> DataFrame:
    """How often consecutive rows of a key change sides."""
    before = F.lag(side).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__b", before).groupBy(key).agg(F.count_if(F.col("__b").isNotNull() & (F.col("__b") != F.col(side))).alias("switches"))


def multiset_accuracy(real: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Values found as often as they are real, over all real ones: micro and macro over keys."""
    a = real.groupBy(key, value).agg(F.count("*").alias("r"))
    b = found.groupBy(key, value).agg(F.count("*").alias("f"))
    hits = a.join(b, [key, value], "left").groupBy(key).agg(F.sum(F.least("r", F.coalesce("f", F.lit(0)))).alias("hits"), F.sum("r").alias("total"))
    return hits.agg((F.sum("hits") / F.sum("total")).alias("micro"), F.avg(F.col("hits") / F.col("total")).alias("macro"))
