"""Roll-ups of benchmark runs: corpus rates, paired effects, pivots, contrasts, stopping rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import quantiles


def corpus_rate(df: DataFrame, keys: list[str], errors: str, total: str, name: str = "rate") -> DataFrame:
    """Errors over words of whole groups: a ratio of sums, not a mean of ratios; null without words."""
    sums = df.groupBy(*keys).agg(F.sum(errors).alias("errors"), F.sum(total).alias("total"), F.count("*").alias("items"))
    return sums.withColumn(name, F.when(F.col("total") > 0, F.col("errors") / F.col("total")))


def effect(pairs: DataFrame, keys: list[str], delta: str = "delta", tolerance: float = 0.0) -> DataFrame:
    """Paired differences by group: how many fell, rose and stayed, their mean, and a normal interval.

    ``excludes_0``: whether the interval of the mean, 1.96 standard errors to each side, lies on one
    side of 0; null with fewer than two pairs.
    """
    d = F.col(delta)
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.count_if(d < -tolerance).alias("improved"), F.count_if(d > tolerance).alias("worsened"),
        F.count_if(F.abs(d) <= tolerance).alias("equal"), F.avg(d).alias("mean"), (1.96 * F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("__half"))
    return out.withColumn("excludes_0", F.abs("mean") > F.col("__half")).drop("__half")


def against_baseline(df: DataFrame, level: str, baseline: object, keys: list[str], value: str) -> DataFrame:
    """Every level's ``delta`` to the baseline level, over the keys that both have."""
    base = df.where(F.col(level) == F.lit(baseline)).groupBy(*keys).agg(F.avg(value).alias("__base"))
    each = df.groupBy(level, *keys).agg(F.avg(value).alias("__own"))
    return each.join(base, keys).select(level, *keys, (F.col("__own") - F.col("__base")).alias("delta"))


def pivoted(df: DataFrame, rows: list[str], column: str, values: list, right: Column) -> DataFrame:
    """Right answers and answers of each row group by the values of a column, 0 where there are none."""
    out = df.groupBy(*rows).pivot(column, values).agg(F.count_if(right).alias("right"), F.count(F.lit(1)).alias("n"))
    return out.fillna(0, [c for c in out.columns if c not in rows])


def detections(df: DataFrame, keys: list[str], trap: Column, flagged: Column, diagnosis: Column) -> DataFrame:
    """Traps and clean cases by what was made of them: flagged or not, and for traps by diagnosis."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return df.groupBy(*keys).agg(
        n(trap, "traps"), n(trap & flagged, "caught"), n(trap & ~flagged, "missed"), n(trap & flagged & (diagnosis == "speaker"), "caught_rightly"), n(trap & flagged & (diagnosis == "recogniser"), "caught_wrongly"),
        n(~trap, "clean"), n(~trap & flagged, "false_alarms"), n(~trap & ~flagged, "passed"), n(flagged & diagnosis.isNull(), "undiagnosed"))


def by_field(df: DataFrame, fields: dict[str, tuple[Column, Column, Column | None]]) -> DataFrame:
    """A row for each field: cases, right ones, those without a value, accuracy, F1, mean absolute error.

    F1 is that of the right values among those given (precision) and among all cases (recall).

    ``fields``: {name: (value, whether right, absolute error or None)}; one pass over the rows.
    """
    facts = F.array(*[F.struct(F.lit(n).alias("field"), v.isNull().alias("none"), F.coalesce(r, F.lit(False)).alias("right"), (e.cast("double") if e is not None else F.lit(None).cast("double")).alias("error")) for n, (v, r, e) in fields.items()])
    each = df.select(F.explode(facts).alias("f")).select("f.*")
    return each.groupBy("field").agg(F.count("*").alias("n"), F.count_if("right").alias("right"), F.count_if("none").alias("without"), F.avg(F.col("right").cast("int")).alias("accuracy"), (2.0 * F.count_if("right") / (2 * F.count("*") - F.count_if("none"))).alias("f1"), F.avg("error").alias("mae"))


def contrasts(df: DataFrame, id_column: str, rate: str, accuracy: str) -> DataFrame:
    """Two telling cases: the worst transcript with a perfect record, and the worst record among
    transcripts no worse than the median; ties go to the smaller id."""
    middle = quantiles.quantiles(df, [], rate, {"__middle": 0.5})
    perfect = df.where(F.col(accuracy) >= 1).agg(F.min_by(id_column, F.struct(-F.col(rate), id_column)).alias(id_column)).withColumn("case", F.lit("perfect_in_spite"))
    good = df.join(middle, F.lit(True)).where(F.col(rate) <= F.col("__middle")).agg(F.min_by(id_column, F.struct(accuracy, id_column)).alias(id_column)).withColumn("case", F.lit("wrong_in_spite"))
    return perfect.unionByName(good).select("case", id_column)


def in_given_order(df: DataFrame, orders: dict[str, list], then: list[str]) -> DataFrame:
    """``place``, from 1, by the positions of columns' values in given lists; values not listed come last."""
    keys = [F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)), F.lit(0)), F.lit(len(values) + 1)) for c, values in orders.items()]
    w = Window.orderBy(*keys, *then)
    return df.withColumn("place", F.row_number().over(w))


def stopped_early(losses: DataFrame, run: str, step: str, loss: str, patience: int) -> DataFrame:
    """The step that early stopping keeps for each run: the first best one that none of the next
    ``patience`` steps betters, looking no further once so many steps have passed in vain."""
    upto = Window.partitionBy(run).orderBy(step)
    best = losses.withColumn("__best", F.min(loss).over(upto)).withColumn("__is", (F.col(loss) == F.col("__best")) & F.coalesce(F.lag("__best").over(upto) > F.col(loss), F.lit(True)))
    at = best.withColumn("__at", F.last_value(F.when(F.col("__is"), F.col(step)), True).over(upto))
    ends = at.where(F.col(step) - F.col("__at") >= patience).groupBy(run).agg(F.min(step).alias("__end"))
    seen = at.join(ends, run, "left").where(F.col("__end").isNull() | (F.col(step) <= F.col("__end")))
    return seen.groupBy(run).agg(F.max_by("__at", step).alias("kept"), F.min(loss).alias("loss"))


def outcome(answered: Column, inside: Column, right: Column) -> Column:
    """What became of a question: by whether it was answered, belonged to the domain, and was right."""
    return (
        F.when(inside & answered & right, "right_answer").when(inside & answered, "wrong_answer").when(inside, "undue_abstention")
        .when(answered, "undue_answer").otherwise("right_abstention"))


def decomposition(df: DataFrame, keys: list[str], first: str, middle: str, last: str) -> DataFrame:
    """The gap between two means as the sum of two steps: through the middle one."""
    return df.groupBy(*keys).agg(F.avg(first).alias("__a"), F.avg(middle).alias("__b"), F.avg(last).alias("__c")).select(
        *keys, (F.col("__c") - F.col("__a")).alias("total"), (F.col("__b") - F.col("__a")).alias("first_step"), (F.col("__c") - F.col("__b")).alias("second_step"))


def cause(rules: list[tuple[str, Column]], other: str = "other") -> Column:
    """The first rule that holds names the cause; an unknown rule doesn't hold."""
    return reduce(lambda out, r: F.when(F.coalesce(r[1], F.lit(False)), r[0]).otherwise(out), reversed(rules), F.lit(other))


def greedy_pairs(left: Column, right: Column, tolerance: float) -> Column:
    """How many numbers of an array find a number of another within a tolerance, each taken once, in order."""
    taken = F.aggregate(left, right, lambda rest, x: _without_first(rest, x, tolerance))
    return F.size(right) - F.size(taken)


def _without_first(rest: Column, x: Column, tolerance: float) -> Column:
    hits = F.transform(rest, lambda y: F.abs(y - x) <= tolerance)
    at = F.array_position(hits, True)
    return F.when(at > 0, F.filter(rest, lambda y, i: i != at - 1)).otherwise(rest)
