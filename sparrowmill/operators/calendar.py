"""Dates: month ranges, parsing by several formats, schedules, decimal years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """First days of the months from one to another, both included."""
    return spark.range(1).select(F.explode(months_between(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("month"))


def months_between(first: Column, last: Column) -> Column:
    """Days a month apart, from one to another, both included."""
    return F.sequence(first, last, F.expr("interval 1 month"))


def any_date(c: Column, formats: list[str]) -> Column:
    """The date by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in formats])


def weekly_start(day: Column, weekday: int, hour: int, minute: int) -> Column:
    """That weekday (0 Monday) and time in the week of a day."""
    return F.date_trunc("week", day) + F.make_dt_interval(F.lit(weekday), F.lit(hour), F.lit(minute))


def schedule_state(start: Column, now: Column, valid: Column) -> Column:
    return F.when(~valid, "failed").when(start < now, "skipped").otherwise("created")


def decimal_year(year: Column, month: Column, missing: int) -> Column:
    """year + (month - 1) / 12, months clamped to 1 to 12 and a missing one set."""
    return year + (F.least(F.greatest(F.coalesce(month, F.lit(missing)), F.lit(1)), F.lit(12)) - 1) / 12
