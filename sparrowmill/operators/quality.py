"""A declarative engine of data-quality rules that flags rows and drops none."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import written


@dataclass(frozen=True)
class Rule:
    """A rule's name, flag column, SQL predicate, and what its rows are called in the report."""

    name: str
    flag: str
    predicate: str
    unit: str


def flagged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """A boolean column for each rule (an unknown predicate is false) and their number, ``n_flags``."""
    df = df.withColumns({r.flag: F.coalesce(F.expr(r.predicate), F.lit(False)) for r in rules})
    return df.withColumn("n_flags", reduce(Column.__add__, [F.col(r.flag).cast("int") for r in rules]))


def report(df: DataFrame, rules: list[Rule], key: str, examples: int) -> DataFrame:
    """A row for each rule, marked, total, share, and the least keys as examples.

    Rows are flagged once, into a table of keys and the numbers of their rules; only marked ones become
    rows of their own.  They are ranked in 64 parts of each rule, of which the first few go on, so no task
    gets all keys of a rule.  A table without rows has no report.
    """
    numbers = F.array_compact(F.array(*[F.when(F.col(r.flag), i) for i, r in enumerate(rules)]))
    marks = written(df.select(F.col(key).alias("__key"), numbers.alias("__rules")), "marks")
    total = marks.agg(F.count("*").alias("total")).where("total > 0")
    each = marks.select("__key", F.explode("__rules").alias("__rule"))
    counts = each.groupBy("__rule").agg(F.count("*").alias("marked"))
    inside = Window.partitionBy("__rule", F.pmod(F.xxhash64("__key"), F.lit(64))).orderBy("__key")
    few = each.withColumn("__n", F.row_number().over(inside)).where(F.col("__n") <= examples)
    least = few.groupBy("__rule").agg(F.slice(F.array_sort(F.collect_list("__key")), 1, examples).alias("least"))
    names = df.sparkSession.createDataFrame([(i, r.name, r.unit) for i, r in enumerate(rules)], "__rule int, rule string, unit string")
    out = names.join(total, F.lit(True)).join(counts, "__rule", "left").join(least, "__rule", "left")
    marked = F.coalesce("marked", F.lit(0).cast("long"))
    return out.select("rule", "unit", marked.alias("marked"), "total", (marked / F.col("total")).alias("share"), F.array_join("least", ", ").alias("examples"))


def errors(checks: list[tuple[str, Column]]) -> Column:
    """The names of the checks that a row fails."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks]))


def looked_up(df: DataFrame, dimension: DataFrame, key: str, value: str, fields: list[tuple[str, str]], out: str, method: str) -> DataFrame:
    """The dimension's value for the first field that hits, and which field it was.

    ``dimension`` is a lookup table; its join is left to the planner, which broadcasts it by size.
    """
    for i, (field, _) in enumerate(fields):
        part = dimension.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        df = df.join(part, F.col(field) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    hits = [F.when(F.col(f"__v{i}").isNotNull(), F.lit(name)) for i, (_, name) in enumerate(fields)]
    df = df.withColumn(out, F.coalesce(*[F.col(f"__v{i}") for i in range(len(fields))])).withColumn(method, F.coalesce(*hits))
    return df.drop(*[f"__v{i}" for i in range(len(fields))])


def band(x: Column) -> Column:
    """Bands of a continuous value by its floor."""
    whole = F.floor(x)
    return F.when(whole <= 2, "0-2").when(whole <= 5, "3-5").when(whole <= 10, "6-10").when(whole.isNotNull(), "11+")
