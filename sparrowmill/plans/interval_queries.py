"""Queries of bootstrap intervals by group: corpus rates, paired effects, and degradation by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import resampling
from .registry import Tables, query

REPLICATES = 100
WEIGHT = "CASE " + " ".join(f"WHEN u < {bound} THEN {k}" for k, bound in enumerate(resampling.POISSON)) + f" ELSE {len(resampling.POISSON)} END"


def intervals(rows: str, keys: str, seed: str) -> str:
    """SQL of the intervals of ``rows``: a query of the keys, ``unit``, ``num`` and ``den``."""
    return f"""
        WITH x AS ({rows}),
        d AS (SELECT *, ('0x' || substr(md5(unit::VARCHAR || '|' || (r // 4)::VARCHAR || '|{seed}'), 1 + 8 * (r % 4), 8))::BIGINT AS u FROM x, range({REPLICATES}) t(r)),
        s AS (SELECT {keys}, r, sum({WEIGHT} * num) AS num, sum({WEIGHT} * den) AS den FROM d GROUP BY {keys}, r),
        e AS (SELECT {keys}, quantile_cont(num::DOUBLE / den, 0.025) AS low, quantile_cont(num::DOUBLE / den, 0.975) AS high FROM s WHERE den <> 0 GROUP BY {keys}),
        w AS (SELECT {keys}, count(DISTINCT unit) AS n, sum(num)::DOUBLE / sum(den) AS point FROM x GROUP BY {keys})
        SELECT {keys}, n, round(point, 9) AS point, round(CASE WHEN n > 1 THEN low END, 9) AS low, round(CASE WHEN n > 1 THEN high END, 9) AS high, CASE WHEN n > 1 THEN coalesce(low > 0 OR high < 0, false) ELSE false END AS excludes_0
        FROM w LEFT JOIN e USING ({keys})"""


def shown(found: DataFrame, keys: list[str]) -> DataFrame:
    outside = F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)).alias("excludes_0")
    return found.select(*keys, "n", *[F.round(c, 9).alias(c) for c in ("point", "low", "high")], outside)


@query(intervals("SELECT l_returnflag, l_linestatus, l_orderkey AS unit, l_linenumber AS num, l_quantity::BIGINT AS den FROM lineitem", "l_returnflag, l_linestatus", "rate"))
def error_rate_intervals(t: Tables) -> DataFrame:
    """The corpus error rate of every configuration with its interval, orders drawn."""
    rows = t.lineitem.withColumn("words", F.col("l_quantity").cast("long"))
    keys = ["l_returnflag", "l_linestatus"]
    return shown(resampling.poisson_intervals(rows, keys, "l_orderkey", "l_linenumber", "words", REPLICATES, "rate"), keys)


@query(intervals("""SELECT * FROM (SELECT l_linestatus, l_suppkey AS unit, sum(l_linenumber) FILTER (l_returnflag = 'R') - sum(l_linenumber) FILTER (l_returnflag = 'A') AS num, sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R') AS den
    FROM lineitem GROUP BY ALL) WHERE num IS NOT NULL""", "l_linestatus", "pairs"))
def paired_effect_intervals(t: Tables) -> DataFrame:
    """What the second arm changes in the error rate of each model, suppliers paired and drawn."""
    rows = t.lineitem.withColumn("words", F.col("l_quantity").cast("long"))
    pairs = resampling.paired_differences(rows, "l_returnflag", "A", "R", ["l_linestatus"], "l_suppkey", "l_linenumber", "words")
    return shown(resampling.poisson_intervals(pairs, ["l_linestatus"], "l_suppkey", "delta", "size", REPLICATES, "pairs"), ["l_linestatus"])


@query(intervals("""SELECT * FROM (SELECT b.level, b.unit, b.errors - a.errors AS num, b.words AS den
    FROM (SELECT l_linenumber AS level, l_suppkey AS unit, sum(l_discount * 100)::BIGINT AS errors, sum(l_quantity::BIGINT) AS words FROM lineitem GROUP BY ALL) b
    JOIN (SELECT l_suppkey AS unit, sum(l_discount * 100)::BIGINT AS errors FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) a USING (unit) WHERE b.level <> 1)""", "level", "levels"))
def degradation_intervals(t: Tables) -> DataFrame:
    """How much every level adds to the error rate of the first, suppliers paired and drawn, with intervals."""
    rows = t.lineitem.select(F.col("l_linenumber").alias("level"), "l_suppkey", (F.col("l_discount") * 100).alias("errors"), F.col("l_quantity").cast("long").alias("words"))
    sums = rows.groupBy("level", "l_suppkey").agg(F.round(F.sum("errors")).cast("long").alias("errors"), F.sum("words").alias("words"))
    base = sums.where("level = 1").select("l_suppkey", F.col("errors").alias("base"))
    deltas = sums.where("level <> 1").join(base, "l_suppkey").withColumn("delta", F.col("errors") - F.col("base"))
    return shown(resampling.poisson_intervals(deltas, ["level"], "l_suppkey", "delta", "words", REPLICATES, "levels"), ["level"])
