"""Cohort retention by windows over client partitions, under several states of knowledge.

What is known of a client differs between states: a late click is missing in an early one.  A
client's start in a state is its earliest known click of a given kind; its cohort is the start's
week and a click's period counts whole weeks from the start, exact to the microsecond.

One plan of windows, without a join, gives every click the starts of all states.  A client may hold
a third of all clicks, so that no window gathers a client's clicks: they are dealt over about
sqrt(n) salts.  ``min(case when kind ...)`` is taken over (client, salt) by an aggregate that
combines map-side, and then over the client's few rows by a window, together with its segment.
Each (client, salt) gets one row with the result, which a second window hands to its clicks.
So no window holds more than about sqrt(n) rows of one client, whatever n is.  Clicks then explode
per state, and two levels of grouping, by client and by cell, count users without ``distinct``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

CLICK = ["click_id", "ts", "arrived_at", "client_id", "kind", "value", "props"]
DAY = 86_400_000_000


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    local = at.cast("timestamp_ntz")
    seconds = F.unix_date(local.cast("date")) * F.lit(86_400).cast("long") + F.hour(local) * 3600 + F.minute(local) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), local) * 1_000_000).cast("long")


def crc_of(number: Column) -> Column:
    """crc32 of a number written in decimal digits; null stays null."""
    return F.crc32(number.cast("string").cast("binary"))


def weeks(us: Column, width: int) -> Column:
    """Whole spans of ``width`` microseconds since 1970, rounded down, in integers."""
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def retention(clicks: DataFrame, clients: DataFrame, known: list[Column], kind: str = "error", days: int = 7) -> DataFrame:
    """Cells (state, segment, cohort, period) with users, users_crc32, moved and cents.

    ``known`` says for each state, 0 and up, which clicks it knows.  Clicks equal in all seven
    columns count once; those without ``ts`` or ``client_id`` don't count.  A null condition means
    that the state does not know the click.  A value that is null, or whose hundredfold isn't
    within 64 bits, counts 0.  The segment is the client's ``source``: the least one where ``clients``
    repeats an id, '' where it is null or the client is missing.  ``moved`` counts a cell's users
    whose cohorts differ between states.  Empty tables give no cells.  Other columns of both
    tables are left alone.
    """
    salts = max(1, math.isqrt(clicks.count()))
    width = days * DAY
    states = range(len(known))
    rows = clicks.select(*CLICK).where("ts is not null and client_id is not null")
    salt = F.pmod(F.xxhash64("click_id", "ts"), F.lit(salts)).alias("salt")
    at, hundredfold = micros(F.col("ts")), 100 * F.col("value") + 0.5

    def told(some: DataFrame) -> DataFrame:
        cents = F.when(F.abs(hundredfold) < 2.0**63, F.floor(hundredfold)).otherwise(0)
        return some.select("client_id", salt, "kind", at.alias("us"), cents.alias("cents"), *[F.coalesce(k, F.lit(False)).alias(f"known{s}") for s, k in enumerate(known)])

    dealt = told(rows).groupBy("client_id", "salt").agg(*[F.min(F.when(F.col(f"known{s}") & (F.col("kind") == kind), F.col("us"))).alias(f"start{s}") for s in states])
    sources = clients.where("client_id is not null and source is not null").groupBy("client_id").agg(F.min("source").alias("segment"))
    client = Window.partitionBy("client_id")
    whole = dealt.unionByName(sources, allowMissingColumns=True).select(
        "client_id", "salt", F.min("segment").over(client).alias("segment"), *[F.min(f"start{s}").over(client).alias(f"start{s}") for s in states]
    )
    starts = whole.where(F.col("salt").isNotNull() & F.coalesce(*[F.col(f"start{s}") for s in states]).isNotNull())

    part = Window.partitionBy("client_id", "salt")
    given = ["segment", *[f"start{s}" for s in states]]
    both = told(rows.distinct()).drop("kind").unionByName(starts, allowMissingColumns=True)
    placed = both.select("client_id", "us", "cents", *[f"known{s}" for s in states], *[F.max(c).over(part).alias(c) for c in given]).where("us is not null")

    cohorts = [weeks(F.col(f"start{s}"), width) for s in states]
    moved = F.greatest(*cohorts) != F.least(*cohorts) if len(cohorts) > 1 else F.lit(False)
    of_state = F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"start{s}").alias("start"), F.col(f"known{s}").alias("known")) for s in states])
    known_rows = placed.select("client_id", "us", "cents", "segment", moved.alias("moved"), F.explode(of_state).alias("in")).where("in.known and us >= in.start")
    users = (
        known_rows.groupBy(
            F.col("in.state").alias("state"), "client_id", F.coalesce("segment", F.lit("")).alias("segment"), weeks(F.col("in.start"), width).alias("cohort"), weeks(F.col("us") - F.col("in.start"), width).alias("period"), F.coalesce("moved", F.lit(False)).alias("moved")
        )
        .agg(F.sum("cents").alias("cents"))
    )
    return users.groupBy("state", "segment", "cohort", "period").agg(
        F.count("*").alias("users"), F.sum(crc_of(F.col("client_id"))).alias("users_crc32"), F.sum(F.col("moved").cast("long")).alias("moved"), F.sum("cents").alias("cents")
    )


def known_before(delay_every: int, moment: str) -> Column:
    """Whether a click had arrived before a moment, where some arrive late.

    With h the crc32 of the decimal ``click_id``, a click whose h the number divides arrives h mod 100
    days after ``arrived_at``.  A null id brings no delay; what has no ``arrived_at`` has not arrived.
    """
    h = crc_of(F.col("click_id"))
    late = F.when(h % delay_every == 0, h % 100).otherwise(0).cast("int")
    arrives = F.col("arrived_at").cast("timestamp_ntz") + F.make_dt_interval(late)
    return arrives < F.lit(moment).cast("timestamp_ntz")
