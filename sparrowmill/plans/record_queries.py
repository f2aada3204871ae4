"""Queries of records, chunks, files, dates and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import calendar, chunking, records
from ..scratch import new_dir
from ..sources import files
from ..streaming import events as streams
from .registry import Tables, query


@query("""SELECT l_orderkey, round(sum(l_extendedprice * l_quantity::INT), 2) AS expected, round(any_value(s) - sum(l_extendedprice * l_quantity::INT), 2) AS difference,
    CASE WHEN abs(any_value(s) - sum(l_extendedprice * l_quantity::INT)) <= 0.5 THEN 'ok' ELSE 'discrepancy' END AS status
    FROM lineitem JOIN (SELECT l_orderkey AS k, sum(l_extendedprice * l_quantity::INT) + CASE WHEN l_orderkey % 3 = 0 THEN 10 ELSE 0 END AS s FROM lineitem GROUP BY l_orderkey) ON k = l_orderkey GROUP BY l_orderkey""")
def order_arithmetic(t: Tables) -> DataFrame:
    item = F.struct(F.col("l_partkey").cast("string").alias("item"), F.lit(None).cast("string").alias("size"), F.col("l_quantity").cast("int").alias("amount"), F.col("l_extendedprice").alias("price"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(item).alias("items"), F.sum(F.col("l_extendedprice") * F.col("l_quantity").cast("int")).alias("s"))
    checked = records.order_totals(F.col("items"), F.col("s") + F.when(F.col("l_orderkey") % 3 == 0, 10).otherwise(0))
    return rows.select("l_orderkey", checked.alias("c")).select("l_orderkey", F.round("c.expected", 2).alias("expected"), "c.difference", "c.status")


@query()
def semantic_chunk(t: Tables) -> DataFrame:
    return chunking.semantic(t.documents, "doc_id").select("doc_id", "position", "chunk_id", F.length("chunk").alias("n"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS source_month, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1")
def month_folders(t: Tables) -> DataFrame:
    """Orders written as CSV month folders and read back as one table of strings."""
    root = new_dir(t.spark, "months")
    rows = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("rec/orderkey"), F.col("o_totalprice").alias("rec/total"))
    rows.write.partitionBy("month").option("header", True).csv(f"{root}/raw")
    named = files.month_tables(t.spark, f"{root}/raw", "*", "rec/")
    return files.numbers(named, ["total"]).groupBy("source_month").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("amount"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 11 <> 0")
def json_log(t: Tables) -> DataFrame:
    """A JSON-lines log with damaged lines, read back without them."""
    path = new_dir(t.spark, "log")
    line = F.when(F.col("event_id") % 11 == 0, F.lit('{"event_id": 1, "user')).otherwise(F.to_json(F.struct("event_id", "user_id")))
    t.events.select(line.alias("value")).write.text(path)
    return files.json_lines(t.spark, path, t.events.select("event_id", "user_id").schema)


@query("SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'failed' WHEN date_trunc('week', ts) + INTERVAL 2 DAY + INTERVAL 18 HOUR < TIMESTAMP '2024-01-15 00:00:00' THEN 'skipped' ELSE 'created' END AS state FROM events")
def schedule_states(t: Tables) -> DataFrame:
    start = calendar.weekly_start(F.col("ts"), 2, 18, 0)
    return t.events.select("event_id", calendar.schedule_state(start, F.lit("2024-01-15").cast("timestamp"), F.col("event_id") % 17 != 0).alias("state"))


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS used FROM events GROUP BY ALL")
def streamed_daily_use(t: Tables) -> DataFrame:
    """Daily use as a stream over the event files, everything there is in one run."""
    use = streams.daily_use(streams.read(t.spark, f"{t.path}/events.parquet*", t.events))
    rows = use.select(F.struct(F.col("window.start").alias("day"), "user_id").alias("of"), "used")
    path = new_dir(t.spark, "daily-use")
    streams.upsert(rows, path, "of", "used", mode="update")
    return streams.current(t.spark, path, rows).select("of.user_id", F.date_format("of.day", "yyyy-MM-dd").alias("day"), "used")
