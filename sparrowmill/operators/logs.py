"""Usage logs: price windows, quotas, rates, votes, caches and index differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def minute_of_day(ts: Column, zone: str) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return F.hour(local) * 60 + F.minute(local)


def priced(calls: DataFrame, windows: DataFrame, minute: str = "minute", model: str = "model") -> DataFrame:
    """Calls with the price window that holds their minute, [start, end), possibly past midnight.

    Windows are expanded to their minutes, at most 1,440 a model, so the range join becomes an
    equality join that the planner may broadcast or shuffle.
    """
    spans = F.when(F.col("end") > F.col("start"), F.sequence(F.col("start"), F.col("end") - 1)).otherwise(F.concat(F.sequence(F.col("start"), F.lit(1439)), F.when(F.col("end") > 0, F.sequence(F.lit(0), F.col("end") - 1)).otherwise(F.expr("cast(array() as array<int>)"))))
    each = windows.withColumn(minute, F.explode(spans)).drop("start", "end")
    return calls.join(each, [model, minute], "left")


def call_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Events of a key in the trailing window that ends at each event, both ends included.

    Time is cut into stretches of ``seconds``; an event also stands, as a guest, in the stretch after
    its own, so a stretch has all that its events look back on and a busy key is many tasks' work.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumns({"__at": at, "__own": F.floor(at / (seconds * 1_000_000))})
    dealt = rows.withColumn("__guest", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__stretch", F.col("__own") + F.col("__guest"))
    w = Window.partitionBy(key, "__stretch").orderBy("__at").rangeBetween(-seconds * 1_000_000, 0)
    return dealt.withColumn("trailing", F.count("*").over(w)).where("__guest = 0").drop("__at", "__own", "__guest", "__stretch")


def paced(df: DataFrame, key: str, ts: str, order: str, quota: int, seconds: int, stretch: int = 86_400) -> DataFrame:
    """When each request of a key may leave, and how many microseconds it has ``waited``, under a limit.

    At most ``quota`` requests leave in any ``seconds``: the i-th of a key, by time and then ``order``,
    leaves at its own time or ``seconds`` after the departure of the one ``quota`` places before it, whichever is
    later.  Taken in chains of every ``quota``-th request, that is a running maximum: request n of a chain
    leaves at n x seconds + max over its predecessors m and itself of (arrival of m - m x seconds).

    Ranks and maxima are taken inside stretches of time, then carried over between a key's stretches, of which
    there are few, so a busy key is many tasks' work.  Rows without a key or a time leave as they come.
    """
    width = seconds * 1_000_000
    rows = df.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__own", F.floor(F.col("__at") / (stretch * 1_000_000)))
    asked = rows.where(F.col(key).isNotNull() & F.col("__at").isNotNull())
    before = lambda *by: Window.partitionBy(*by).orderBy("__own").rowsBetween(Window.unboundedPreceding, -1)
    sizes = asked.groupBy(key, "__own").agg(F.count("*").alias("__n")).select(key, "__own", F.coalesce(F.sum("__n").over(before(key)), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__own").orderBy("__at", order)
    placed = asked.join(sizes, [key, "__own"]).withColumn("__i", F.col("__before") + F.row_number().over(inside) - 1)
    placed = placed.withColumn("__chain", F.col("__i") % quota).withColumn("__turn", F.expr(f"__i div {quota}")).withColumn("__lead", F.col("__at") - F.col("__turn") * width)
    tops = placed.groupBy(key, "__chain", "__own").agg(F.max("__lead").alias("__top")).select(key, "__chain", "__own", F.max("__top").over(before(key, "__chain")).alias("__prior"))
    running = F.max("__lead").over(Window.partitionBy(key, "__chain", "__own").orderBy("__turn").rowsBetween(Window.unboundedPreceding, 0))
    left = placed.join(tops, [key, "__chain", "__own"]).withColumn("__leaves", F.col("__turn") * width + F.greatest("__prior", running))
    free = rows.where(F.col(key).isNull() | F.col("__at").isNull()).withColumn("__leaves", F.col("__at"))
    both = left.select(*df.columns, "__at", "__leaves").unionByName(free.select(*df.columns, "__at", "__leaves"))
    return both.select(*df.columns, F.timestamp_micros("__leaves").alias("departs"), (F.col("__leaves") - F.col("__at")).alias("waited"))


def error_kind(message: Column, other: str = "other") -> Column:
    """The kind that a logged error begins with, as in ``quota_spent: try tomorrow``; null without an error."""
    kind = F.regexp_extract(F.trim(message), r"^([a-z][a-z_]*)\s*:", 1)
    return F.when(F.trim(message) != "", F.when(kind != "", kind).otherwise(other))


def last_vote(votes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One vote per key, the last; votes other than 1 and -1 don't count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return votes.where(F.col("vote").isin(1, -1)).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """new / updated / existing / obsolete for every key of two snapshots."""
    a, b = old.select(key, F.col(digest).alias("__old")), new.select(key, F.col(digest).alias("__new"))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "obsolete").when(F.col("__old") != F.col("__new"), "updated").otherwise("existing")
    return both.select(key, status.alias("status"))


def versions_for(hits: DataFrame, amendments: DataFrame, per_article: int, limit: int) -> DataFrame:
    """Amending fragments of the articles that hits mention: a few per article, round robin.

    ``hits`` (hit_id, articles), ``amendments`` (amendment_id, articles, rank).  Amendments that
    are hits themselves are left out; the first of every article come before the second of any.
    """
    asked = hits.select("hit_id", F.posexplode("articles").alias("place", "article"))
    offered = amendments.join(hits.select(F.col("hit_id").alias("amendment_id")).distinct(), "amendment_id", "left_anti").select("amendment_id", "rank", F.explode("articles").alias("article"))
    w = Window.partitionBy("article").orderBy("rank", "amendment_id")
    few = offered.distinct().withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_article)
    turns = asked.join(few, "article")
    once = turns.groupBy("hit_id", "amendment_id").agg(F.min(F.struct("turn", "place")).alias("first"))
    out = Window.partitionBy("hit_id").orderBy("first.turn", "first.place", "amendment_id")
    return once.withColumn("position", F.row_number().over(out)).where(F.col("position") <= limit).select("hit_id", "position", "amendment_id")


def cached(questions: DataFrame, cache: DataFrame, parts: list[str]) -> DataFrame:
    """Answers by the digest of a question's parts; only successes are in the cache."""
    key = F.sha2(F.to_json(F.struct(*parts)), 256)
    return questions.withColumn("key", key).join(cache.where("success").select("key", "answer"), "key", "left").withColumn("hit", F.col("answer").isNotNull())
