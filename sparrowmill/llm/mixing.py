"""Mixing sources to target weights by entropy balancing.

Among all document rates between 0 and 3 whose expected words meet each source's target, the ones
of least relative entropy to one copy each are ``min(3, exp(lambda * size / mean size))``, with a
multiplier lambda for each source.  The multipliers solve the convex dual: each Newton iteration
is one distributed sum over all documents, which a table of (source, size) counts gives exactly.
Rates are then rounded into whole copies.  From the largest sizes of a source to the smallest,
what rounding has left over is carried on, so a source ends within half a small document of its
target; inside a size, a hash of the id chooses who gets the odd copies.

DataFrame functions only; no step gathers documents in a task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import discard, shuffle_partitions, written

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
#: A target is met if its relative error is below this, or its multiplier can't be told from its bounds.
TOLERANCE, CLOSE = 1e-9, 1e-14
#: Sizes that are rounded one after another at most.
RUN = 512
#: Documents of a size are dealt into so many parts, so that no size is ranked in one task.
PARTS = 64


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, a non-null source key and the number of words of each row."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))  # nulls last
    return docs.select(F.col("doc_id"), key.alias("source"), words.alias("size"))


def numbered(sources: DataFrame) -> DataFrame:
    """``number`` of each source, from 0, in the order of code points.

    Sources are dealt by ranges and counted; only a row for each range meets in one task, so a
    source for each of very many hosts is no one task's work.
    """
    tasks = shuffle_partitions(sources.sparkSession)
    dealt = written(sources.repartitionByRange(tasks, "source").withColumn("__part", F.spark_partition_id()), "sources")
    ranges = dealt.groupBy("__part").agg(F.count("*").alias("__held"))
    ranges = ranges.withColumn("__before", F.sum("__held").over(Window.orderBy("__part")) - F.col("__held"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("source")) - 1
    return dealt.withColumn("__in", inside).join(ranges, "__part").withColumn("number", F.col("__before") + F.col("__in")).drop("__part", "__held", "__before", "__in")


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to a row for each source (``source``, ``source_size``).

    Weights 1, 2, 3 repeat in the order of code points and share the sum of all sizes; a target
    stops at three times its source's size, and the rest share the excess by weight.  Each turn
    raises the share of a weight by what the stopped sources leave, until none more stops.
    """
    rows = numbered(sources).withColumn("weight", (F.col("number") % 3 + 1).cast("double"))
    rows = written(rows.withColumn("cap", MOST_COPIES * F.col("source_size").cast("double")), "weights")
    level, stopped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        r = rows.agg(F.sum(F.col("source_size").cast("double")).alias("all"), F.count_if(full).alias("stopped"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"] or r["stopped"] == stopped:
            break
        stopped, level = r["stopped"], (r["all"] - r["used"]) / r["open"]
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column) -> Column:
    return F.exp(F.least(F.log(F.lit(float(MOST_COPIES))), multiplier * size / mean))


def balanced(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """The multiplier of each source, by safeguarded Newton iterations on the dual.

    ``classes`` has (source, n, words) for documents of one size, ``sources`` (source, source_size, target, mean).
    """
    start = F.when(F.col("target") <= 0, -1e9).when(F.col("target") >= MOST_COPIES * F.col("source_size") * (1 - 1e-12), 1e9).otherwise(0.0)
    state = sources.select("source", "source_size", "target", "mean", start.alias("multiplier"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), (start != 0).alias("met"))
    state = written(state, "multipliers")
    words, size = F.col("words"), F.col("words") / F.col("n")
    while True:
        rate = _rate(F.col("multiplier"), size, F.col("mean"))
        open_ = F.when(F.col("multiplier") * size / F.col("mean") < F.log(F.lit(float(MOST_COPIES))), words * rate * size / F.col("mean")).otherwise(0.0)
        sums = classes.join(state, "source").groupBy("source").agg(F.sum(words * rate).alias("taken"), F.sum(open_).alias("slope"))
        now = state.join(sums, "source", "left")
        short = F.col("taken") < F.col("target")
        low = F.when(short, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(short, F.col("high")).otherwise(F.col("multiplier"))
        near = F.abs(F.col("taken") - F.col("target")) <= TOLERANCE * F.col("target")
        now = now.withColumns({"low": low, "high": high})
        close = F.col("high") - F.col("low") <= CLOSE * F.greatest(F.lit(1.0), F.abs("multiplier"))
        now = now.withColumn("met", F.col("met") | F.col("taken").isNull() | near | F.coalesce(close, F.lit(False)))
        step = F.col("multiplier") - F.log(F.col("taken") / F.col("target")) * F.col("taken") / F.nullif("slope", F.lit(0.0))
        inside = step.isNotNull() & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        middle = F.when(F.col("low").isNull(), 2 * F.col("high") - 1).when(F.col("high").isNull(), 2 * F.col("low") + 1).otherwise((F.col("low") + F.col("high")) / 2)
        now = now.withColumn("multiplier", F.when(F.col("met"), F.col("multiplier")).when(inside, step).otherwise(middle))
        last, state = state, written(now.select(*state.columns), "multipliers")
        discard(last)
        if not state.where(~F.col("met")).limit(1).count():
            break
    return state


def _copies(classes: DataFrame) -> DataFrame:
    """Whole copies of each size, ``copies``: rounded from large to small, the rest carried on.

    A source's sizes are dealt in turn into runs of at most ``RUN``, so that each run ends with small
    sizes, which take up what its rounding has left over, and no array grows with the data.
    """
    ranked = classes.withColumn("__rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"))) - 1)
    runs = F.ceil(F.count("*").over(Window.partitionBy("source")) / RUN)
    item = F.struct((-F.col("size")).alias("order"), F.col("n"), F.col("rate"))
    listed = ranked.withColumn("__run", F.col("__rank") % runs).groupBy("source", "__run").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def add(state: Column, x: Column) -> Column:
        size = (-x["order"]).cast("double")
        wanted = x["n"] * x["rate"] * size + state["carry"]
        taken = F.least((MOST_COPIES * x["n"]).cast("double"), F.greatest(F.lit(0.0), F.round(wanted / size)))
        return F.struct((wanted - taken * size).alias("carry"), F.concat(state["out"], F.array(F.struct((-x["order"]).alias("size"), taken.cast("long").alias("copies")))).alias("out"))

    empty = F.struct(F.lit(0.0).alias("carry"), F.expr("cast(array() as array<struct<size:bigint,copies:bigint>>)").alias("out"))
    return listed.select("source", F.explode(F.aggregate("items", empty, add)["out"]).alias("x")).select("source", "x.size", "x.copies")


def mix(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``rate`` and ``copies`` of every row.

    A null text has size 0; rows of size 0 are never taken; a null source is a source of its own,
    last in order; repeated rows count each, and which of equal rows gets an odd copy makes no
    difference to the result.  Empty input gives an empty result.
    """
    rows = written(sized(docs), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    classes = written(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "size-classes")
    means = classes.groupBy("source").agg((F.sum("words") / F.sum("n")).alias("mean"))
    state = balanced(classes, sources.join(means, "source", "left"))
    rated = classes.join(state.select("source", "multiplier", "mean"), "source").withColumn("rate", _rate(F.col("multiplier"), F.col("size"), F.col("mean")))
    whole = written(rated.join(_copies(rated), ["source", "size"]).select("source", "size", "n", "rate", "copies"), "copies")
    # who gets the odd copies of a size: parts share them by their counts, ranks inside a part
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(PARTS)).cast("int")
    dealt = rows.where("size > 0").withColumn("part", part)
    counts = dealt.groupBy("source", "size", "part").agg(F.count("*").alias("held"))
    upto = Window.partitionBy("source", "size").orderBy("part")
    shared = counts.withColumn("upto", F.sum("held").over(upto)).join(whole, ["source", "size"])
    odd = F.col("copies") % F.col("n")
    share = F.floor(F.col("upto") * odd / F.col("n")) - F.floor((F.col("upto") - F.col("held")) * odd / F.col("n"))
    shared = shared.select("source", "size", "part", "rate", F.floor(F.col("copies") / F.col("n")).alias("base"), share.alias("odd"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(18)), "doc_id"))
    taken = dealt.withColumn("rank", rank).join(shared, ["source", "size", "part"])
    copies = (F.col("base") + F.when(F.col("rank") <= F.col("odd"), 1).otherwise(0)).cast("int")
    full = taken.select("doc_id", "source", "size", "rate", copies.alias("copies"))
    none = rows.where("size = 0").select("doc_id", "source", "size", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    named = full.unionByName(none).join(state.select("source", "source_size", "target"), "source")
    return named.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")
