"""Streams over an event table: daily use per user, trailing rates, and upserts by micro-batch."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import delete_path, exists


#: Requests that a limiter answers at a time.
SERVED = 16_384


def read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A Parquet folder as a stream; ``ts`` becomes a timestamp that a watermark accepts."""
    return spark.readStream.schema(like.schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_use(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of each user and day; days close once the watermark passes them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "user_id").agg(F.count("*").alias("used"))


def limited(events: DataFrame, key: str, id_column: str, quota: int, seconds: int, late: str = "1 day") -> DataFrame:
    """Requests of a stream as a limiter lets them go: (key, id, ts, departs, waited), in microseconds.

    The state of a key is a ring of its last ``quota`` departures: a request leaves at its own time, or
    ``seconds`` after the departure that is ``quota`` places back, whichever is later.  Requests of a micro-batch stand by
    time, then id; one that comes in a later batch stands behind those served before.  A ring is dropped
    once the watermark has passed what it could still delay.  Rows without key or time can't be limited and
    are left out.
    """
    width = seconds * 1_000_000
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, id_column)}

    def serve(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ring = deque(state.get[0] if state.exists else [], maxlen=quota)
        # all that is held of a key's requests are their times and ids, and a number for their order
        rows = pd.concat([b[["at", id_column]] for b in batches], ignore_index=True)
        times, ids = rows["at"].to_numpy(), rows[id_column].to_numpy()
        del rows
        order = np.lexsort((ids, times))
        for begin in range(0, len(order), SERVED):
            some = order[begin : begin + SERVED]
            came, departs = times[some], []
            for at in came.tolist():
                ring.append(max(at, ring[0] + width) if len(ring) == quota else at)
                departs.append(ring[-1])
            if begin + SERVED >= len(order):
                state.update((list(ring),))
                state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), -(-(ring[-1] + width) // 1000)) + 1)
            yield pd.DataFrame({key: name[0], id_column: ids[some], "at": came, "departs": departs, "waited": np.array(departs, np.int64) - came})

    asked = events.withWatermark("ts", late).where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(key, id_column, "ts", F.unix_micros("ts").alias("at"))
    schema = f"{key} {kinds[key]}, {id_column} {kinds[id_column]}, at long, departs long, waited long"
    return asked.groupBy(key).applyInPandasWithState(serve, schema, "departures array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def append(stream: DataFrame, path: str) -> DataFrame:
    """Everything that is there now, and was not there before, through a stream into a table below ``path``.

    The folder also holds the stream's checkpoint: called again, after a stop or a lost driver, it goes on
    with its state and writes each row once.
    """
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def upsert(stream: DataFrame, path: str, key: str, order: str, buckets: int = 64, mode: str = "append") -> None:
    """Micro-batches merged by key into a bucketed table below ``path``, the row of the greatest ``order`` of each key.

    Keys are dealt over buckets by hash; a batch reads and writes again only the buckets that it
    touches, as folders ``rows/batch=N/bucket=B``, and lists in ``manifest/N`` which batch each bucket is
    of: a row a bucket, which is all that the driver sees.  A batch that runs again starts from the manifest
    before its own and writes the same folders again.  Folders that neither the newest manifest nor the
    one before names are deleted.  :func:`current` reads the table.  In mode ``update`` the stream's aggregates
    come as often as they change, and their state goes once the watermark has passed them.
    """
    spark = stream.sparkSession
    names = stream.columns

    def merge(batch: DataFrame, number: int) -> None:
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())  # ``buckets`` at most
        before = _manifest(spark, path, number - 1)
        held = [f"{path}/rows/batch={before[b]}/bucket={b}" for b in touched if b in before]
        rows = dealt.select(*names, "bucket")
        if held:
            old = spark.read.schema(stream.schema).parquet(*held)
            rows = rows.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        last = rows.groupBy("bucket", key).agg(F.max_by(F.struct(*names), F.struct(order, F.xxhash64(*names))).alias("r"))
        last.select("bucket", "r.*").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows/batch={number}")
        after = before | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(after.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{number}")
        for b, n in _manifest(spark, path, number - 2).items():
            if before.get(b) != n:
                delete_path(spark, f"{path}/rows/batch={n}/bucket={b}")

    stream.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which batch each bucket is of, after a batch; nothing before the first."""
    if number < 0 or not exists(spark, f"{path}/manifest/{number}/_SUCCESS"):
        return {}
    return {r.bucket: r.batch for r in spark.read.parquet(f"{path}/manifest/{number}").collect()}


def current(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table of :func:`upsert` as its newest manifest has it, with the columns of ``like``."""
    number = -1
    while exists(spark, f"{path}/manifest/{number + 1}/_SUCCESS"):
        number += 1
    folders = [f"{path}/rows/batch={n}/bucket={b}" for b, n in sorted(_manifest(spark, path, number).items())]
    return spark.read.schema(like.schema).parquet(*folders) if folders else spark.createDataFrame([], like.schema)
