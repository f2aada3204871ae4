"""The limiter against a plain queue: batch and stream, a hot key, ties, late requests, and a restart."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparrowmill.operators import logs
from sparrowmill.streaming import events

START = datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, who string, departs string, at int"


def requests(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + timedelta(microseconds=rnd.randrange(3 * 86_400 * 10**6) if rnd.random() < 0.8 else 3600 * 10**6 * rnd.randrange(30))
        rows.append((i, rnd.choice([at] * 30 + [None]), rnd.choice(["hot"] * 6 + ["a", "b", "c", "d"] + [None] * (i % 9 == 0)), "x", 1))
    return rows


def served(rows, quota, seconds, rings=None):
    """Microseconds waited by id, one request after another."""
    rings = defaultdict(deque) if rings is None else rings
    out = {}
    for i, at, who, *_ in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[1], r[0])):
        ring = rings[who]
        leaves = at
        if len(ring) == quota:
            leaves = max(at, ring.popleft() + timedelta(seconds=seconds))
        ring.append(leaves)
        out[i] = round((leaves - at) / timedelta(microseconds=1))
    return out


def test_batch_like_a_queue(spark):
    rows = requests(900, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for quota, seconds, stretch in ((1, 300, 86_400), (3, 3600, 3600), (5, 60, 7000)):
        got = logs.paced(df, "who", "ts", "id", quota, seconds, stretch).collect()
        want = served(rows, quota, seconds)
        assert {r.id: r.waited for r in got if r.id in want} == want and sum(want.values()) > 0
        free = [r for r in got if r.id not in want]
        assert len(got) == len(rows) and all(r.waited == (0 if r.ts else None) for r in free)
    assert logs.paced(df.where("false"), "who", "ts", "id", 2, 60).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = sorted(requests(600, 2), key=lambda r: (r[1] or START, r[0]))
    first, second = rows[:350], rows[350:]
    like = spark.createDataFrame(rows, SCHEMA)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = events.read(spark, source, like)
        return {r.id: r.waited for r in events.append(events.limited(stream, "who", "id", 3, 3600, late="30 days"), sink).collect()}

    spark.createDataFrame(first, SCHEMA).repartition(2).write.parquet(source)
    assert run() == served(first, 3, 3600)
    assert run() == served(first, 3, 3600)  # nothing new, nothing twice
    spark.createDataFrame(second, SCHEMA).repartition(2).write.mode("append").parquet(source)
    assert run() == served(rows, 3, 3600)


def test_state_goes_once_it_can_delay_nothing(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d, i: (i, START + timedelta(days=d), "a" if d else "b", "", 0)
    like = spark.createDataFrame([day(0, 1)], SCHEMA)
    like.write.parquet(source)
    stream = lambda: events.append(events.limited(events.read(spark, source, like), "who", "id", 2, 60, late="1 hour"), sink)
    stream()
    for d in (2, 3):
        spark.createDataFrame([day(d, d)], SCHEMA).write.mode("append").parquet(source)
        stream()
    state = spark.read.format("statestore").load(f"{sink}/checkpoint")
    assert [r.key["who"] for r in state.select("key").collect()] == ["a"]
    assert stream().where(F.col("waited") > 0).count() == 0


def test_stream_answers_a_hot_key_in_pieces(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i * 7919 % 40_000 * 60), "hot", "", 0) for i in range(events.SERVED * 2 + 9)]
    like = spark.createDataFrame(rows, SCHEMA)
    like.write.parquet(str(tmp_path / "in"))
    got = events.append(events.limited(events.read(spark, str(tmp_path / "in"), like), "who", "id", 3, 300, late="60 days"), str(tmp_path / "out"))
    assert {r.id: r.waited for r in got.collect()} == served(rows, 3, 300)
