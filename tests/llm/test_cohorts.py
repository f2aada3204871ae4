"""Cohort retention against plain Python, with a hot client, nulls, repeats and clashing columns."""

import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sparrowmill.llm import cohorts

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, salt int, state string, start0 long"
CLIENTS = "client_id long, source string, segment string, us long"
CLICK = cohorts.CLICK


def clicks(n, seed):
    rnd = random.Random(seed)
    first = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        ts = first + timedelta(microseconds=rnd.randrange(100 * 86_400 * 10**6))
        if rnd.random() < 0.2:
            ts = first + timedelta(days=7 * rnd.randrange(14))  # ties, and periods that begin on the dot
        client = 7 if rnd.random() < 0.4 else rnd.randrange(60)
        value = rnd.choice([None, 0.005, -3.215, math.nan, math.inf, 1e300, round(rnd.random() * 100, 2)])
        rows.append((rnd.choice([None, i, i, i, i]), rnd.choice([None] + [ts] * 20), rnd.choice([None] + [ts] * 9), rnd.choice([None] + [client] * 20), rnd.choice([None, "view", "view", "error", "click"]), value, rnd.choice([None, "{}"]), i, "x", 5))
    rows += [(*r[:7], 0, "y", 6) for r in rnd.sample(rows, n // 5)]
    rows.append((99_999, datetime(2024, 2, 1), datetime(2024, 1, 31), 500, "error", 1.0, None, 0, "", 0))
    rnd.shuffle(rows)
    return rows


def crc(x):
    return zlib.crc32(str(x).encode())


def cents(value):
    if value is None or not math.isfinite(value) or abs(value) > 9e16:
        return 0
    return math.floor(100 * value + 0.5)


def brute(rows, sources):
    us = lambda t: round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    week = 7 * 86_400 * 10**6
    seen = {tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r[:7]): r for r in rows if r[1] is not None and r[3] is not None}
    start, known = defaultdict(dict), defaultdict(list)
    for click, ts, arrived, client, kind, value, _ in (r[:7] for r in seen.values()):
        late = 0 if click is None or crc(click) % 3 else crc(click) % 100
        for state in (0, 1):
            if state or (arrived is not None and arrived + timedelta(days=late) < datetime(2024, 2, 1)):
                known[state].append((client, us(ts), cents(value)))
                if kind == "error":
                    start[client][state] = min(us(ts), start[client].get(state, 1 << 62))
    users = defaultdict(int)
    for state in known:
        for client, at, worth in known[state]:
            if at >= (begin := start[client].get(state, 1 << 62)):
                users[state, sources.get(client, ""), begin // week, (at - begin) // week, client] += worth
    cells = defaultdict(lambda: [0, 0, 0, 0])
    for (*cell, client), worth in users.items():
        both = {x // week for x in start[client].values()}
        for i, x in enumerate((1, crc(client), int(len(both) > 1), worth)):
            cells[tuple(cell)][i] += x
    return {k: tuple(v) for k, v in cells.items()}


def run(spark, rows, clients):
    known = [cohorts.known_before(3, "2024-02-01 00:00:00"), F.lit(True)]
    got = cohorts.retention(spark.createDataFrame(rows, CLICKS).repartition(3), spark.createDataFrame(clients, CLIENTS), known)
    assert [t for _, t in got.dtypes] == ["int", "string"] + 6 * ["bigint"]
    return {(r.state, r.segment, r.cohort, r.period): (r.users, r.users_crc32, r.moved, r.cents) for r in got.collect()}


def test_like_plain_python(spark):
    for seed in (1, 2):
        rows = clicks(1500, seed)
        clients = [(i, ["web", "crm", None][i % 3], "s", 1) for i in range(0, 50)] + [(None, "web", "s", 1), (1, "aaa", "s", 1)]
        sources = {i: s for i, s, *_ in clients if s} | {1: "aaa"}
        want = brute(rows, sources)
        assert sum(v[2] for v in want.values()) > 0 and {k[0] for k in want} == {0, 1}
        assert run(spark, rows, clients) == want


def test_no_rows(spark):
    rows = clicks(300, 3)
    assert run(spark, [], [(1, "web", "", 0)]) == {}
    assert run(spark, rows, []) == brute(rows, {})


def test_wall_clock_times_whatever_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = clicks(400, 4)
        assert run(spark, rows, []) == brute(rows, {})
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_no_join_and_no_window_over_a_whole_client(spark):
    known = [F.lit(False), F.lit(True)]
    frame = cohorts.retention(spark.createDataFrame(clicks(100, 5), CLICKS), spark.createDataFrame([], CLIENTS), known)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Window") == 2
