"""Exact quantiles against numpy, through all rounds of narrowing."""

import math
import random

import numpy as np
import pytest

from sparrowmill.operators import quantiles


def rows(seed):
    rnd = random.Random(seed)
    out = [("hot", rnd.choice([rnd.gauss(0, 1), float(rnd.randrange(5)), 1e300 * rnd.random(), -3.5])) for _ in range(2500)]
    out += [("same", 4.0) for _ in range(1200)] + [("one", 7.5), ("null", None), (None, 1.0), (None, 2.0)]
    out += [("few", float(i)) for i in range(11)] + [("skew", rnd.expovariate(1) ** 8) for _ in range(900)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("ranked", [200_000, 400])
def test_like_numpy(spark, monkeypatch, ranked):
    monkeypatch.setattr(quantiles, "RANKED", ranked)
    data = rows(1)
    df = spark.createDataFrame(data, "k string, v double").repartition(2)
    picks = {"low": 0.0, "a": 0.025, "middle": 0.5, "p90": 0.9, "b": 0.975, "high": 1.0}
    got = {r.k: tuple(r[p] for p in picks) for r in quantiles.quantiles(df, ["k"], "v", picks).collect()}
    want = {}
    for k in {k for k, v in data if v is not None}:
        want[k] = tuple(np.quantile([v for i, v in data if i == k and v is not None], list(picks.values())))
    assert set(got) == set(want) and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_whole_table_and_none(spark):
    df = spark.createDataFrame(rows(2), "k string, v double")
    values = [v for _, v in rows(2) if v is not None]
    got = quantiles.quantiles(df, [], "v", {"m": 0.5}).first().m
    assert math.isclose(got, np.median(values), rel_tol=1e-12)
    assert quantiles.quantiles(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0
    both = quantiles.with_quantiles(df.groupBy("k").count(), df, ["k"], "v", {"m": 0.5})
    assert {r.k: r.m for r in both.collect()}["null"] is None and {r.k: r.m for r in both.collect()}[None] == 1.5
