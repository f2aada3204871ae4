"""Perturbation figures against numpy, samples that are cut before they are shuffled, postings of few and many terms."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sparrowmill.operators import predictors, resampling, retrieval, text
from sparrowmill.plans import QUERIES


def test_perturbation_like_numpy(spark):
    rnd = random.Random(1)
    rows = [(float(rnd.randrange(20)), rnd.choice([None, 1.0, 2.0, 5.0, 30.0]), *[rnd.gauss(5, 3) for _ in range(3)], 4.0) for _ in range(80)]
    df = spark.createDataFrame(rows, "y double, gone double, a double, b double, c double, k double")
    got = {r.model: r for r in predictors.perturbation_study(df, "y", "gone", {"m": ("a", "b", "c"), "same": ("k", "k", "k")}, most=12.0).collect()}
    y, gone, a, b, c, _ = (np.array([np.nan if x is None else x for x in col], float) for col in zip(*rows))
    ok = ~np.isnan(gone)
    left = np.minimum(np.maximum(y[ok] - gone[ok], 0), 12)
    want = {"mae": abs(a - y).mean(), "moved_change": abs(b - a).mean(), "moved_mae": abs(b - y).mean(), "cut_mae": abs(c[ok] - left).mean(), "cut_change": (c - a)[ok].mean(), "expected_change": -gone[ok].mean()}
    want |= {"slope": np.polyfit(-gone[ok], (c - a)[ok], 1)[0], "corr": np.corrcoef(-gone[ok], (c - a)[ok])[0, 1]}
    assert all(math.isclose(got["m"][k], v, rel_tol=1e-9) for k, v in want.items())
    assert (got["same"].slope, got["same"].corr, got["same"].moved_change) == (0.0, 0.0, 0.0)


def test_a_sample_is_cut_before_the_shuffle(spark):
    df = spark.range(5000).select("id", (F.col("id") % 2).alias("g"))
    sample = resampling.sample_per_group(df, "g", "id", 7, "s")
    plan = sample._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Partial" in plan[plan.rindex("WindowGroupLimit") :].split("\n")[0]
    assert sample.count() == 14


def test_postings_of_many_terms(spark, monkeypatch):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i, [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(20))]) for i in range(60)], "doc_id long, words array<string>")
    asked = spark.createDataFrame([(1, ["w1", "w2", "w1"]), (2, ["w29", "nowhere"])], "query_id long, words array<string>")
    key = lambda: sorted((r.query_id, r.doc_id, round(r.score, 9)) for r in retrieval.bm25(docs, asked).collect())
    inside = key()
    monkeypatch.setattr(retrieval, "TERMS_INSIDE", 2)
    assert inside and key() == inside


def test_blocks_and_years_are_sought_once_a_text(spark):
    """However many lines a text has: neither the text nor its blocks are worked out again for each."""
    texts = ["head\nJOB 1\n2001-2003\nJOB 2\n1999", "JOB 1\nJOB 2\nx\nJOB 3", "none 2001\n", "", None, "JOB\n", "a\n\nJOB 1999 20010"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    told = F.concat(F.col("t"), F.lit("~MARK"))

    def cut(t, number):
        lines = (t + "~MARK").split("\n")
        begins = [i for i, x in enumerate(lines) if x.startswith("JOB")]
        if number >= len(begins):
            return "\n".join(lines)
        return "\n".join(lines[: begins[number]] + lines[(begins + [len(lines)])[number + 1] :])

    for number in range(4):
        rows = df.select("t", text.without_block(told, number, "^JOB").alias("cut"))
        assert [r.cut for r in rows.collect()] == [None if t is None else cut(t, number) for t in texts]
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("MARK") == 1
    rows = df.select(text.shifted_years(told, 5).alias("moved"))
    moved = lambda t: re.sub(r"(?<!\d)(19|20)\d\d(?!\d)", lambda m: str(int(m[0]) + 5), t + "~MARK")
    assert [r.moved for r in rows.collect()] == [None if t is None else moved(t) for t in texts]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MARK") == 1


def test_the_study_reads_each_text_once(spark):
    plan = QUERIES["perturbation_study"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cabeza") == 1 and plan.count("regexp_extract_all") == 4  # three texts, and the years that are moved
