"""Pruned search gives what full scores give; filters, exits and gates of the hybrid search."""

import random

from pyspark.sql import functions as F

from sparrowmill.operators import hybrid, pruned, retrieval


def corpus(spark, n, seed):
    rnd = random.Random(seed)
    words = lambda k: [f"w{int(rnd.paretovariate(0.7))}" for _ in range(k)]  # noqa: E731  few frequent, many rare
    docs = [(i, words(rnd.choice([0, 1, 5, 40, 120]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(20)]
    asked = [(i, words(rnd.choice([1, 2, 6, 12]))) for i in range(60)] + [(100, []), (101, ["nowhere"])]
    return spark.createDataFrame(docs, "doc_id long, words array<string>").repartition(3), spark.createDataFrame(asked, "query_id long, words array<string>")


def test_pruned_like_full_scores(spark):
    docs, asked = corpus(spark, 300, 1)
    key = lambda d: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in d.collect())
    full = retrieval.top(retrieval.bm25(docs, asked), 5, [F.desc(F.round("score", 9)), F.col("doc_id")])
    got = key(pruned.best(docs, asked, 5))
    assert got == key(full) and len({q for q, *_ in got}) > 40


def test_compared_counts_probes_that_find_nothing(spark):
    probes = spark.createDataFrame([(1, 10, "all"), (2, 20, "all"), (2, 20, "b")], "query_id long, doc_id long, slice string")
    found = spark.createDataFrame([(1, 2, 10), (1, 1, 11), (2, 1, 5)], "query_id long, rank int, doc_id long")
    got = {r.slice: (r.retriever, r.n, r.recall_1, r.recall_3, r.mrr) for r in pruned.compared({"x": found}, probes, [1, 3]).collect()}
    assert got == {"all": ("x", 2, 0.0, 0.5, 0.25), "b": ("x", 1, 0.0, 0.0, 0.0)}


def test_filters_exits_and_gate(spark):
    rows = [(1, ["a", "b"], [1.0, 0.0], "x", 5), (2, ["a"], [0.8, 0.6], "y", None), (3, ["c"], [0.0, 1.0], None, 9), (4, ["a", "a"], [1.0, 0.1], "y", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, words array<string>, embedding array<double>, lang string, size int")
    asked = [(1, ["a"], [1.0, 0.0], None, None), (50, ["a"], [1.0, 0.0], "y", None), (51, ["a"], [1.0, 0.0], "y", 8), (52, ["a"], [1.0, 0.0], "z", None), (53, ["c"], [-1.0, 0.0], "x", None), (54, ["a"], None, "y", None)]
    questions = spark.createDataFrame(asked, "query_id long, words array<string>, query array<double>, in_lang string, most int")
    filters = [hybrid.Filter("in_lang", "lang"), hybrid.Filter("most", "size", "<=")]
    got = {}
    for r in hybrid.answers(docs, questions, filters, threshold=0.5, k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.abstained, r.reason))
    assert [d for d, *_ in got[1]] == [4, 2, 3]  # not itself
    assert [d for d, *_ in got[50]] == [4, 2] and got[50][0][1:] == (False, None)
    assert got[51] == [(4, False, None)]  # an unknown size never passes
    assert got[52] == [(None, True, "no_candidates")]
    assert got[53] == [(1, True, "below_threshold")]
    assert {r[1:] for r in got[54]} == {(True, "below_threshold")}
