"""Ranks of sought documents: like full scores, without lists of the best, and without words left on disk."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill import plans, scratch
from sparrowmill.operators import known_items, pruned, retrieval

from compare import SF
from test_round3 import both


def a_corpus(spark):
    """Documents with copies, words that come again, some empty, and what thirty questions seek among them."""
    rnd = np.random.default_rng(11)
    held = [[f"w{w}" for w in np.minimum(rnd.zipf(1.3, n), 300)] for n in rnd.integers(1, 40, 260)]
    held += [held[i] for i in range(40)] + [["w1"] * 300] * 3 + [[]]
    docs = spark.createDataFrame(list(enumerate(held)), "doc_id long, words array<string>").repartition(25, "doc_id")
    asked = {q: [*dict.fromkeys(held[q][:4]), "w1", "none", None] for q in range(0, 60, 2)}
    sought = spark.createDataFrame([(q, words, d, held[d]) for q, words in asked.items() for d in (q, 260 - q, 303)], "query_id long, asked array<string>, doc_id long, words array<string>")
    return docs, asked, sought


@pytest.mark.parametrize("k", [1, 5, 40])
def test_ranks_of_full_scores(spark, monkeypatch, k):
    docs, asked, sought = a_corpus(spark)
    scored = retrieval.bm25(docs, spark.createDataFrame([(q, [w for w in words if w]) for q, words in asked.items()], "query_id long, words array<string>"))
    best = retrieval.top(scored, k, [F.desc(F.round("score", 9)), F.col("doc_id")]).join(sought.select("query_id", "doc_id"), ["query_id", "doc_id"])
    wanted = sorted(tuple(r) for r in best.groupBy("query_id").agg(F.min("rank"), F.min_by("doc_id", "rank")).collect())
    for name, value in {"WORDS_A_BLOCK": 900, "DOCUMENTS_A_BLOCK": 90, "QUESTIONS_A_ROW": 7, "QUESTIONS_AT_ONCE": 11, "FEW_OF": 1}.items():
        monkeypatch.setattr(known_items, name, value)
    assert sorted(tuple(r) for r in known_items.ranks(docs, sought, k).collect()) == wanted and len(wanted) > 10


@pytest.mark.parametrize(("at_once", "table"), [(50, 0), (250_000, 2_000), (1, 32_000_000)])
def test_blocks_like_full_counts(monkeypatch, at_once, table):
    monkeypatch.setattr(known_items, "POSTINGS_AT_ONCE", at_once)
    monkeypatch.setattr(known_items, "TABLE_BYTES", table)
    rnd = np.random.default_rng(3)
    size = rnd.integers(1, 60, 500)
    held = [np.minimum(rnd.zipf(1.4, n), 200) - 1 for n in size]
    tf = np.array([np.bincount(h, minlength=200) for h in held])
    where = np.argwhere(tf.T)
    norm = 1.5 * (0.25 + 0.75 * size / size.mean())
    block = known_items.Block(np.searchsorted(where[:, 0], np.arange(201)), where[:, 1], tf.T[tuple(where.T)], norm)
    counts = rnd.integers(1, 6, 120)
    term = np.concatenate([rnd.choice(200, n, replace=False, p=None) if i % 2 else rnd.choice(8, n, replace=False) for i, n in enumerate(counts)])
    idf = np.log(1 + (500 - (tf > 0).sum(0) + 0.5) / ((tf > 0).sum(0) + 0.5))[term]
    full = np.zeros((len(counts), 500))
    for q, t, w in zip(np.repeat(np.arange(len(counts)), counts), term, idf):
        full[q] += w * (tf[:, t] * 2.5 / (tf[:, t] + norm))
    sought = np.array([np.argsort(-s)[int(np.count_nonzero(s) * x)] for s, x in zip(full, rnd.random(len(counts)) ** 3)])
    score = full[np.arange(len(counts)), sought]
    ids = np.arange(500) * 7
    rounded, own = np.round(full, 9), np.round(score, 9)[:, None]
    wanted = ((rounded > own) | ((rounded == own) & (ids < (sought * 7)[:, None]))) & (score > 0)[:, None]
    some = score > 0
    got = known_items.better(block, ids, counts, term, idf, score, sought * 7, 9)
    assert (got == np.minimum(wanted.sum(1), 9))[some].all() and some.sum() > 60


def test_retrievers_leave_no_words_and_list_no_best(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pruned, "best", None)  # ten rows for each question and block
    monkeypatch.setattr(scratch, "shared_root", lambda spark: f"file://{tmp_path}/scratch")
    for query in ("retriever_comparison", "chunk_retrieval"):
        assert plans.QUERIES[query](spark, SF).count() > 1
    left = sum(p.stat().st_size for p in Path(tmp_path, "scratch").rglob("*.parquet"))
    assert left < Path(SF, "documents.parquet").stat().st_size / 2


def test_documents_without_text_count(spark, tmp_path):
    texts = [f"casa {i % 5} mesa {i % 3} rio {i % 7} sol luna mar {i} pan" if i % 4 else None for i in range(80)]
    documents = spark.createDataFrame([(i, t, None if i % 9 == 0 else "es") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got, wanted = both(spark, tmp_path, "retriever_comparison", documents=documents)
    assert got == wanted and len(got[1]) > 3
