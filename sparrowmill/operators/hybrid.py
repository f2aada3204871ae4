"""Filter first, then search by words and by vectors, fuse, and decide whether to answer.

Every question may set filters of its own.  Equal filters are one; the documents that pass each are
found before any search, so that words are weighed by the figures of the filtered part alone,
vectors meet the vectors that pass, and a question without a candidate is told so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..scratch import written
from . import pruned, retrieval

#: What a question that isn't answered is told.
NO_CANDIDATES, BELOW_THRESHOLD = "no_candidates", "below_threshold"


@dataclass(frozen=True)
class Filter:
    """A question's column against a document's: ``=``, ``<=`` (at most) or ``>=`` (at least); null sets no filter."""

    asked: str
    held: str
    how: str = "="


def passing(docs: DataFrame, questions: DataFrame, filters: list[Filter]) -> tuple[DataFrame, DataFrame]:
    """(questions with ``filter_id``, members): which documents pass which of the distinct filters.

    Members are (filter_id, doc_id).  A document's unknown value never passes a filter that is set.
    Distinct filters, not questions, meet the documents.
    """
    named = questions.withColumn("filter_id", F.xxhash64(*[F.coalesce(F.col(f.asked).cast("string"), F.lit("\0")) for f in filters]) if filters else F.lit(0).cast("long"))
    distinct = named.select("filter_id", *[F.col(f.asked).alias(f"__asked{i}") for i, f in enumerate(filters)]).dropDuplicates(["filter_id"])
    holds = F.lit(True)
    for i, f in enumerate(filters):
        asked, held = F.col(f"__asked{i}"), F.col(f.held)
        holds &= asked.isNull() | F.coalesce({"=": held == asked, "<=": held <= asked, ">=": held >= asked}[f.how], F.lit(False))
    own = docs.select("doc_id", *dict.fromkeys(f.held for f in filters))
    return named, own.join(distinct, holds).select("filter_id", "doc_id")


def lexical(docs: DataFrame, questions: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) by BM25 among the documents that pass a question's filter: full scores, a row each.

    For the best of many questions :func:`pruned.best_within` makes no such rows.
    ``docs`` (doc_id, words), ``questions`` (query_id, filter_id, words).  Documents' words are cut to
    those that are asked for before they become rows; counts, lengths and frequencies are of the filtered part.
    """
    asked = questions.select("query_id", "filter_id", F.explode(F.array_distinct("words")).alias("term"))
    terms = asked.select("term").distinct()
    sized = docs.select("doc_id", F.size("words").alias("len"), "words")
    figures = members.join(sized.select("doc_id", "len"), "doc_id").groupBy("filter_id").agg(F.count("*").alias("N"), F.greatest(F.avg("len"), F.lit(1.0)).alias("mean"))
    posted = sized.select("doc_id", "len", F.explode("words").alias("term")).join(terms, "term", "left_semi").groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))
    held = posted.join(members, "doc_id")
    frequency = held.groupBy("filter_id", "term").agg(F.count("*").alias("df"))
    rows = held.join(frequency, ["filter_id", "term"]).join(figures, "filter_id")
    weighed = rows.select("filter_id", "term", "doc_id", retrieval.bm25_weight("N", "df", "tf", "len", "mean").alias("weight"))
    return asked.join(weighed, ["filter_id", "term"]).groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))


def semantic(docs: DataFrame, questions: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, similarity) of the ``k`` vectors nearest to each question among those that pass its filter."""
    vectors = docs.join(members, "doc_id").select("filter_id", F.col("doc_id").alias("vec_id"), "embedding")
    asked = questions.select("filter_id", "query_id", F.col("query"))
    return retrieval.nearest(vectors, asked, k, others=True, within="filter_id").withColumnRenamed("vec_id", "doc_id")


def answers(docs: DataFrame, questions: DataFrame, filters: list[Filter], threshold: float, k: int = 10, depth: int = 50) -> DataFrame:
    """Ranked documents and the decision for each question: (query_id, rank, doc_id, rrf, best, abstained, reason).

    ``docs`` has (doc_id, words, embedding) and the filters' columns, ``questions`` (query_id, words, query)
    and theirs; a question doesn't find the document of its own id.  The two lists, ``depth`` long, are
    fused by reciprocal ranks; ties rank by similarity, then id.  Without a candidate the reason is
    ``no_candidates`` and there is one row without a document; else ``below_threshold`` where the greatest
    similarity, ``best``, is below the threshold (or there is none), with the documents found.
    """
    named, members = passing(docs, questions, filters)
    members = written(members, "members")
    by_words = pruned.best_within(docs, named, members, depth)
    near = written(semantic(docs, named, members, depth), "near")
    fused = retrieval.found_by("hybrid", by_words.select("query_id", "doc_id", "score", "rank"), near.select("query_id", "doc_id", F.round("similarity", 9).alias("score"), "rank"), "doc_id", k)
    counts = members.groupBy("filter_id").agg(F.count("*").alias("__candidates"))
    best = near.groupBy("query_id").agg(F.max("similarity").alias("best"))
    decided = named.select("query_id", "filter_id").join(counts, "filter_id", "left").join(best, "query_id", "left")
    reason = F.when(F.col("__candidates").isNull(), NO_CANDIDATES).when(retrieval.gated(F.col("best"), threshold) == "abstain", BELOW_THRESHOLD)
    decided = decided.select("query_id", "best", reason.isNotNull().alias("abstained"), reason.alias("reason"))
    return decided.join(fused.withColumnRenamed("score", "rrf"), "query_id", "left").select("query_id", "rank", "doc_id", "rrf", "best", "abstained", "reason")
