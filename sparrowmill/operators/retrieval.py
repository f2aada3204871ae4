"""Lexical, vector and fused retrieval, with structured pre-filters and an abstention gate."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import written

# fixed values: the parameters of the two scores
K1, B = 1.5, 0.75
RRF_K = 60


def bm25_weight(n: str, df: str, tf: str, size: str, mean: str) -> Column:
    """A term's weight in a document, from columns of the corpus, the term and the document."""
    idf = F.log(1 + (F.col(n) - F.col(df) + 0.5) / (F.col(df) + 0.5))
    return idf * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / F.col(mean)))


#: Terms that are looked for inside documents' words; more of them meet the words as rows.
TERMS_INSIDE = 10_000


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", words: str = "words") -> tuple[DataFrame, DataFrame]:
    """(documents with their ``len``, postings (term, doc_id, len, tf) of the distinct terms asked for).

    Words are made once.  Where the terms are few, by their count, a document's words are cut to them
    in the same pass, so that others are never written, exploded or shuffled.
    """
    few = [r.term for r in terms.where("term is not null").limit(TERMS_INSIDE + 1).collect()]
    inside = len(few) <= TERMS_INSIDE
    kept = F.filter(words, lambda w: w.isin(few)) if inside else F.col(words)
    table = written(docs.select(doc_id, F.size(words).alias("len"), kept.alias("__words")), "words")
    each = table.select(doc_id, "len", F.explode("__words").alias("term"))
    each = each if inside else each.join(terms, "term", "left_semi")
    return table.select(doc_id, "len"), each.groupBy("term", doc_id, "len").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", words: str = "words") -> DataFrame:
    """(query_id, doc_id, score) of every document that shares a term with a query.

    ``docs`` has an array of words, ``queries`` (query_id, words); a query's terms are a set.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("term"))
    sizes, posted = postings(docs, asked.select("term").distinct(), doc_id, words)
    whole = sizes.agg(F.count("*").alias("N"), F.greatest(F.avg("len"), F.lit(1.0)).alias("mean"))
    held = posted.groupBy("term").agg(F.count("*").alias("df"))
    rows = posted.join(held, "term").crossJoin(whole)  # one row of corpus figures
    scored = rows.select("term", doc_id, bm25_weight("N", "df", "tf", "len", "mean").alias("weight")).join(asked, "term")
    return scored.groupBy("query_id", doc_id).agg(F.sum("weight").alias("score"))


def top(scored: DataFrame, k: int, order: list[Column], group: str = "query_id") -> DataFrame:
    """The first ``k`` of each group, numbered from 1."""
    w = Window.partitionBy(group).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0))


#: Vectors and queries of a block at most, about.
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 8192, 1024


def best_of_block(k: int, others: bool):
    """For ``applyInPandas``: the ``k`` best of a block of vectors (vec_id, v) for each of a block of queries (query_id, v)."""

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="int64"), "similarity": pd.Series([], dtype="float64")})
        unit = lambda m: m / np.where((n := np.sqrt((m * m).sum(1, keepdims=True))) > 0, n, 1.0)
        ids = own["vec_id"].to_numpy(np.int64)
        near = unit(np.stack(asking["v"])) @ unit(np.stack(own["v"])).T
        out = []
        for i, query in enumerate(asking["query_id"].tolist()):
            order = np.lexsort((ids, -np.round(near[i], 9)))
            order = (order[ids[order] != query] if others else order)[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[order], "similarity": near[i, order]}))
        return pd.concat(out)

    return search


def nearest(docs: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, others: bool = False, within: str | None = None) -> DataFrame:
    """(query_id, rank, vec_id, similarity) of the ``k`` vectors of the greatest cosine to each query.

    ``docs`` has (vec_id, embedding), ``queries`` (query_id, query); the filter ``keep`` comes before
    the search.  Blocks of queries meet blocks of vectors, each pair of blocks in one product, and
    only the k best of a block go on.  Similarities that agree in nine places rank by id; with
    ``others`` a query doesn't find its own id; ``within`` names a column of both sides that must be equal.  Null and empty vectors take no part, zero vectors stay zero,
    and a query meets vectors of its own length.
    """
    only = [within] if within else []
    rows = (docs if keep is None else docs.where(keep)).where("embedding is not null and size(embedding) > 0").select("vec_id", *only, F.size("embedding").alias("dims"), F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.where("query is not null").select("query_id", *only, F.size("query").alias("dims"), F.col("query").cast("array<double>").alias("v"))
    parts = max(1, -(-rows.count() // VECTORS_A_BLOCK))
    blocks = max(1, -(-asked.count() // QUERIES_A_BLOCK))
    left = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    keys = [*only, "dims", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best_of_block(k, others), "query_id long, vec_id long, similarity double")
    return top(found, k, [F.desc(F.round("similarity", 9)), F.col("vec_id")])


def pooled(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """``keys``, ``n`` and the mean ``pooled`` of a group's vectors, place by place, weighted if asked for.

    Sums of each place are combined before they are shuffled, so that a group sends a row a place and
    task however many vectors it has.  Null and empty vectors, and weights that are null or 0, don't
    count; vectors of another length make a group of their own.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.where(F.size(vector) > 0).select(*keys, F.size(vector).alias("dims"), w.alias("__w"), vector).where("__w <> 0")
    each = rows.select(*keys, "dims", "__w", F.posexplode(vector).alias("__at", "__x"))
    sums = each.groupBy(*keys, "dims", "__at").agg(F.count("*").alias("n"), (F.sum(F.col("__w") * F.col("__x")) / F.sum("__w")).alias("__mean"))
    parts = F.array_sort(F.collect_list(F.struct("__at", "__mean")))  # as many as a vector has places
    return sums.groupBy(*keys, "dims").agg(F.max("n").alias("n"), F.transform(parts, lambda s: s["__mean"]).alias("pooled"))


def found_by(mode: str, lexical: DataFrame, semantic: DataFrame, id_column: str, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best by mode: semantic, bm25 or hybrid.

    ``lexical`` and ``semantic`` are ranked lists (query_id, id, score, rank).  Equal fused scores
    rank by the semantic score, then by id.
    """
    if mode in ("semantic", "bm25"):
        return (semantic if mode == "semantic" else lexical).where(F.col("rank") <= k).select("query_id", id_column, "score", "rank")
    if mode != "hybrid":
        raise ValueError(f"unknown mode: {mode}")
    near = semantic.select("query_id", id_column, F.col("score").alias("__near"))
    both = fused(lexical, semantic, id_column).join(near, ["query_id", id_column], "left").withColumnRenamed("rrf", "score")
    return top(both, k, [F.desc(F.round("score", 12)), F.desc_nulls_last("__near"), F.col(id_column)]).select("query_id", id_column, "score", "rank")


def fused(first: DataFrame, second: DataFrame, id_column: str) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (query_id, id, rank), and how many ``lists`` have an id."""
    both = first.select("query_id", id_column, "rank").unionByName(second.select("query_id", id_column, "rank"))
    return both.groupBy("query_id", id_column).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.count("*").alias("lists"))


def gated(best: Column, threshold: float) -> Column:
    """``abstain`` without a candidate or strictly below the threshold, else ``answer``."""
    return F.when(best.isNull() | (best < threshold), "abstain").otherwise("answer")


def structured(equal: dict[str, object] | None = None, at_least: dict[str, float] | None = None, at_most: dict[str, float] | None = None) -> Column:
    """A conjunction in which an unknown value never passes a filter that is set."""
    out = F.lit(True)
    for c, v in (equal or {}).items():
        out &= F.col(c) == F.lit(v)
    for c, v in (at_least or {}).items():
        out &= F.col(c) >= F.lit(v)
    for c, v in (at_most or {}).items():
        out &= F.col(c) <= F.lit(v)
    return F.coalesce(out, F.lit(False))
