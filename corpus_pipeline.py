"""A corpus pipeline of five stages, each one operator of sparrowmill.llm at its production parameters.

Every function of ``STAGES`` takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the result is written as Parquet and read again, so each works on all that its predecessor kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparrowmill.llm import bpe, id_filter, jaccard_join, langid, mixing, substring_dedup
from sparrowmill.scratch import discard, written

#: Decided by the operators' models and hashes, not by SQL.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter (``und``) go.

    ``lang`` becomes the identified language.
    """
    langs, prototypes = langid.learn(docs.where(~langid.held_out()))
    named = langid.predict(docs, langs, prototypes, extra=[c for c in docs.columns if c != "doc_id"], named=("__lang", "__score"))
    return named.where("__lang <> 'und'").withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: that of the smallest id.

    Rows of a null id stay, whatever they are linked with; rows that repeat an id stay or go together.
    """
    groups = jaccard_join.similarity_groups(docs)
    dropped = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    return id_filter.lacking(docs, dropped)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; those left blank go."""
    return substring_dedup.deduplicated(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as its source's target asks for, none to three.

    Rows that repeat an id share the copies of all of them evenly, rounded; rows of a null id, which
    nothing tells apart, stay once whatever the mix gives them.
    """
    mixed = mixing.mix(docs).select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"))
    times = written(mixed.where("__copies <> 1 and __id is not null").groupBy("__id").agg(F.sum("__copies").alias("__copies"), F.count("*").alias("__rows")), "times")
    ids = times.select(F.col("__id").alias("doc_id"))
    once = id_filter.lacking(docs, ids)
    other = id_filter.having(docs, ids).join(times.withColumnRenamed("__id", "doc_id"), "doc_id")
    repeated = other.withColumn("__n", F.explode(F.expr("sequence(1, greatest(1, cast(round(__copies / __rows) as int)))"))).where("round(__copies / __rows) > 0")
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that the mix takes."""
    return bpe.bpe_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on ``documents``; a stage's table goes once the next one's is there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
