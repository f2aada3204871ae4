"""Incremental indexes: what changed since the last build, upserts that may be repeated, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import delete_path, exists


def manifest_state(known: DataFrame, found: DataFrame, key: str, digest: str, same_source: Column | None = None) -> DataFrame:
    """What to make of each found file: registered (new), identical, or drifted.

    A key without a digest in the manifest is ``downloaded``; one that is known but wasn't found
    is ``missing``.  Drift is an error that the caller sees, never silently a new version.
    """
    a = known.select(key, F.col(digest).alias("__old"), F.lit(True).alias("__known"))
    b = found.select(key, F.col(digest).alias("__new"), F.lit(True).alias("__found"))
    state = F.when(F.col("__known").isNull(), "registered").when(F.col("__found").isNull(), "missing").when(F.col("__old").isNull(), "downloaded").when(F.col("__old") == F.col("__new"), "identical").otherwise("drifted")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def to_embed(entries: DataFrame, index: DataFrame, key: str, digest: str) -> DataFrame:
    """Entries that the index lacks or holds with another digest."""
    held = index.select(key, F.col(digest).alias("__held"))
    return entries.join(held, key, "left").where(F.col("__held").isNull() | (F.col("__held") != F.col(digest))).drop("__held")


def obsolete(entries: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Keys that the index holds and no entry has any more."""
    return index.select(key).join(entries.select(key), key, "left_anti")


def upserted(index: DataFrame, changed: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The index after a build: changed entries replace those of their key, gone ones go."""
    kept = index.join(changed.select(key), key, "left_anti").join(gone.select(key), key, "left_anti")
    return kept.unionByName(changed.select(*index.columns))


def build(spark: SparkSession, entries: DataFrame, path: str, version: int, key: str, digest: str, embed) -> DataFrame:
    """Version ``version`` of an index below ``path``, from the version before and today's entries.

    Only new and changed entries are given to ``embed``.  A version is written beside the last one
    and counts once its success marker is there, so a build that broke off is done again from the
    start, and one that is repeated changes nothing.
    """
    own, last = f"{path}/v{version}", f"{path}/v{version - 1}"
    if exists(spark, f"{own}/_SUCCESS"):
        return spark.read.parquet(own)
    delete_path(spark, own)
    if not exists(spark, f"{last}/_SUCCESS"):
        embed(entries).write.parquet(own)
    else:
        index = spark.read.parquet(last)
        upserted(index, embed(to_embed(entries, index, key, digest)), obsolete(entries, index, key), key).write.parquet(own)
    return spark.read.parquet(own)


def entry_text(parts: list[str], fallback: str) -> Column:
    """The text that is indexed: the parts that aren't blank, in order; the fallback if none is."""
    shown = [F.nullif(F.trim(F.col(p)), F.lit("")) for p in parts]
    return F.coalesce(F.nullif(F.concat_ws(". ", *shown), F.lit("")), F.lit(fallback))


def weighted_text(heading: Column, text: Column, times: int = 1) -> Column:
    """A text with its heading before it, once or more, so that its words weigh more."""
    return F.concat_ws(" ", *[heading] * times, text)
