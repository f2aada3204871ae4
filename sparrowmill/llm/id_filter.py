"""Picking the rows of a wide table by a set of ids without shuffling the whole table.

The ids' hashes set bits of a bitmap of fixed size, held as a table of 64-bit words.  That table
has a proven bound (``WORDS`` rows), so it is broadcast; rows whose bit is clear are decided at
once, and only the others, texts included, meet the exact ids in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of the bitmap table; 64 bits each.
WORDS = 1 << 16


def _bit(id_column: str):
    return F.pmod(F.xxhash64(F.col(id_column)), F.lit(64 * WORDS))


def free(columns: list[str], stem: str) -> str:
    """A column name that a table doesn't have yet."""
    return next(n for i in range(len(columns) + 1) if (n := f"__{stem}{i}") not in columns)


def _marked(table: DataFrame, ids: DataFrame) -> tuple[DataFrame, str]:
    """The table with a column that says whether a row's bit is set, and that column's name."""
    place = _bit("doc_id")
    word, bits, hit = (free(table.columns, stem) for stem in ("word", "bits", "hit"))
    words = ids.select(F.floor(place / 64).cast("int").alias(word), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("bit")).groupBy(word).agg(F.bit_or("bit").alias(bits))
    at = table.withColumn(word, F.floor(place / 64).cast("int"))
    set_ = F.expr(f"coalesce(shiftrightunsigned({bits}, cast(pmod(xxhash64(doc_id), 64) as int)) & 1L, 0L) = 1L")
    return at.join(F.broadcast(words), word, "left").withColumn(hit, set_).drop(word, bits), hit


def having(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``doc_id`` is in ``ids`` (distinct, in a column ``doc_id``)."""
    marked, hit = _marked(table, ids)
    return marked.where(hit).drop(hit).join(ids, "doc_id", "left_semi").select(*table.columns)


def lacking(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``table`` whose ``doc_id`` isn't in ``ids``; null ids stay."""
    marked, hit = _marked(table, ids)
    doubtful = marked.where(hit).drop(hit).join(ids, "doc_id", "left_anti")
    return marked.where(~F.col(hit)).drop(hit).select(*table.columns).unionByName(doubtful.select(*table.columns))
