"""Headings of sections in texts whose letters may have been misread.

A line is a heading if its first word is close enough to a keyword: within one edit for every four
letters, so that ``CAP1TUL0`` is a chapter and ``CAPTURA`` is not.  Keywords are few and fixed, so that each
word meets them in bounded edit distance inside the scan; nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import text

#: Capitals of ACCENTED_UPPER are plain; letters and digits up to the first other character are the word.
_WORD = r"^[^A-Z0-9]{0,3}([A-Z0-9]+)"
#: A number may have been read as letters.
_NUMBER = r"^[^A-Z0-9]*([0-9OIL]{1,4})(?![A-Z0-9])"


def plain(line: Column) -> Column:
    return F.translate(F.upper(line), text.ACCENTED_UPPER, text.PLAIN_UPPER)


def allowed(keyword: str) -> int:
    """Edits that a keyword of this length may have."""
    return len(keyword) // 4


def headings(docs: DataFrame, keywords: dict[str, str], id_column: str = "doc_id", content: str = "text") -> DataFrame:
    """(id, line, level, distance, number, title) of every heading line, lines from 0.

    ``keywords``: {level: keyword in plain capitals}; the level of least distance wins, of equals the first.
    The number is what follows the keyword, O read as 0 and I and L as 1, null if none follows; the title
    is the rest of the line, or the next line where nothing rests and that is all capitals.  Null texts have
    no heading.
    """
    lines = docs.select(id_column, F.split(content, "\n").alias("__lines")).select(id_column, "__lines", F.posexplode("__lines").alias("line", "__line"))
    word = lines.withColumn("__word", F.regexp_extract(plain(F.col("__line")), _WORD, 1)).where("__word <> ''")
    # levenshtein with a bound gives -1 beyond it
    near = [F.when(F.levenshtein("__word", F.lit(k), allowed(k)) >= 0, F.struct(F.levenshtein("__word", F.lit(k)).alias("distance"), F.lit(i).alias("place"), F.lit(level).alias("level"))) for i, (level, k) in enumerate(keywords.items())]
    found = word.withColumn("__best", F.array_min(F.array_compact(F.array(*near)))).where("__best is not null")
    rest = F.regexp_replace(F.col("__line"), r"^[^\p{L}\p{N}]{0,3}[\p{L}\p{N}]+", "")
    number = F.nullif(F.translate(F.regexp_extract(plain(rest), _NUMBER, 1), "OIL", "011"), F.lit(""))
    after = F.trim(F.regexp_replace(F.when(number.isNotNull(), F.regexp_replace(rest, r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+", "")).otherwise(rest), r"^[^\p{L}\p{N}]+", ""))
    following = F.get("__lines", F.col("line") + 1)
    title = F.when(after != "", after).when(following.rlike(r"\p{Lu}{2}") & (F.upper(following) == following), F.trim(following)).otherwise("")
    return found.select(id_column, "line", F.col("__best.level").alias("level"), F.col("__best.distance").alias("distance"), number.cast("int").alias("number"), title.alias("title"))
