"""Chunks of texts: fixed windows as columns, and chunks that end where a text best allows it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T


def fixed(df: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """Windows of ``size`` characters that overlap by ``overlap``; a short text is one window."""
    step = size - overlap
    last = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / float(step))).cast("int") - 1
    each = df.select("*", F.explode(F.sequence(F.lit(0), last)).alias("position"))
    return each.withColumn("chunk", F.substring(F.col(text), F.col("position") * step + 1, F.lit(size)))


#: How well a chunk may end somewhere, best first.
PARAGRAPH, SENTENCE, BETWEEN_WORDS, AFTER_HEADING = range(4)
_ITEM = re.compile(r"\(?(?:\d+(?:\.\d+)*|[a-z])[.)]$")


def is_heading(line: str, longest: int = 120) -> bool:
    """A short line whose letters are all capitals, such as a section's title."""
    return 2 < len(line) <= longest and line.isupper() and line[-1] not in ".;:"


def flowing(text: str) -> tuple[str, list[int], list[int]]:
    """A text with its lines joined into paragraphs, the places where it may end, and how well.

    Paragraphs end at blank lines, before numbered or lettered items, and around headings.  A
    sentence ends with ``.``, ``;`` or ``:`` unless that closes an item's number.  A place is the
    number of characters before it.
    """
    pieces: list[str] = []
    places: list[int] = []
    kinds: list[int] = []
    at = 0
    open_ = True  # whether the next word begins a paragraph
    for line in text.split("\n"):
        words = line.split()
        if not words:
            open_ = True
            if kinds and kinds[-1] not in (PARAGRAPH, AFTER_HEADING):
                kinds[-1] = PARAGRAPH
            continue
        heading = is_heading(" ".join(words))
        if heading or _ITEM.match(words[0]):
            open_ = True
            if kinds and kinds[-1] != AFTER_HEADING:
                kinds[-1] = PARAGRAPH
        for i, word in enumerate(words):
            if pieces:
                pieces.append("\n" if open_ else " ")
                at += 1
            open_ = False
            pieces.append(word)
            at += len(word)
            places.append(at)
            closes = word[-1] in ".;:" and not _ITEM.match(word)
            kinds.append((AFTER_HEADING if i + 1 == len(words) else BETWEEN_WORDS) if heading else SENTENCE if closes else BETWEEN_WORDS)
        open_ = heading
    return "".join(pieces), places, kinds


def packed(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters, each with the last ``overlap`` of the one before it.

    A chunk ends at the best kind of place in its latter half, of equals the last one, so headings
    stay with what follows them.  The overlap begins with a whole word.  A word of more than
    ``size`` characters is cut.
    """
    if overlap >= size:
        raise ValueError("the overlap must be below the size")
    flow, places, kinds = flowing(text)
    out: list[str] = []
    begin = done = 0
    while done < len(flow):
        if len(flow) - begin <= size:
            out.append(flow[begin:])
            break
        low = bisect_right(places, max(done, begin + size // 2))
        high = bisect_right(places, begin + size)
        if low >= high:
            low = bisect_right(places, done)
        best = min(range(low, high), key=lambda k: (kinds[k], -places[k]), default=None)
        end = places[best] if best is not None else begin + size
        out.append(flow[begin:end])
        done = end
        begin = end + (flow[end : end + 1].isspace())
        if overlap and best is not None:
            back = bisect_left(places, end - overlap)
            begin = min(begin, places[back] + 1)
    return out


def semantic(df: DataFrame, id_column: str, size: int = 750, overlap: int = 100, heading: str | None = None) -> DataFrame:
    """(id, position, chunk, chunk_id) of every document; blank and null texts give no chunk.

    With ``heading``, a column of context, ``embedded`` has it before the chunk.
    """
    schema = T.StructType([T.StructField("__id", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("__head", T.StringType())])

    def run(batches):
        for batch in batches:
            rows = [(i, k, chunk, h) for i, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, chunk in enumerate(packed(text or "", size, overlap))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], names=schema.names)

    head = F.col(heading).cast("string") if heading else F.lit(None).cast("string")
    out = df.select(F.col(id_column).cast("long").alias("__id"), F.col("text").alias("__text"), head.alias("__head")).mapInArrow(run, schema)
    out = out.select(F.col("__id").alias(id_column), "position", "chunk", F.concat(F.format_string("%d:c%03d:", "__id", "position"), F.left(F.sha1("chunk"), F.lit(12))).alias("chunk_id"), "__head")
    return out.withColumn("embedded", F.concat_ws("\n", "__head", "chunk")).drop("__head") if heading else out.drop("__head")


def truncated(items: str, head: int, tail: int):
    """The first ``head`` and last ``tail`` items of an array that is longer than both together."""
    a = F.col(items)
    return F.when(F.size(a) <= head + tail, a).otherwise(F.concat(F.slice(a, 1, head), F.slice(a, -tail, tail)))
