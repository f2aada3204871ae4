"""Benchmark decontamination: a prefix-filtered set join of documents with windows of items.

An item's windows are its runs of ``WINDOW`` consecutive words; an item of fewer words is one
window.  A window occurs in a document only if all its shingles (runs of up to ``SHINGLE`` words) do.  So one
necessary shingle will do as its prefix, and the rarest one in all documents makes the fewest
candidates.

1. One pass over the texts counts the windows' shingles in all documents; a bitmap of bounded size
   keeps others out, and each batch sums up what it has found before anything is shuffled.
2. Shingles are ordered by rarity; each window is filed under its rarest one, with its offset.  A
   window with a shingle that no document has is dropped.
3. A second pass finds where prefix shingles stand, and hands on a row per document with the words
   around each place.  Documents without such a place are done.
4. The places meet the windows by shingle: where these are few, by their measured size, they are
   broadcast, else Spark may split the join.  Length and position must allow for the window, then its
   words are compared with those in the document one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import discard, written
from ._arrow import fields, text_slices
from ._hashing import LOWER, joined, mix, range_hashes

WINDOW = 10
SHINGLE = 5
#: Bytes of windows that are broadcast at most; more meet the places in a shuffled join.
BROADCAST = 8 << 20
#: Bits of a bitmap of shingles: at least 16 for each, within these bounds (8 kB and 4 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25
#: Letters, digits and all bytes of characters beyond ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words_in(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words of lower-case bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[0::2], change[1::2]


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words, from the words' own."""
    total = mix(words[: len(words) - n + 1], n)
    with np.errstate(over="ignore"):
        for i in range(1, n):
            total = mix(total + words[i : len(words) - n + 1 + i], n)
    return total


def words_of_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of all texts, their words' begins, ends and hashes, and the first word of each text."""
    data, starts = joined(texts)
    data = LOWER[data]
    begin, end = words_in(data)
    return data, begin, end, range_hashes(data, begin, end), np.searchsorted(begin, starts)


def shingles_of(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of the runs of ``n`` words that stay within their text."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    return at, run_hashes(hashes, n)[at]


class Bitmap:
    """A set of 64-bit hashes with false members and no false absentees, of bounded size."""

    def __init__(self, hashes: DataFrame, n: int):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
        place = F.pmod(F.col("shingle"), F.lit(self.bits))
        rows = hashes.select(F.floor(place / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(shingle, 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        self.words = np.zeros(self.bits // 64, np.uint64)
        for r in rows.toLocalIterator():
            self.words[r.word] = np.uint64(r.bits & 0xFFFFFFFFFFFFFFFF)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(self.bits - 1)
        return (self.words[place >> np.uint64(6)] >> (hashes & np.uint64(63))) & np.uint64(1) == 1


def item_words(items: DataFrame) -> DataFrame:
    """Items of the same words as one class: ``class``, ``words`` as one text, ``ids`` as sorted texts."""
    return (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.array_join(words_column("text"), " ").alias("words"))
        .where("words <> ''").groupBy("words").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("class", F.sha2("words", 256))
    )


def words_column(text: str):
    """The words of a text column as an array, by Spark's own functions."""
    small = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(small, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def windows_of(classes: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``words`` (one text), ``n`` words, and ``classes`` that have it."""
    w = F.split("words", " ")
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    runs = classes.select("class", w.alias("w")).select("class", F.explode(F.transform(begins, lambda i: F.slice("w", i + 1, window))).alias("run"))
    return runs.select("class", F.array_join("run", " ").alias("words"), F.size("run").alias("n")).groupBy("words", "n").agg(F.collect_set("class").alias("classes"))


def shingles_of_windows(windows: DataFrame) -> DataFrame:
    """A row for each shingle of each window: ``shingle``, its length ``k``, ``at``, and the window's columns."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch, name="words"):
                _, _, _, hashes, first = words_of_texts(texts)
                size = np.diff(first)
                rows, offsets, found = [], [], []
                for k in range(1, SHINGLE + 1):
                    at, h = shingles_of(hashes, first, k)
                    row = np.searchsorted(first, at, side="right") - 1
                    keep = np.minimum(size, SHINGLE)[row] == k
                    rows.append(row[keep]), offsets.append((at - first[row])[keep]), found.append(h[keep])
                row = np.concatenate(rows)
                kept = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(np.concatenate(found).view(np.int64)), pa.array(np.minimum(size, SHINGLE)[row].astype(np.int32)), pa.array(np.concatenate(offsets).astype(np.int32))],
                    names=[*kept.schema.names, "shingle", "k", "at"],
                )

    return windows.mapInArrow(hashed, T.StructType([*windows.schema.fields, *fields(shingle=T.LongType(), k=T.IntegerType(), at=T.IntegerType()).fields]))


def counted(docs: DataFrame, bitmap: Bitmap, lengths: list[int]) -> DataFrame:
    """How often all documents have each shingle of the bitmap: ``shingle``, ``times``."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in batches:
            for _, texts in text_slices(batch):
                _, _, _, hashes, first = words_of_texts(texts)
                found = [h[marked.has(h)] for h in (shingles_of(hashes, first, k)[1] for k in lengths)]
                values, times = np.unique(np.concatenate(found), return_counts=True)
                if len(values):
                    yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times.astype(np.int64))], names=["shingle", "times"])

    return docs.select("text").mapInArrow(count, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))


def places(docs: DataFrame, bitmap: Bitmap, lengths: list[int], window: int) -> DataFrame:
    """A row for each document: its words, and where shingles of the bitmap stand with the words around them.

    ``found`` holds (shingle, position of its first word, words before it in ``around``, ``around``).
    """
    kind = T.StructType([*docs.schema.fields, *fields(n_words=T.LongType(), found=T.ArrayType(fields(shingle=T.LongType(), position=T.IntegerType(), before=T.IntegerType(), around=T.StringType()))).fields])
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = [f.name for f in docs.schema.fields if f.name != "text"]
    element = pa.struct([("shingle", pa.int64()), ("position", pa.int32()), ("before", pa.int32()), ("around", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                data, begin, end, hashes, first = words_of_texts(texts)
                each = [(at[m], h[m]) for at, h in (shingles_of(hashes, first, k) for k in lengths) for m in [marked.has(h)]]
                at, h = np.concatenate([x for x, _ in each]).astype(np.int64), np.concatenate([x for _, x in each])
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                text = np.searchsorted(first, at, side="right") - 1
                low, high = np.maximum(first[text], at - window + 1), np.minimum(first[text + 1], at + window)
                # one byte buffer holds the words of all places, a space between words
                size = high - low
                w = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                raw = data.tobytes()
                around, i = [], 0
                spans = [raw[b:e] for b, e in zip(begin[w].tolist(), end[w].tolist())]
                for n in size.tolist():
                    around.append(b" ".join(spans[i : i + n]))
                    i += n
                items = pa.StructArray.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array((at - first[text]).astype(np.int32)), pa.array((at - low).astype(np.int32)), pa.array(around, pa.binary()).cast(pa.string())], fields=list(element)
                )
                offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), items)], names=[*names, "n_words", "found"]
                )

    return docs.mapInArrow(find, T.StructType([f for f in kind.fields if f.name != "text"]))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where windows of items occur in documents, exactly.

    Three tables: a row for each document (``row``, ``doc_id``, ``n_words``), the windows found
    (``row``, ``begin`` and ``end`` in words, ``classes`` of items), and the items of each class
    (``class``, ``ids``).
    """
    classes = written(item_words(items), "item-classes")
    windows = shingles_of_windows(windows_of(classes, window))
    filed = written(windows, "windows")
    lengths = sorted(r.k for r in filed.select("k").distinct().collect())
    texts = docs.select("doc_id", "text")
    if lengths:
        own = filed.select("shingle").distinct()
        times = counted(texts, Bitmap(own, own.count()), lengths)
        # a shingle that no document has makes the least key: such a window can't occur
        rarity = F.struct(F.coalesce("times", F.lit(0)).alias("times"), "shingle", "at")
        prefixes = written(filed.join(times, "shingle", "left").groupBy("words", "n").agg(F.first("classes").alias("classes"), F.min(rarity).alias("prefix"), F.first("k").alias("k")).where("prefix.times > 0"), "prefixes")
        lengths = sorted(r.k for r in prefixes.select("k").distinct().collect())
    else:
        prefixes = written(filed.select("words", "n", "classes", F.struct(F.lit(0).alias("times"), "shingle", "at").alias("prefix"), "k"), "prefixes")
    index = prefixes.select(F.col("prefix.shingle").alias("shingle"), F.col("prefix.at").alias("at"), "words", "n", "classes")
    keyed = texts.withColumn("row", F.monotonically_increasing_id())
    if lengths:
        own = index.select("shingle").distinct()
        found = places(keyed, Bitmap(own, own.count()), lengths, window)
    else:
        none = T.ArrayType(fields(shingle=T.LongType(), position=T.IntegerType(), before=T.IntegerType(), around=T.StringType()))
        found = keyed.select("doc_id", "row", F.size(words_column("text")).cast("long").alias("n_words"), F.lit(None).cast(none).alias("found"))
    rows = written(found, "places")
    discard(filed)
    held = index.agg(F.sum(F.octet_length("words") + 100)).first()[0] or 0
    candidates = rows.select("row", "n_words", F.explode("found").alias("c")).select("row", "n_words", "c.*")
    begin = F.col("position") - F.col("at")
    fits = (F.col("before") >= F.col("at")) & (begin + F.col("n") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), F.col("before") - F.col("at") + 1, F.col("n")), " ") == F.col("words")
    hits = candidates.join(F.broadcast(index) if held <= BROADCAST else index, "shingle").where(fits).where(same).select("row", begin.alias("begin"), (begin + F.col("n")).alias("end"), "classes")
    return rows.select("row", "doc_id", "n_words", (F.size("found") > 0).alias("doubtful")), hits, classes


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in any occurrence of a window of any item.  Rows of ``docs`` are judged
    one by one, so those that repeat an id, or have a null one, each give a row; null and empty texts
    have no words.  Items without words have no window; items that repeat an id count once, and a null
    ``item_id`` counts as an item whose id is the empty text.  Other columns of both tables are left alone.
    """
    rows, hits, classes = occurrences(docs, items, window)
    spans = F.array_sort(F.collect_set(F.struct(F.col("begin"), F.col("end"))))
    found = hits.groupBy("row").agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["begin"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach")))["n"]
    named = (
        found.select("row", "spans", F.explode("classes").alias("class")).join(classes, "class")
        .groupBy("row").agg(F.first("spans").alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    )
    doubtful = rows.where("doubtful").join(named, "row", "left")
    names = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    hit = F.coalesce(covered, F.lit(0)).cast("long")
    clean = rows.where("not coalesce(doubtful, false)").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("ids"))
    whole = clean.unionByName(doubtful.select("doc_id", "n_words", hit.alias("n_hit"), names.alias("ids")))
    return whole.select("doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every occurrence of a window: the document's ``doc_id``, ``begin`` and ``end`` in words, and the ``ids`` of the items."""
    rows, hits, classes = occurrences(docs, items, window)
    named = hits.select("row", "begin", "end", F.explode("classes").alias("class")).join(classes, "class").groupBy("row", "begin", "end").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return named.join(rows, "row").select("doc_id", "begin", "end", "ids")
