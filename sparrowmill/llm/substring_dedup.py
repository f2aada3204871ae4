"""Substring deduplication by content-defined chunks.

A gear rolling hash picks the ends of chunks: gaps between words, if there are any, of the least
hash in some stretch of ``STRETCH`` bytes.  What stands between two ends depends on the text there
alone, so an insertion moves chunks but doesn't change those after it.  The digest of every run of
chunks that reaches ``SEED_BYTES`` is a seed, and so is the digest of every run of shared seeds that
reaches ``LEAST_BYTES``.  A seed that a document of smaller id has too is a repeat, held against the
least such document.  That one may hold no more than a short seed; a long one is a passage by itself
wherever it stands, so that no repeat of ``LEAST_BYTES`` + 3 * ``STRETCH`` bytes and more is missed
for what shorter pieces of it earlier documents have.  Seeds that one document holds in the same order and
distance are a chain, which is extended to its true ends against that document's text, and compared
with it: a digest alone never removes anything.  Passages of at least ``LEAST_BYTES`` are removed where
they repeat, not where they first stand.

Digests that one document alone has are the most by far, and never become rows: batches send
their digests to ranges of the hash space as compressed blobs, and get back those that others have.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import discard, release, shuffle_partitions, written
from ._arrow import fields, pieces, text_slices, utf8
from ._hashing import WHITE, gear, range_hashes, sequence_hashes
from .element_counts import RANGES, SENT, packed, unpacked
from .id_filter import free, having, lacking

#: Every so many bytes hold the end of a chunk.
STRETCH = 48
#: A seed is the shortest run of chunks of at least so many bytes.
SEED_BYTES = 64
#: Least length of a repeated passage, in bytes of UTF-8.
LEAST_BYTES = 160
#: Seeds and documents of one exchange of a batch, about; documents are numbered in 16 bits.
SEEDS, DOCS = 1 << 19, 60_000
#: Chains are extended by at most so many bytes at each end; no seed lies in what a passage has beyond.
MOST_BESIDE = 128
_NEVER = np.uint32(1 << 18)
_PAD = b"\n" * (STRETCH + 16)


def _slid(x: np.ndarray, wide: int, least: np.ufunc) -> np.ndarray:
    """The least (or greatest) of every ``wide`` values in a row."""
    span = 1
    while span < wide:
        step = min(span, wide - span)
        x = least(x[:-step], x[step:])
        span += step
    return x


def _ends(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends, of those that ``inside`` allows.

    Of every ``STRETCH`` positions in a row the one of least gear hash is taken, all of equals;
    gaps between words come before other positions, and never is a character cut.
    """
    value = gear(data).astype(np.uint32)
    gap = np.zeros(len(data), bool)
    gap[:-1] = WHITE[data[:-1]] & ~WHITE[data[1:]]
    whole = np.ones(len(data), bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    value[~gap] += np.uint32(65536)
    value[~(whole & inside)] = _NEVER
    lows = _slid(value, STRETCH, np.minimum)
    edge = np.zeros(STRETCH - 1, np.uint32)
    return np.flatnonzero((_slid(np.concatenate([edge, lows, edge]), STRETCH, np.maximum) == value) & (value < _NEVER))


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, padded apart, with their begins and ends."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes + len(_PAD)) - sizes
    return np.frombuffer(_PAD + b"".join(t + _PAD for t in texts), np.uint8), begin, begin + sizes


def cuts(text: bytes) -> np.ndarray:
    """Ends of the chunks of a text, the text's own end last; none for an empty text."""
    if not text:
        return np.zeros(0, np.int64)
    data, begin, end = _laid([text])
    inside = np.zeros(len(data), bool)
    inside[begin[0] : end[0] - 1] = True
    return np.append(_ends(data, inside) + 1 - begin[0], len(text))


def seeds(texts: list[bytes], least: int = LEAST_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, size, digest) of the seeds of texts of at least ``least`` bytes.

    Where a seed overlaps an equal one, as in one word said over and over, the whole stretch and both
    ends of it, of 1, 2, 4 ... periods, are seeds instead of those between the first and the last.
    """
    long = [i for i, t in enumerate(texts) if len(t) >= least]
    if not long:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    data, begin, end = _laid([texts[i] for i in long])
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end - 1, -1)
    found = _ends(data, np.cumsum(inside[:-1]) > 0) + 1
    bounds = np.unique(np.concatenate([begin, found, end]))
    of = np.searchsorted(begin, bounds, side="right") - 1
    to = np.minimum(np.searchsorted(bounds, bounds + SEED_BYTES), len(bounds) - 1)
    fits = (bounds[to] <= end[of]) & (bounds[to] - bounds >= SEED_BYTES)
    at, size, of = bounds[fits], (bounds[to] - bounds)[fits], of[fits]
    digest = range_hashes(data, at, at + size)
    same = np.flatnonzero((digest[1:] == digest[:-1]) & (at[1:] - at[:-1] < size[:-1]) & (of[1:] == of[:-1]))
    keep, stretches, done = np.ones(len(at), bool), set(), 0
    keep[same[1:][np.diff(same) == 1]] = False
    for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else []:
        i = int(run[0])
        if at[i] < done:
            continue
        period, t = int((at[run + 1] - at[run]).min()), int(of[i])
        own = data[begin[t] : end[t]]
        other = np.flatnonzero(own[period:] != own[:-period])
        here = int(at[i] - begin[t])
        k = int(np.searchsorted(other, here))
        a = int(other[k - 1]) + 1 if k else 0
        stop = int(other[k]) + period if k < len(other) else len(own)
        done = int(begin[t]) + stop
        a = here - (here - a) // period * period
        last = a + (stop - a) // period * period
        stretches.add((t, a, last))
        n = 1
        while n < (last - a) // period:
            if n * period > size[i]:
                stretches |= {(t, a, a + n * period), (t, last - n * period, last)}
            n *= 2
    more = np.array(sorted(stretches), np.int64).reshape(-1, 3)
    base = begin[more[:, 0]]
    digests = np.concatenate([digest[keep], range_hashes(data, base + more[:, 1], base + more[:, 2])])
    number = np.array(long, np.int64)[np.concatenate([of[keep], more[:, 0]])]
    return number, np.concatenate([at[keep] - begin[of[keep]], more[:, 1]]), np.concatenate([size[keep], more[:, 2] - more[:, 1]]), digests


# what others have too

SHARED = fields(doc_id=T.LongType(), text_hash=T.LongType(), digest=T.LongType(), begin=T.IntegerType(), size=T.IntegerType())
ANSWERS = fields(chunk=T.LongType(), blob=T.BinaryType())


def _coded(place, own, begin, size) -> bytes:
    """Entries in the order of their digests as one blob."""
    return packed(np.diff(place, prepend=np.uint64(0)), own, begin, size)


def _decoded(blob: bytes) -> list[np.ndarray]:
    place, own, begin, size = unpacked(blob, np.uint64, np.uint16, np.uint32, np.uint32)
    return [np.cumsum(place, dtype=np.uint64), own, begin, size]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[f.dataType.simpleString()]) for i, f in enumerate(schema)], names=schema.names)


def _scatter(least: int, parts: int):
    """Chunks of seeds: to each range those whose digest one document of the chunk alone has, and a
    mark of the others, which stay with the chunk's documents."""

    def run(batches):
        made, held, docs = 0, [], []

        def flush():
            nonlocal made
            chunk = TaskContext.get().partitionId() << 28 | made
            made += 1
            own, begin, size, digest = (np.concatenate(x) for x in zip(*held, strict=True))
            part = ((digest >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            place = part << np.uint64(32) | digest & np.uint64(0xFFFFFFFF)
            order = np.lexsort((own, place))
            place, own, begin, size = place[order], own[order].astype(np.uint16), begin[order].astype(np.uint32), size[order].astype(np.uint32)
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
            several = np.repeat(np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first), np.diff(np.append(first, len(place)))) if len(place) else np.zeros(0, bool)
            ids, nulls, hashes = [np.array(x) for x in ([d[0] or 0 for d in docs], [d[0] is None for d in docs], [d[1] for d in docs])]
            rows = [(chunk % parts, chunk, b"\0" + packed(ids.astype(np.int64), nulls.astype(np.uint8), hashes.astype(np.int64))), (chunk % parts, chunk, b"\1" + _coded(*(x[several] for x in (place, own, begin, size))))]
            sent = ~several
            sent[first] = True
            own[several] = 0xFFFF
            part, place, own, begin, size = (x[sent] for x in (part[order], place, own, begin, size))
            used = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
            for a, b in zip(used.tolist(), np.append(used[1:], len(part))[: len(used)].tolist(), strict=True):
                rows.append((int(part[a]), chunk, b"\2" + _coded(*(x[a:b] for x in (place, own, begin, size)))))
            held.clear()
            docs.clear()
            return _batch(rows, SENT)

        for batch in batches:
            for slice_, texts in text_slices(batch):
                of, begin, size, digest = seeds(texts, least)
                held.append((of + len(docs), begin, size, digest))
                docs += zip(slice_.column("doc_id").to_pylist(), slice_.column("text_hash").to_pylist(), strict=True)
                if sum(len(h[0]) for h in held) >= SEEDS or len(docs) >= DOCS - 10_000:
                    yield flush()
        if held:
            yield flush()

    return run


def _shared(blobs: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """For each chunk its entries whose digest another chunk has too."""
    each = [_decoded(b) for _, b in blobs]
    place = np.concatenate([e[0] for e in each])
    chunk = np.repeat(np.arange(len(each)), [len(e[0]) for e in each])
    order = np.argsort(place, kind="stable")
    place, chunk = place[order], chunk[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    several = np.empty(len(place), bool)
    several[order] = np.repeat(np.maximum.reduceat(chunk, first) != np.minimum.reduceat(chunk, first), np.diff(np.append(first, len(place))))
    at, rows = 0, []
    for (name, _), e in zip(blobs, each, strict=True):
        good = several[at : at + len(e[0])] & (e[1] != 0xFFFF)
        at += len(e[0])
        if good.any():
            rows.append((name, b"\1" + _coded(*(x[good] for x in e))))
    return rows


def _answer(batches):
    part, blobs = None, []
    for batch in batches:
        rows = []
        for p, chunk, blob in zip(*[batch.column(c).to_pylist() for c in SENT.names], strict=True):
            if p != part and blobs:
                rows += _shared(blobs)
                blobs = []
            part = p
            if blob[:1] == b"\2":
                blobs.append((chunk, blob[1:]))
            else:
                rows.append((chunk, blob))
        yield _batch(rows, ANSWERS)
    if blobs:
        yield _batch(_shared(blobs), ANSWERS)


def long_seeds(doc: np.ndarray, digest: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first seed, size, digest) of the shortest runs of ``least`` bytes of seeds that overlap or touch.

    Seeds come by document and begin.  Seeds that reach ``least`` bytes by themselves are none.
    """
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = begin + size
    apart = np.concatenate(([True], (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])))
    run = np.cumsum(apart)
    reach = np.maximum.accumulate(run << 32 | end)
    last = np.searchsorted(reach, run << 32 | begin + least)
    first = np.arange(len(doc))
    good = (last < len(doc)) & (run[np.minimum(last, len(doc) - 1)] == run) & (last > first)
    first, last = first[good], last[good]
    steps = np.where(apart, 0, np.diff(begin, prepend=begin[:1]))
    return first, (reach[last] & 0xFFFFFFFF) - begin[first], sequence_hashes(digest, steps, first, last)


def _gather(least: int):
    """A chunk's documents come first, then their shared seeds, to which the long ones are added."""

    def rows(own, held) -> pa.RecordBatch:
        place, doc, begin, size = (np.concatenate(x) for x in zip(*held, strict=True))
        doc, begin, size = doc.astype(np.int64), begin.astype(np.int64), size.astype(np.int64)
        order = np.lexsort((size, begin, doc))
        place, doc, begin, size = place[order], doc[order], begin[order], size[order]
        first, wide, digest = long_seeds(doc, place, begin, size, least)
        doc, begin, size, place = np.append(doc, doc[first]), np.append(begin, begin[first]), np.append(size, wide), np.append(place, digest)
        return pa.RecordBatch.from_arrays([pa.array(own[0][doc], mask=own[1][doc].astype(bool)), pa.array(own[2][doc]), pa.array(place.view(np.int64)), pa.array(begin.astype(np.int32)), pa.array(size.astype(np.int32))], names=SHARED.names)

    def run(batches):
        own, held = None, []
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                if blob[:1] == b"\0":
                    if held:
                        yield rows(own, held)
                    own, held = unpacked(blob[1:], np.int64, np.uint8, np.int64), []
                else:
                    held.append(_decoded(blob[1:]))
        if held:
            yield rows(own, held)

    return run


def shared_seeds(docs: DataFrame, least: int) -> DataFrame:
    """The seeds of ``docs`` (doc_id, text) that another row has too, and the long seeds they make: (doc_id, text_hash, digest, begin, size)."""
    tasks = shuffle_partitions(docs.sparkSession)
    parts = RANGES * tasks
    sent = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_scatter(least, parts), SENT)
    answered = sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_answer, ANSWERS)
    return answered.repartition("chunk").sortWithinPartitions("chunk", F.substring("blob", 1, 1)).mapInArrow(_gather(least), SHARED)


CHAINS = fields(doc_id=T.LongType(), text_hash=T.LongType(), begin=T.IntegerType(), end=T.IntegerType(), first_doc_id=T.LongType(), first_hash=T.LongType(), first_begin=T.IntegerType(), first_end=T.IntegerType())
BESIDE = fields(first_doc_id=T.LongType(), first_hash=T.LongType(), first_begin=T.IntegerType(), first_end=T.IntegerType(), inner=T.BinaryType(), before=T.BinaryType(), after=T.BinaryType())
SPANS = fields(doc_id=T.LongType(), text_hash=T.LongType(), begin=T.IntegerType(), end=T.IntegerType(), first_doc_id=T.LongType())


def _chains(batches):
    """Seeds of one text that one document holds at the same distance from each other, without a gap."""
    for batch in pieces(batches):
        rows = []
        for doc, key, found in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "found")], strict=True):
            open_: dict[tuple, list[int]] = {}
            for s in found:
                way = (s["first"], s["first_hash"], s["first_begin"] - s["begin"])
                end = s["begin"] + s["size"]
                if way in open_ and s["begin"] <= open_[way][1]:
                    open_[way][1] = max(open_[way][1], end)
                    continue
                if way in open_:
                    a, b = open_[way]
                    rows.append((doc, key, a, b, way[0], way[1], a + way[2], b + way[2]))
                open_[way] = [s["begin"], end]
            rows += [(doc, key, a, b, f, h, a + d, b + d) for (f, h, d), (a, b) in open_.items()]
        yield _batch(rows, CHAINS)


def _sum(text: bytes, begin: int, end: int) -> bytes:
    return blake2b(memoryview(text)[begin:end], digest_size=16).digest()


def _beside(most: int):
    """Checksums of the chains in the documents that have them first, and what stands before and after them there."""

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for doc, key, at, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("at").to_pylist(), utf8(batch.column("text")), strict=True):
                rows += [(doc, key, a["first_begin"], a["first_end"], _sum(text, a["first_begin"], a["first_end"]), text[max(0, a["first_begin"] - most) : a["first_begin"]], text[a["first_end"] : a["first_end"] + most]) for a in at]
            yield _batch(rows, BESIDE)

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def whole_words(text: bytes, begin: int, end: int, most: int, both_end: bool) -> tuple[int, int]:
    """The range drawn in by up to ``most`` bytes to begins of words, or else to whole characters.

    White space after a word belongs to it: a text's last word counts only if the other text
    ends there too (``both_end``).
    """
    starts = lambda i: i < len(text) and WHITE[text[i - 1]] and not WHITE[text[i]]
    inside = lambda i: 0 < i < len(text) and text[i] & 0xC0 == 0x80
    if begin:
        found = next((i for i in range(begin, min(begin + most, end)) if starts(i)), begin)
        while inside(found):
            found += 1
        begin = found
    if not both_end:
        found = next((i for i in range(end, max(end - most, begin), -1) if starts(i)), end)
        while inside(found):
            found -= 1
        end = found
    return begin, end


def _spans(least: int, most: int):
    """Chains whose bytes are those of the first document to their true ends; of ``least`` bytes and more they are passages, each byte in one."""

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for doc, key, chains, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("chains").to_pylist(), utf8(batch.column("text")), strict=True):
                found = []
                for c in chains:
                    if _sum(text, c["begin"], c["end"]) != c["inner"]:
                        continue
                    begin = c["begin"] - _common(text[max(0, c["begin"] - most) : c["begin"]][::-1], c["before"][::-1])
                    end = c["end"] + _common(text[c["end"] : c["end"] + most], c["after"])
                    if end - begin >= least:
                        both_end = end == len(text) and len(c["after"]) == end - c["end"] < most
                        begin, end = whole_words(text, begin, end, most, both_end)
                        found.append((begin, -end, c["first_doc_id"]))
                done = 0
                for begin, end, first in sorted(found):
                    if -end > max(begin, done):
                        rows.append((doc, key, max(begin, done), -end, first))
                        done = -end
            yield _batch(rows, SPANS)

    return run


def repeated_spans(docs: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Passages that repeat an earlier document's: byte range, and a document that has it first.

    The document of least id that has a seed is the one whose text decides where the passage
    begins and ends.  A passage that overlaps another gives what the other leaves.  Null and empty
    texts have no passage.  Rows that repeat an id count as one document, so they aren't repeats of
    each other; rows of null id are never first.  Distinct rows only.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = written(shared_seeds(texts, least), "seeds")
    release(docs.sparkSession)
    place = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("first"), F.col("text_hash").alias("first_hash"), F.col("begin").alias("first_begin")))
    first = table.groupBy("digest", "size").agg(F.min(place).alias("f"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("unnamed")).where("f.first < last or unnamed and f.first is not null")
    repeats = table.join(first.select("digest", "size", "f.*"), ["digest", "size"]).where("doc_id is null or first < doc_id")
    gathered = repeats.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("begin", "size", "first", "first_hash", "first_begin"))).alias("found"))
    chains = written(gathered.mapInArrow(_chains, CHAINS), "chains")
    discard(table)
    release(docs.sparkSession)

    asked = chains.groupBy(F.col("first_doc_id").alias("doc_id"), F.col("first_hash").alias("text_hash")).agg(F.collect_set(F.struct("first_begin", "first_end")).alias("at"))
    beside = written(_with_text(asked, texts).mapInArrow(_beside(MOST_BESIDE), BESIDE), "beside")
    sides = chains.join(beside, ["first_doc_id", "first_hash", "first_begin", "first_end"])
    own = sides.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("begin", "end", "first_doc_id", "inner", "before", "after")).alias("chains"))
    spans = written(_with_text(own, texts).mapInArrow(_spans(least, MOST_BESIDE), SPANS), "spans")
    discard(chains, beside)
    release(docs.sparkSession)
    return spans


def _with_text(held: DataFrame, texts: DataFrame) -> DataFrame:
    """``held`` (doc_id, text_hash and more; a row each) with the text of its row."""
    ids = held.where("doc_id is not null").select("doc_id").distinct()
    named = having(texts.where("doc_id is not null"), ids).withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "text_hash"])
    unnamed = texts.where("doc_id is null").withColumn("text_hash", F.xxhash64("text")).dropDuplicates(["text_hash"])
    return held.join(named, ["doc_id", "text_hash"]).unionByName(held.where("doc_id is null").join(unnamed.drop("doc_id"), "text_hash").select(*held.columns, "text"))


def deduplicated(docs: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """``docs`` without its repeated passages; ``n_chars`` follows, and rows that this leaves blank go.

    All columns stay; a text that repeats nothing is kept as it is.
    """
    names = docs.columns
    key, cuts_ = free(names, "hash"), free(names, "spans")
    spans = repeated_spans(docs, least)
    held = spans.groupBy("doc_id", F.col("text_hash").alias(key)).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias(cuts_))
    ids = spans.where("doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    touched = having(named, ids).withColumn(key, F.xxhash64("text")).join(held, ["doc_id", key], "left")
    unnamed = docs.where("doc_id is null").withColumn(key, F.xxhash64("text")).join(held.where("doc_id is null").drop("doc_id"), key, "left")
    wide = touched.select(*names, cuts_).unionByName(unnamed.select(*names, cuts_))

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, 1 << 22):
                for i, cut in enumerate(part.column(cuts_).to_pylist()):
                    for c in reversed(cut or []):
                        texts[i] = texts[i][: c["begin"]] + texts[i][c["end"] :]
                column = pa.array(texts, pa.binary()).cast(pa.string())
                if part.column("text").null_count:
                    column = pa.compute.if_else(part.column("text").is_null(), None, column)
                yield pa.RecordBatch.from_arrays([column if n == "text" else part.column(n) for n in names], names=names)

    done = wide.mapInArrow(run, docs.schema)
    done = done.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return lacking(named, ids).select(*names).unionByName(done.select(*names))
