"""For each of many sets: how many of its elements no other set has, and how many are common.

Sets are dealt in chunks.  A chunk sends its elements, sorted and coded as differences, to ranges of
the hash space, a blob for each chunk and range; a range sees every occurrence of its elements and
answers each chunk with counts by set; the chunk's answers are added up.  So an element costs some
four bytes of shuffle and no row of its own.  An element that is common inside a chunk is sent once,
so a range gets at most ``common`` entries and a mark of it from a chunk, however hot it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import shuffle_partitions
from ._arrow import fields, text_slices

#: Elements and sets of a chunk, about; sets are numbered in 16 bits, the last number marks.
ELEMENTS, SETS = 1 << 19, 60_000
MARK = 0xFFFF
#: Ranges of the hash space for each shuffle partition.
RANGES = 4

SENT = fields(part=T.IntegerType(), chunk=T.LongType(), blob=T.BinaryType())
COUNTED = fields(id=T.LongType(), text_hash=T.LongType(), n=T.LongType(), key=T.LongType(), key2=T.LongType(), unique=T.LongType(), common=T.LongType())


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, each laid out byte plane by byte plane."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    head = np.array([len(raw), *(len(a) for a in arrays)], np.int64).tobytes()
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of :func:`packed`, of the given kinds."""
    head = np.frombuffer(blob, np.int64, 1 + len(kinds))
    raw = np.frombuffer(pa.decompress(blob[head.nbytes :], int(head[0]), codec="zstd", asbytes=True), np.uint8) if head[0] else np.zeros(0, np.uint8)
    out, at = [], 0
    for n, kind in zip(head[1:].tolist(), kinds, strict=True):
        size = n * np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(-1, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += size
    return out


def entries(sets: list[np.ndarray], parts: int, common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(range, value, set) of a chunk's entries in order, and each set's elements that are common in the chunk."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(sets)), sizes)
    part = ((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    place = part << np.uint64(32) | flat & np.uint64(0xFFFFFFFF)
    order = np.argsort(place, kind="stable")
    place, own = place[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(place)))
    often = np.repeat(times > common, times)
    known = np.bincount(own[often], minlength=len(sets))
    own = own.astype(np.uint16)
    own[often] = MARK
    stays = ~often
    stays[first] = True
    return (place[stays] >> np.uint64(32)).astype(np.int64), place[stays].astype(np.uint32), own[stays], known


def _scatter(hashed: Callable, common: int, parts: int, name: str):
    def run(batches):
        made = 0
        held: list[tuple] = []  # (id, text hash, set)
        size = 0

        def flush():
            nonlocal made, size
            chunk = TaskContext.get().partitionId() << 28 | made
            made, size = made + 1, 0
            sets = [h[2] for h in held]
            part, value, own, known = entries(sets, parts, common)
            n, key, key2 = hashed.keys(sets)
            ids, nulls, texts = [np.array(x, np.int64) for x in ([h[0] or 0 for h in held], [h[0] is None for h in held], [h[1] for h in held])]
            rows = [(chunk % parts, chunk, b"\0" + packed(ids, nulls.astype(np.uint8), texts, n, key, key2, known.astype(np.int64)))]
            used = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
            for a, b in zip(used.tolist(), np.append(used[1:], len(part))[: len(used)].tolist(), strict=True):
                rows.append((int(part[a]), chunk, b"\1" + packed(np.diff(value[a:b], prepend=np.uint32(0)), own[a:b])))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=SENT.names)

        for batch in batches:
            for part, texts in text_slices(batch):
                for i, text_hash, s in zip(part.column(name).to_pylist(), part.column("text_hash").to_pylist(), hashed.sets(texts), strict=True):
                    held.append((i, text_hash, s))
                    size += len(s)
                    if size >= ELEMENTS or len(held) >= SETS:
                        yield flush()
        if held:
            yield flush()

    return run


def _answer(common: int):
    """Counts by chunk and set of a range's elements; blobs of the chunks' own pass."""

    def counts(blobs: list[tuple[int, bytes]]):
        each = [unpacked(b, np.uint32, np.uint16) for _, b in blobs]
        values = np.concatenate([np.cumsum(v, dtype=np.uint32) for v, _ in each])
        own = np.concatenate([o for _, o in each])
        order = np.argsort(values, kind="stable")
        sorted_ = values[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        weight = np.where(own == MARK, common + 1, 1)[order]
        times = np.add.reduceat(weight, first)
        of = np.empty(len(values), np.int64)
        of[order] = np.repeat(times, np.diff(np.append(first, len(values))))
        at, rows = 0, []
        for (chunk, _), (v, o) in zip(blobs, each, strict=True):
            df, real = of[at : at + len(v)], o != MARK
            at += len(v)
            alone = np.bincount(o[real & (df == 1)]).astype(np.uint32)
            often = np.bincount(o[real & (df > common)]).astype(np.uint32)
            rows.append((chunk, b"\1" + packed(alone, often)))
        return rows

    def run(batches):
        part, blobs = None, []
        for batch in batches:
            rows = []
            for p, chunk, blob in zip(*[batch.column(c).to_pylist() for c in SENT.names], strict=True):
                if p != part and blobs:
                    rows += counts(blobs)
                    blobs = []
                part = p
                if blob[:1] == b"\0":
                    rows.append((chunk, blob))
                else:
                    blobs.append((chunk, blob[1:]))
            yield _rows(rows)
        if blobs:
            yield _rows(counts(blobs))

    return run


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "blob"])


def _gather(batches):
    """A chunk's own blob comes first, then the answers to it."""
    sums, own = None, None

    def done():
        ids, nulls, texts, n, key, key2, _ = own
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls.astype(bool)), *[pa.array(x) for x in (texts, n, key, key2, sums[0], sums[1])]], names=COUNTED.names)

    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            if blob[:1] == b"\0":
                if own is not None:
                    yield done()
                own = unpacked(blob[1:], np.int64, np.uint8, *[np.int64] * 5)
                sums = [np.zeros(len(own[0]), np.int64), own[6].copy()]
            else:
                for total, more in zip(sums, unpacked(blob[1:], np.uint32, np.uint32), strict=True):
                    total[: len(more)] += more
    if own is not None:
        yield done()


def counted(docs: DataFrame, hashed: Callable, common: int, name: str = "doc_id") -> DataFrame:
    """Per row of ``docs`` (``name``, text, text_hash): its set's size and keys, ``unique``, the elements
    that no other row's set has, and ``common``, those in the sets of more than ``common`` rows.

    ``hashed.sets(texts)`` gives the sets as arrays of distinct 64-bit hashes, ``hashed.keys(sets)`` their
    sizes and two keys.  Hashes that fall together may count as one element, so ``unique`` may be
    too small and ``common`` too large, never the other way.
    """
    tasks = shuffle_partitions(docs.sparkSession)
    parts = RANGES * tasks
    sent = docs.select(name, "text_hash", "text").mapInArrow(_scatter(hashed, common, parts, name), SENT)
    answered = sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_answer(common), fields(chunk=T.LongType(), blob=T.BinaryType()))
    # adding up is little work: Spark may fold small partitions, so fewer files are written
    return answered.repartition("chunk").sortWithinPartitions("chunk", F.substring("blob", 1, 1)).mapInArrow(_gather, COUNTED)
