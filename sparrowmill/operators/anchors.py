"""Fuzzy anchors: where a passage stands in a document, despite edits.

Seed and verify.  A passage with at most k edits, cut into k + s pieces, keeps s of them whole, on
diagonals (place in the text less place in the passage) that are at most k apart.  Pieces are up to
eight bytes, so that they are compared exactly as 64-bit numbers, all places of many texts at once, after
a table of hashed pieces has told most places from all of them; only where s pieces of one passage meet on near diagonals is the edit distance taken, bit-parallel.

The passages are a query set that meets all documents, in blocks of bounded size: every block is
broadcast, and documents stay where they are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import alignment
from ..scratch import spread
from . import text

#: Characters of all passages of a block, about.
BLOCK = 1 << 21
#: Bytes of a piece at most and, where the number of edits lets them be, at least; whole pieces asked for at most.
LONGEST, SHORTEST, ASKED = 8, 6, 8
#: Characters of the texts that are scanned as one, about; slots for each piece of a block, at least.
STRETCH, SPARSE = 1 << 17, 16


def pieces(size: int, errors: int) -> tuple[int, int, int]:
    """(number of pieces, their length, how many of them stay whole) of a passage."""
    whole = max(1, min(ASKED, size // SHORTEST - errors))
    return errors + whole, size // (errors + whole), whole


def runs(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, with zeros beyond the end."""
    padded = np.concatenate((data, np.zeros(LONGEST, np.uint8)))
    return np.ndarray(len(data), "<u8", padded, strides=(1,)).copy()


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """A number of so many bits for each key; most keys that differ have others."""
    return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).view(np.int64)


class Seeds:
    """The pieces of a block of passages, by length."""

    def __init__(self, passages: list[str], errors: list[int]):
        self.passages, self.errors = passages, np.array(errors, np.int64)
        self.size = np.array([len(p) for p in passages], np.int64)
        self.whole = np.ones(len(passages), np.int64)
        by: dict[int, list[tuple[int, int, int]]] = {}
        for i, (passage, k) in enumerate(zip(passages, errors)):
            number, length, self.whole[i] = pieces(len(passage), k)
            used = min(length, LONGEST)
            data = passage.encode()
            for at in range(0, number * length, length):
                by.setdefault(used, []).append((int.from_bytes(data[at : at + used], "little"), i, at))
        self.by = {}
        for used, found in by.items():
            found.sort()
            keys = np.array([f[0] for f in found], np.uint64)
            bits = (SPARSE * len(keys)).bit_length()
            there = np.zeros(1 << bits, bool)  # few places of a text get past it to the exact search
            there[slots(keys, bits)] = True
            self.by[used] = keys, np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], np.int64), bits, there

    def regions(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, passage, begin, end) of the parts of texts that may hold a passage; the texts are scanned as one."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        wide = runs(np.frombuffer(b"".join(texts), np.uint8))
        what, who, diagonal = [], [], []
        for used, (keys, passage, offset, bits, there) in self.by.items():
            own = wide & np.uint64((1 << 8 * used) - 1)
            place = np.flatnonzero(there[slots(own, bits)])
            text = np.searchsorted(ends, place, "right")
            inside = place + used <= ends[text]  # no piece lies in two texts
            place, text = place[inside], text[inside]
            own = own[place]
            low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            n = high - low
            seed = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            what.append(np.repeat(text, n)), who.append(passage[seed]), diagonal.append(np.repeat(place, n) - offset[seed])
        if not who:
            return []
        t, i, d = np.concatenate(what), np.concatenate(who), np.concatenate(diagonal)
        order = np.lexsort((d, i, t))
        t, i, d = t[order], i[order], d[order]
        other = np.arange(len(i)) + self.whole[i] - 1
        inside = np.minimum(other, len(i) - 1)
        near = (other < len(i)) & (t[inside] == t) & (i[inside] == i) & (d[inside] - d <= self.errors[i])
        t, i, d = t[near], i[near], d[near]
        d -= (ends - sizes)[t]
        out: list[tuple[int, int, int, int]] = []
        for text, passage, begin, end in zip(t.tolist(), i.tolist(), (d - self.errors[i]).tolist(), (d + self.size[i] + 2 * self.errors[i]).tolist()):
            if out and out[-1][:2] == (text, passage) and begin <= out[-1][3]:
                out[-1] = (text, passage, out[-1][2], max(end, out[-1][3]))
            else:
                out.append((text, passage, begin, end))
        return out

    def found(self, documents: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, passage, distance, begin, end) of the best occurrence of every passage that each text has."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, begin, end in self.regions([d.encode() for d in documents]):
            begin = max(0, begin)
            distance, b, e = alignment.best(self.passages[i], documents[t][begin:end])
            if distance <= self.errors[i] and ((t, i) not in best or (distance, begin + e) < (best[t, i][0], best[t, i][2])):
                best[t, i] = distance, begin + b, begin + e
        return [(*at, *x) for at, x in sorted(best.items())]


def stretches(texts: Iterable[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of neighbouring texts that hold about ``STRETCH`` characters together."""
    first, held, size = 0, [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= STRETCH:
            yield first, held
            first, held, size = first + len(held), [], 0
    if held:
        yield first, held


def located(docs: DataFrame, anchors: DataFrame, most: float = 0.1, form: Column | None = None, doc_id: str = "doc_id", anchor_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, distance, begin, end) of each anchor's best occurrence in each document that has it.

    Texts are compared in the form of :func:`text.folded_words`, places are counted in it.  An occurrence
    has at most ``most`` edits a character of the anchor, rounded down; the best has the fewest, then
    ends first, then is the shortest.  Each row of ``docs`` and of ``anchors`` is taken by itself; null
    and empty texts hold nothing and are nowhere.
    """
    form = text.folded_words(F.col("text")) if form is None else form
    asked = anchors.select(F.col(anchor_id), form.alias("__form")).where("__form <> ''")
    sizes = asked.agg(F.sum(F.length("__form"))).first()[0] or 0
    blocks = -(-sizes // BLOCK)
    kind = anchors.schema[anchor_id].dataType.simpleString()
    own = spread(docs, doc_id).select(F.col(doc_id), form.alias("__form"))  # a filter on the form would have it made twice
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {anchor_id} {kind}, distance int, begin int, end int"
    out = own.sparkSession.createDataFrame([], schema)
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("__form"), F.lit(blocks)) == block)
        rows = [(r[anchor_id], r["__form"]) for r in part.toLocalIterator()]  # a block's size is bounded
        shared = own.sparkSession.sparkContext.broadcast(([r[0] for r in rows], Seeds([r[1] for r in rows], [int(len(r[1]) * most) for r in rows])))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, seeds = shared.value
            for batch in batches:
                own = batch[doc_id].array
                found = [(own[first + t], ids[a], d, b, e) for first, texts in stretches("" if t is None else t for t in batch["__form"]) for t, a, d, b, e in seeds.found(texts)]
                yield pd.DataFrame(found, columns=[doc_id, anchor_id, "distance", "begin", "end"])

        out = out.unionByName(own.mapInPandas(search, schema))
    return out
