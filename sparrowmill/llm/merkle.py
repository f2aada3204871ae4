"""Document fingerprints: Merkle trees over paragraphs and sections.

The leaves of a tree are short runs of words inside a paragraph; every other node hashes the hashes
of its children: a paragraph its leaves', a section its paragraphs', the root its sections'.  Where
runs and sections end depends on the content next to the cut alone, so an edit changes the branches
over it and no others.  A fingerprint lists the root, the section hashes and the beginnings of the
leaf hashes; equal roots mean equal texts, and trees are compared by going down differing branches.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import shuffle_partitions
from ._arrow import fields, pieces
from ._hashing import WHITE, gear
from .blocks import block_of, bounds

#: A leaf ends at one of four gaps between words; a section at one of four paragraphs.
LEAF_GAP, SECTION = 65536 // 4, 4


def node(level: bytes, children: list[bytes]) -> bytes:
    """The hash of a node from its children's hashes, all of 16 bytes; ``level`` keeps levels apart."""
    return hashlib.blake2b(b"".join(children), digest_size=16, person=level).digest()


def tree(text: str) -> tuple[str, list[str], list[int], list[bytes], np.ndarray]:
    """(root, section hashes, leaves of each section, leaf hashes, leaf ends in bytes)."""
    raw = text.encode()
    if not raw:
        return node(b"root", []).hex(), [], [], [], np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    ends = WHITE[data[:-1]] & ~WHITE[data[1:]]
    line = data[:-1] == 10
    ends &= line | (gear(data)[:-1] < LEAF_GAP)
    cut = np.append(np.flatnonzero(ends) + 1, len(data))
    digest = xxhash.xxh3_128_digest
    leaves = [digest(raw[a:b]) for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
    # a paragraph ends with the leaf before a line feed's end, a section where a paragraph's hash says so
    last = (np.flatnonzero(np.append(data[cut[:-1] - 1] == 10, True)) + 1).tolist()
    sections, counts, held, begin, opened = [], [], [], 0, 0
    for end in last:
        paragraph = node(b"paragraph", leaves[begin:end])
        held.append(paragraph)
        begin = end
        if paragraph[5] % SECTION == 0 or end == len(leaves):
            sections.append(node(b"section", held))
            counts.append(end - opened)
            held, opened = [], end
    return node(b"root", sections).hex(), [x[:6].hex() for x in sections], counts, leaves, cut


def fingerprint(text: str) -> str:
    """``root:section-leaves,section-leaves,...``; a leaf is eight hexadecimal digits."""
    root, sections, counts, leaves, _ = tree(text)
    digits, at, parts = b"".join([x[:4] for x in leaves]).hex(), 0, []
    for section, n in zip(sections, counts, strict=True):
        parts.append(f"{section}-{digits[at : at + 8 * n]}")
        at += 8 * n
    return f"{root}:{','.join(parts)}"


def likeness(a: str, b: str) -> float:
    """Shared leaves over all leaves of two fingerprints (twice the shared by the sum), 0 to 1.

    Equal roots end the comparison; equal sections count whole, and only differing sections are
    compared leaf by leaf.
    """
    if a[:32] == b[:32]:
        return 1.0
    left, right = [sections_of(x) for x in (a, b)]
    total = sum(len(x) // 8 for s in (left, right) for x, _ in s)
    if not total:
        return 0.0
    rest_left, rest_right = Counter(x for x in left), Counter(x for x in right)
    same = rest_left & rest_right
    shared = sum(len(x[0]) // 8 * n for x, n in same.items())
    one, two = [Counter(leaf for x, n in (side - same).items() for leaf in _leaves(x[0]) for _ in range(n)) for side in (rest_left, rest_right)]
    return 2 * (shared + sum((one & two).values())) / total


def sections_of(print_: str) -> list[tuple[str, str]]:
    """(leaves, section hash) of each section of a fingerprint."""
    return [(part[13:], part[:12]) for part in print_[33:].split(",") if part]


def _leaves(digits: str) -> list[str]:
    return [digits[i : i + 8] for i in range(0, len(digits), 8)]


def differing(a: str, b: str, visited: list[int] | None = None) -> Iterator[int]:
    """Numbers of the leaves of ``a`` that ``b`` lacks: the branches in which ``a`` was edited.

    Equal roots end the search, equal sections are passed over whole, and only the leaves below
    differing sections are visited, whose numbers ``visited`` gets, if given.
    """
    if a[:32] == b[:32]:
        return
    left, right = sections_of(a), sections_of(b)
    ours, theirs = (Counter(h for _, h in side) for side in (left, right))
    same, spare = ours & theirs, theirs - ours
    held: Counter = Counter()
    for digits, h in right:
        if spare[h]:
            spare[h] -= 1
            held.update(_leaves(digits))
    at = 0
    for digits, h in left:
        own = _leaves(digits)
        if same[h]:
            same[h] -= 1
        else:
            for i, leaf in enumerate(own, at):
                if visited is not None:
                    visited.append(i)
                if held[leaf]:
                    held[leaf] -= 1
                else:
                    yield i
        at += len(own)


RESULT = fields(doc_id=T.LongType(), n_chars=T.LongType(), edited_sha256=T.StringType(), fingerprint=T.StringType(), edited_fingerprint=T.StringType(), near_edited=T.DoubleType(), near_next=T.DoubleType())


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, and its likeness to an edited text and to the next document.

    The edited text has the last half of the code points replaced by the first as many of the
    next document, by ascending id; after the last comes the first.  A null text is empty; null
    ids come first; rows of equal id stand in the order of their texts, nulls first.  A single
    document is its own next.  Empty texts have a root and no leaf, and are like each other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    edges = bounds(docs)
    ids = docs.select("doc_id", block_of(edges).alias("block"))
    # the least id of each block in use, null for a block that begins with null ids
    begins = {r["block"]: (None if r["open"] else r["least"]) for r in ids.groupBy("block").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("open")).collect()}  # a row for each block
    if not begins:
        return docs.sparkSession.createDataFrame([], RESULT)
    used = sorted(begins)
    before = dict(zip(used, [used[-1], *used[:-1]], strict=True))
    count = used[-1] + 1
    least = F.array(*[F.lit(begins.get(b)).cast("long") for b in range(count)])
    previous = F.array(*[F.lit(before.get(b, 0)) for b in range(count)])
    leads = F.col("doc_id").eqNullSafe(F.get(least, F.col("block")))
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(previous, F.col("block")).alias("block"), F.lit(True).alias("guest"))
    placed = docs.withColumn("block", block_of(edges)).select("doc_id", "text", F.explode(F.when(leads, F.array(own, guest)).otherwise(F.array(own))).alias("at")).select("at.block", "at.guest", "doc_id", "text")
    dealt = placed.repartition(shuffle_partitions(docs.sparkSession), "block").sortWithinPartitions("block", "guest", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches):
        held = None  # (block, doc, text, fingerprint) of the row before
        for batch in pieces(batches, 64):  # long texts become Python's a few at a time
            rows = []
            for block, guest, doc, text in zip(*[batch.column(c).to_pylist() for c in ("block", "guest", "doc_id", "text")], strict=True):
                text = text or ""
                if held and held[0] == block:
                    mark = fingerprint(text)
                    rows.append(_row(held[1], held[2], held[3], text, mark))
                elif not guest:
                    mark = fingerprint(text)
                held = None if guest else (block, doc, text, mark)
            columns = list(zip(*rows, strict=True)) or [[]] * len(RESULT.names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=RESULT.names)

    return dealt.mapInArrow(run, RESULT)


def _row(doc: int | None, text: str, mark: str, next_text: str, next_mark: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    other = fingerprint(edited)
    return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, next_mark)
