"""Exact Jaccard self-join of word-shingle sets, by partitioning the universe.

Two sets of s <= r elements with Jaccard similarity at least 0.8 differ in at most (s + r) / 9
elements.  Sizes fall into bands so that a partner is in the same band or the next.  In the space
of a band, elements are hashed into segments; K differences spoil at most K segments.  A set gives
its segments weights that add up to K + 1 or more: 0, 1 (the segment's subset must be equal) or 2
(equal, or equal after one deletion on one side); then some weighted segment of it meets any partner.

Equal sets are one class from the start.  On the finest partition, every element its own segment,
sets that have too many elements to themselves are without links and go.  The others are indexed
by their segments' subsets, and measured bucket sizes decide the weights: a set spends its spare
segments on its most crowded subsets.  Sets that still need crowded ones are indexed again, with
one-deletion neighbourhoods, and choose the cheapest weights.  What crowded subsets they still need
admits two kinds of links only: between sets whose common elements alone can make up the
similarity, and between sets that share a rare element, so those are indexed too.

Links are found in two rounds: every set meets the leaders of its buckets, which joins groups of
copies at the cost of a few rows each; then come the pairs of different components that share a
bucket.  Every pair is verified on its words.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..scratch import discard, release, shuffle_partitions, written
from ._arrow import fields, pieces, text_slices
from ._hashing import LOWER, U, joined, mix, range_hashes, word_ranges
from .components import components
from .element_counts import counted
from .id_filter import having

WORDS = 5
_PLACE = mix(np.arange(1, WORDS + 1, dtype=np.uint64), 21) | U(1)
#: Share of segments, on top of one more than the differences, that a set may leave out.
SPARE = 0.35
#: Buckets, and elements, of more sets than this are crowded; smaller ones are met pair by pair.
CROWD = 32
#: Leaders that a set meets in the first round, those of most of its buckets first.
LEADERS = 4
#: Pairs of one set that a task verifies against it at most in one go; sets with more are dealt out.
PAIRS_A_CHUNK = 256


# sets

def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    data, text_begin = joined(texts)
    data = LOWER[data]
    begin, end = word_ranges(data)
    words = range_hashes(data, begin, end)
    first = np.searchsorted(begin, text_begin).tolist()
    out = []
    with np.errstate(over="ignore"):
        most = max(0, len(words) - WORDS + 1)
        rolled = sum((words[i : i + most] * _PLACE[i] for i in range(WORDS)), np.zeros(most, np.uint64))
        rolled = mix(rolled, 22)
        for a, b in zip(first, first[1:]):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True), 30 + b - a))
            else:
                out.append(words[:0])
    return out


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two independent 64-bit keys of sets; an empty set has keys 0."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    keys = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full.tolist()])
        begin = np.cumsum(sizes[full]) - sizes[full]
        with np.errstate(over="ignore"):
            for k in (0, 1):
                keys[k, full] = mix(np.add.reduceat(mix(flat, 41 + k), begin) + sizes[full].astype(np.uint64), 43)
    return sizes, keys[0].view(np.int64), keys[1].view(np.int64)


# bands and allotment

@lru_cache(1)
def band_begins() -> np.ndarray:
    """Least size of each band: a partner of a set is in its band or the next."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, 5 * (out[-1] - 1) // 4 + 1))
    return np.array(out)


def most_differences(band: int) -> int:
    """Differences of a set of this band and a partner of its band or the next, at most."""
    largest = int(band_begins()[band + 1]) - 1
    return (largest + 5 * largest // 4) // 9


def segments(band: int) -> int:
    """Segments of a band's space; none where no link has a difference."""
    most = most_differences(band)
    return most + 1 + math.ceil((most + 1) * SPARE) if most else 0


def signatures(sets: list[np.ndarray], neighbours: bool) -> tuple[np.ndarray, ...]:
    """(signature, set, space, segment, kind) of sets in the spaces of their band and the one below.

    Kind 0 is a segment's whole subset; with ``neighbours`` kind 1 is the subset without one of its
    elements.  Both hash space, segment and subset alike, so they can be equal.
    """
    bands = np.searchsorted(band_begins(), [len(s) for s in sets], side="right") - 1
    at = [(i, space) for i, band in enumerate(bands.tolist()) for space in (band, band - 1) if space >= 0 and segments(space)]
    if not at:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int32, np.int32, np.int32))
    parts, spaces = (np.array(x) for x in zip(*at, strict=True))
    count = np.array([segments(x) for x in spaces.tolist()])
    offset = np.cumsum(count) - count
    flat = np.concatenate([sets[i] for i in parts.tolist()])
    part = np.repeat(np.arange(len(parts)), [len(sets[i]) for i in parts.tolist()])
    with np.errstate(over="ignore"):
        segment = (mix(flat ^ mix(spaces.astype(np.uint64), 51)[part]) >> U(11)).astype(np.int64) % count[part]
        group = offset[part] + segment
        value = mix(flat, 52)
        total = int(count.sum())
        # sums of halves stay exact in doubles
        low = np.bincount(group, (value & U(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
        high = np.bincount(group, (value >> U(32)).astype(float), total).astype(np.uint64)
        sums = low + (high << U(32))
        owner = np.repeat(np.arange(len(parts)), count)
        number = np.arange(total) - offset[owner]
        tag = mix((spaces[owner] << 40 | number).astype(np.uint64), 53)
        out = [mix(sums ^ tag).view(np.int64), parts[owner], spaces[owner].astype(np.int32), number.astype(np.int32), np.zeros(total, np.int32)]
        if neighbours:
            less = [mix((sums[group] - value) ^ tag[group]).view(np.int64), parts[part], spaces[part].astype(np.int32), segment.astype(np.int32), np.ones(len(flat), np.int32)]
            out = [np.concatenate(x) for x in zip(out, less, strict=True)]
    return tuple(out)


def weights(own: np.ndarray, two: np.ndarray, need: int) -> np.ndarray:
    """Weights 0, 1 or 2 of segments that add up to at least ``need``, at little cost.

    ``own`` is what weight 1 costs and ``two`` what weight 2 costs, in rows met.  The cheapest
    segments get weight 1; then, as long as it pays, one gets weight 2 in place of the dearest.
    """
    order = np.argsort(own, kind="stable")
    out = np.zeros(len(own), np.int64)
    chosen = order[:need]
    out[chosen] = 1
    dear = chosen[::-1].tolist()
    for up in chosen[np.argsort((two - own)[chosen], kind="stable")].tolist():
        if out[up] != 1:
            continue
        while dear and out[dear[0]] != 1:
            dear.pop(0)
        if dear and dear[0] == up:
            continue
        if not dear or own[dear[0]] <= two[up] - own[up]:
            break
        out[dear.pop(0)] = 0
        out[up] = 2
    return out


def sketches(sets: list[np.ndarray], below: int) -> list[bytes]:
    """One byte for each segment of a fixed partition in the space of a set's band, or the one below.

    Two sets differ in at least as many elements as their bytes in the same space differ, so a
    pair with more differing bytes than a link allows is no link.
    """
    spaces = np.searchsorted(band_begins(), [len(s) for s in sets], side="right") - 1 - below
    count = np.array([2 * (most_differences(b) + 1) if b >= 0 and len(s) else 0 for b, s in zip(spaces.tolist(), sets, strict=True)], np.int64)
    sizes = np.array([len(s) if c else 0 for s, c in zip(sets, count.tolist(), strict=True)], np.int64)
    if not sizes.sum():
        return [b""] * len(sets)
    flat = np.concatenate([s for s, c in zip(sets, count.tolist(), strict=True) if c])
    part = np.repeat(np.arange(len(sets)), sizes)
    offset = np.cumsum(count) - count
    segment = (mix(flat ^ mix(spaces.clip(0).astype(np.uint64), 61)[part]) >> U(11)).astype(np.int64) % count[part]
    sums = np.bincount(offset[part] + segment, (mix(flat, 62) & U(0xFF)).astype(float), int(count.sum()))
    data = (sums % 256).astype(np.uint8).tobytes()
    return [data[a : a + n] for a, n in zip(offset.tolist(), count.tolist(), strict=True)]


class Sets:
    """What :func:`counted` needs to know of sets."""

    sets = staticmethod(shingle_sets)
    keys = staticmethod(set_keys)


# verification

def _words(text: str) -> list[str]:
    """Words as the contract takes them: runs of other than 0x20 and 0x09-0x0D, A-Z in small form."""
    small = text.translate(_SMALL)
    return [w for w in small.translate(_WHITE).split(" ") if w]


_SMALL = {c: c + 32 for c in range(65, 91)}
_WHITE = {c: 32 for c in range(9, 14)}


def word_shingles(text: str) -> set[tuple[str, ...]]:
    """The set of a text as the contract takes it: shingles, or all words if they are too few; empty if none."""
    words = _words(text)
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(WORDS)]))


def linked(a: set, b: set) -> bool:
    """Whether two sets share at least 80 of 100 of all their elements; empty sets never do."""
    both = len(a & b)
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


LINKS = fields(u=T.LongType(), v=T.LongType())


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose texts' shingles link, held word by word.

    Partners of u stream past it, in chunks if they are many, so that no task holds more than
    the two sets at hand.  ``texts`` has a row (node, text) for each node.
    """
    sizes = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS_A_CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "u").withColumn("chunk", F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int"))
    heads = dealt.select("u", "chunk").distinct().join(texts.select(F.col("node").alias("u"), "text"), "u").select("u", "chunk", F.lit(None).cast("long").alias("v"), "text")
    rest = dealt.select("u", "v", "chunk").join(texts.select(F.col("node").alias("v"), "text"), "v").select("u", "chunk", "v", "text")
    stream = heads.union(rest).repartition(shuffle_partitions(pairs.sparkSession), "u", "chunk").sortWithinPartitions("u", "chunk", F.col("v").asc_nulls_first())

    def run(batches):
        own: set = set()
        for batch in pieces(batches):
            us, vs = [], []
            for u, v, text in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if v is None:
                    own = word_shingles(text)
                elif linked(own, word_shingles(text)):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=LINKS.names)

    return stream.mapInArrow(run, LINKS)


DRAWN = fields(node=T.LongType(), n=T.LongType(), band=T.IntegerType(), own=T.BinaryType(), low=T.BinaryType())


def drawn(texts: DataFrame) -> DataFrame:
    """Per node its size and band, and its sketches in the spaces of that band and the one below."""

    def run(batches):
        for batch in batches:
            for part, held in text_slices(batch):
                sets = shingle_sets(held)
                bands = (np.searchsorted(band_begins(), [len(s) for s in sets], side="right") - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(bands), pa.array(sketches(sets, 0), pa.binary()), pa.array(sketches(sets, 1), pa.binary())], names=DRAWN.names)

    return texts.select("node", "text").mapInArrow(run, DRAWN)


def possible(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) whose sketches don't rule a link out."""
    side = lambda x: sketched.select(F.col("node").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("band", "n", "own", "low")])
    both = pairs.distinct().join(side("u"), "u").join(side("v"), "v").where("abs(u_band - v_band) <= 1").withColumn("most", F.floor((F.col("u_n") + F.col("v_n")) / 9))
    a = F.when(F.col("u_band") <= F.col("v_band"), F.col("u_own")).otherwise(F.col("u_low"))
    b = F.when(F.col("v_band") <= F.col("u_band"), F.col("v_own")).otherwise(F.col("v_low"))

    def run(batches):
        for batch in pieces(batches, 2048):
            keep = [x is not None and int(np.count_nonzero(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))) <= most for x, y, most in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "most")], strict=True)]
            yield batch.select(LINKS.names).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "most", a.alias("a"), b.alias("b")).mapInArrow(run, LINKS)


# the join

MET = fields(sig=T.LongType(), node=T.LongType(), space=T.IntegerType(), segment=T.IntegerType(), kind=T.IntegerType())
#: Kinds of index rows: a segment's subset, a subset without one element, a rare element.
WHOLE, LESS, ELEMENT = 0, 1, 2


def indexed(texts: DataFrame, neighbours: bool) -> DataFrame:
    """Index rows of sets; with ``neighbours`` also those of kind ``LESS`` and ``ELEMENT``."""

    def run(batches):
        for batch in batches:
            for part, held in text_slices(batch, 1 << 18):
                sets, nodes = shingle_sets(held), part.column("node").to_numpy()
                sig, at, space, segment, kind = signatures(sets, neighbours)
                if neighbours:
                    flat = np.concatenate(sets)
                    more = len(flat)
                    sig = np.concatenate([sig, mix(flat, 54).view(np.int64)])
                    at = np.concatenate([at, np.repeat(np.arange(len(sets)), [len(s) for s in sets])])
                    space, segment, kind = (np.concatenate([x, np.full(more, y, np.int32)]) for x, y in ((space, -1), (segment, -1), (kind, ELEMENT)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (sig, nodes[at], space, segment, kind)], names=MET.names)

    return texts.select("node", "text").mapInArrow(run, MET)


def most_of(n: str, space: str) -> Column:
    """Differences of a set of ``n`` elements and a partner of it in a space, at most."""
    begins = band_begins()
    above = F.array(*[F.lit(int(x)) for x in begins[1:]])[F.col(space)]
    size = F.col(n)
    return F.when(size >= above, F.floor((size + above - 1) / 9)).otherwise(F.floor((size + F.floor(5 * size / 4)) / 9))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with the numbers of whole and of lessened subsets in their bucket; lone rows go.

    Buckets are counted before the shuffle and joined, not gathered, so a hot one can be split.
    """
    sizes = rows.groupBy("sig").agg(F.sum((F.col("kind") != LESS).cast("int")).alias("whole"), F.sum((F.col("kind") == LESS).cast("int")).alias("less")).where("whole + less > 1 and whole > 0")
    return rows.join(sizes, "sig")


def first_index(sets: DataFrame) -> DataFrame:
    """Shared subsets of sets, ``asks``: whether the set needs the bucket, being among its least crowded."""
    shared = _counted(indexed(sets, False)).join(sets.select("node", "n"), "node")
    by_set = shared.withColumn("skip", F.expr("element_at({table}, space + 1)".format(table="array(" + ",".join(str(segments(b)) for b in range(_bands())) + ")")) - 1 - most_of("n", "space"))
    gathered = by_set.groupBy("node", "space", "n").agg(F.max("skip").alias("skip"), F.array_sort(F.collect_list(F.struct("whole", "sig"))).alias("each")).where(F.size("each") > F.col("skip"))
    ranked = gathered.select("node", "space", "n", "skip", F.size("each").alias("__size"), F.posexplode("each").alias("place", "x"))
    return ranked.select("node", "n", F.col("x.sig").alias("sig"), F.lit(WHOLE).alias("kind"), F.col("x.whole").alias("crowd"), (F.col("place") < F.col("__size") - F.col("skip")).cast("int").alias("asks"))


def second_index(sets: DataFrame) -> DataFrame:
    """The index of crowded sets: subsets, one-deletion neighbourhoods and rare elements.

    ``asks`` is the weight that :func:`weights` gives a row's segment, by the buckets' measured
    sizes.  Sets that must still ask crowded buckets ask for their rare elements as well.
    """
    rows = written(_counted(indexed(sets, True)).where(f"kind <> {ELEMENT} or whole <= {CROWD}"), "second")
    met = F.when(F.col("kind") == LESS, F.col("whole")).otherwise(F.col("whole") - 1 + F.col("less"))
    costs = rows.where(f"kind <> {ELEMENT}").groupBy("node", "space", "segment").agg(F.sum(F.when(F.col("kind") == WHOLE, F.col("whole") - 1).otherwise(0)).alias("own"), F.sum(met).alias("two"))
    each = costs.groupBy("node", "space").agg(F.collect_list(F.struct("segment", "own", "two")).alias("each")).join(sets.select("node", "n"), "node").withColumn("most", most_of("n", "space"))
    kind = fields(node=T.LongType(), space=T.IntegerType(), segment=T.IntegerType(), weight=T.IntegerType())

    def run(batches):
        for batch in pieces(batches):
            at, values = batch.column("each").offsets.to_numpy(), batch.column("each").values
            part, one, both = (values.field(i).to_numpy() for i in range(3))
            out = [[np.zeros(0, np.int64)] for _ in range(4)]
            for k, (node, space, most) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("node", "space", "most")], strict=True)):
                count, held = segments(space), slice(at[k], at[k + 1])
                own, two = np.zeros(count, np.int64), np.zeros(count, np.int64)
                own[part[held]], two[part[held]] = one[held], both[held]  # segments that no other set shares cost nothing
                weight = weights(own, two, most + 1)[part[held]]
                chosen = part[held][weight > 0]
                for x, y in zip(out, (np.full(len(chosen), node), np.full(len(chosen), space), chosen, weight[weight > 0]), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(out, (np.int64, np.int32, np.int32, np.int32), strict=True)], names=kind.names)

    chosen = each.select("node", "space", "each", "most").mapInArrow(run, kind)
    asked = rows.where(f"kind <> {ELEMENT}").join(chosen, ["node", "space", "segment"], "left").withColumn("asks", F.when((F.col("kind") == WHOLE) | (F.col("weight") == 2), F.coalesce("weight", F.lit(0))).otherwise(0))
    asked = written(asked.select("sig", "node", "kind", (F.col("whole") + F.col("less")).alias("crowd"), "asks"), "asked")
    still = asked.where(f"asks > 0 and crowd > {CROWD}").select("node").distinct().withColumn("asks", F.lit(1))
    rare = rows.where(f"kind = {ELEMENT}").join(still, "node", "left").select("sig", "node", "kind", F.col("whole").alias("crowd"), F.coalesce("asks", F.lit(0)).alias("asks"))
    every = written(asked.unionByName(rare).join(sets.select("node", "n"), "node"), "index2")
    discard(rows, asked)
    return every


def _bands() -> int:
    return int(np.searchsorted(band_begins(), 1 << 30))


def similarity_groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Null and empty texts, and texts of white space, have no shingle and are linked with nothing.
    Rows that repeat an id count each by its own text.  A row with a null id can link others; the
    component of texts that only null ids have is null.  Empty input gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    rows = written(counted(docs, Sets, 1), "rows")
    holder = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash"))
    classes = rows.where("n > 0").groupBy("key", "key2").agg(holder.alias("x"), F.first("n").alias("n"), F.min("unique").alias("unique"), F.count("*").alias("times"))
    classes = written(classes.select("key", "key2", F.col("x.id").alias("doc_id"), F.col("x.text_hash").alias("text_hash"), "n", F.when(F.col("times") > 1, 0).otherwise(F.col("unique")).alias("unique")), "classes")
    release(spark)
    chosen = classes.where("5 * unique <= n").select("doc_id", "text_hash", "key", "key2")
    texts = written(_with_text(chosen, docs).withColumn("node", F.monotonically_increasing_id()), "texts")
    sizes = counted(texts.withColumn("text_hash", F.lit(0).cast("long")), Sets, CROWD, "node").where("5 * unique <= n")
    sizes = written(sizes.select(F.col("id").alias("node"), F.col("n").cast("int").alias("n"), F.col("common").cast("int").alias("f")), "sizes")
    sets = written(texts.select("node", "text", "key", "key2", "doc_id").join(sizes, "node"), "sets")
    discard(texts, sizes)
    release(spark)
    roots = _roots(sets)
    by_class = sets.select("node", "key", "key2", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = by_class.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = written(by_class.join(least, "root").select("key", "key2", "component"), "components")
    own = classes.select("key", "key2", "doc_id").join(named, ["key", "key2"], "left").select("key", "key2", F.coalesce("component", "doc_id").alias("component"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    result = written(rows.join(own, ["key", "key2"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")), "groups")
    discard(rows, classes, sets, named, roots)
    release(spark)
    return result


def _with_text(held: DataFrame, docs: DataFrame) -> DataFrame:
    """``held`` (doc_id, text_hash and more; distinct) with the text of its row."""
    ids = held.where("doc_id is not null").select("doc_id").distinct()
    named = held.join(having(docs.where("doc_id is not null"), ids), ["doc_id", "text_hash"])
    unnamed = held.where("doc_id is null").join(docs.where("doc_id is null").drop("doc_id"), "text_hash")
    return named.unionByName(unnamed.select(*named.columns)).dropDuplicates(["key", "key2"])


def _roots(sets: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every set that has a link."""
    spark = sets.sparkSession
    sketched = written(drawn(sets), "sketches")
    first = written(first_index(sets), "first")
    crowded = first.where(f"asks > 0 and crowd > {CROWD}").select("node").distinct()
    second = second_index(having(sets.withColumn("doc_id", F.col("node")), crowded.withColumnRenamed("node", "doc_id")))
    release(spark)
    index = first.where(f"crowd <= {CROWD}").select("sig", "node", "n", "kind", "crowd", "asks").unionByName(second.select("sig", "node", "n", "kind", "crowd", "asks"))
    index = written(index.join(sets.select("node", "f"), "node").withColumn("big", (F.col("crowd") > CROWD) & (F.col("kind") != ELEMENT)).where("not big or 5 * f >= 4 * n"), "index")
    discard(first, second)

    leads = index.where(f"kind <> {LESS}").groupBy("sig").agg(F.min(F.struct((F.col("n") - F.col("f")).alias("rare"), F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("f").alias("f_v"))).alias("lead"))
    led = index.join(leads.select("sig", "lead.*"), "sig").where(F.col("node") != F.col("v")).where(_fit("n", "f", "n_v", "f_v", "big"))
    often = led.groupBy("node", "v").agg(F.count("*").alias("times")).groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("times")).alias("less"), "v"))), 1, LEADERS).alias("best"))
    met = often.select("node", F.explode("best.v").alias("v"))
    near = written(possible(met.select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")), sketched), "near")
    links = written(verify(near, sets), "links")
    stars = written(components(links), "stars")
    discard(near, links)
    release(spark)

    labelled = written(index.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")
    discard(index)
    mixed = labelled.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("asks").alias("any")).where("low <> high and any > 0").select("sig")
    apart = written(labelled.join(mixed, "sig"), "apart")
    a, b = apart.where("asks > 0").alias("a"), apart.alias("b")
    kinds = ((F.col("a.kind") == F.col("b.kind")) & (F.col("a.kind") != LESS)) | ((F.col("a.asks") == 2) & (F.col("a.kind") != F.col("b.kind")))
    once = (F.col("b.asks") == 0) | (F.col("a.node") < F.col("b.node")) | (F.col("a.kind") != F.col("b.kind"))
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.root") != F.col("b.root")) & kinds & once & _fit("a.n", "a.f", "b.n", "b.f", "a.big"))
    rest = written(possible(pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")), sketched), "rest")
    more = written(verify(rest, sets), "more")
    discard(labelled, apart, rest, sketched)
    release(spark)
    if more.isEmpty():
        return stars
    roots = written(components(stars.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)), "roots")
    discard(stars, more)
    return roots


def _fit(n: str, f: str, m: str, g: str, big: str) -> Column:
    """Whether sizes allow a link, and in crowded buckets common elements alone.

    Sets that share no rare element have at most the lesser number of common elements in common;
    those that share one meet in its bucket.
    """
    n, f, m, g = (F.col(x) for x in (n, f, m, g))
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (~F.col(big) | ((9 * f >= 4 * (n + m)) & (9 * g >= 4 * (n + m))))
