"""At what rank BM25 gives a question the document that it should find.

That rank is one more than the documents that come before the sought one, so nobody needs a list of the best.
The score to beat is worked out first, from the sought documents alone.  Then blocks of documents meet the
questions, many at a time, and tell how many of theirs beat it.  What can't beat it by what its terms add at
most is left as soon as that is certain; the counts are those of full scores.

On disk are postings, not words: packets of documents with each term once, and with small numbers for
documents and counts.  What is shuffled are the packets, once, the questions of each block, and a row for a
question and a block that has anything better.  The work still grows with questions times documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import discard, release, written
from .pruned import DOCUMENTS_A_BLOCK, EQUAL, WORDS_A_BLOCK
from .retrieval import B, K1

#: Words and documents of a packet at most, about; a block is a few packets.
WORDS_A_PACKET, DOCUMENTS_A_PACKET = 1_000_000, 21_845
#: Questions in a row, and questions that a block meets at once.
QUESTIONS_A_ROW, QUESTIONS_AT_ONCE = 8_192, 262_144
#: Where there are so many blocks for each core, questions first meet a block for each core.
FEW_OF = 3
#: Postings that a block looks at in one go, and the bytes of its table of the commonest terms.
POSTINGS_AT_ONCE, TABLE_BYTES = 250_000, 16_000_000
#: Groups of a block's documents by the greatest share that a term has in them; bounds are by group.
GROUPS = 8
PACKET = "packet long, n long, known long, words long, ids binary, sizes binary, terms binary, begins binary, docs binary, tf binary"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (doc_id, held: hashes of words) as packets of postings; ``known`` counts those whose words are not null."""
    first, made = TaskContext.get().partitionId() << 32, 0
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held: list[np.ndarray] = []
    n = known = words = 0

    def packet() -> pa.RecordBatch:
        size, all_held = np.concatenate(sizes), np.concatenate(held)
        terms, place = np.unique(all_held, return_inverse=True)
        posted, tf = np.unique(place * n + np.repeat(np.arange(n), size), return_counts=True)
        begins = np.searchsorted(posted, np.arange(len(terms) + 1) * n)
        docs, most = posted % n, tf.max(initial=0)
        values = [first + made, n, known, words, np.concatenate(ids).tobytes(), size.astype(np.int32).tobytes(), terms.tobytes(), begins.astype(np.int32).tobytes(), docs.astype(np.uint16).tobytes(), tf.astype(np.uint8 if most < 256 else np.uint32).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] * 4 + [pa.binary()] * 6)], [c.split()[0] for c in PACKET.split(", ")])

    for batch in batches:
        names, lists = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        start = 0
        while start < len(names):
            fit = int(np.searchsorted(offsets, offsets[start] + WORDS_A_PACKET - words, "right")) - 1
            end = min(max(fit, start + 1), start + DOCUMENTS_A_PACKET - n, len(names))
            ids.append(names[start:end])
            sizes.append(np.diff(offsets[start : end + 1]).astype(np.int64))
            held.append(values[offsets[start] : offsets[end]].astype(np.int64))
            known += end - start - lists.slice(start, end - start).null_count
            n, words, start = n + end - start, words + int(offsets[end] - offsets[start]), end
            if words >= WORDS_A_PACKET or n >= DOCUMENTS_A_PACKET or start < len(names):
                yield packet()
                ids, sizes, held, n, known, words, made = [], [], [], 0, 0, 0, made + 1
    if n:
        yield packet()


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packets (terms, begins): every term and how many documents of the packet have it."""
    for batch in batches:
        for terms, begins in zip(batch.column(0), batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms.as_py(), np.int64)), pa.array(np.diff(np.frombuffer(begins.as_py(), np.int32)).astype(np.int64))], ["term", "df"])


def postings(own: pd.DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some packets' documents, in their order: where each of the ``terms`` begins, documents, counts."""
    places, docs, tf, base = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for p in own.itertuples():
        has, begins, held = np.frombuffer(p.terms, np.int64), np.frombuffer(p.begins, np.int32), np.frombuffer(p.docs, np.uint16)
        at = np.searchsorted(has, terms)
        hit = np.flatnonzero(has[np.minimum(at, len(has) - 1)] == terms) if len(has) else at[:0]
        low, many = begins[at[hit]], begins[at[hit] + 1] - begins[at[hit]]
        which = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        places.append(np.repeat(hit.astype(np.int32), many))
        docs.append(held[which].astype(np.int32) + np.int32(base))
        tf.append(np.frombuffer(p.tf, np.uint8 if len(p.tf) == len(held) else np.uint32)[which].astype(np.int32))
        base += p.n
    place = np.concatenate(places)
    begins = np.r_[0, np.cumsum(np.bincount(place, minlength=len(terms)))]
    order = np.argsort(place, kind="stable")
    return begins, np.concatenate(docs)[order], np.concatenate(tf)[order]


class Block:
    """Postings of a block, and what its terms add to documents' scores."""

    def __init__(self, begins: np.ndarray, docs: np.ndarray, tf: np.ndarray, norm: np.ndarray):
        self.begins, self.docs, self.norm = begins, docs, norm
        self.n, self.size = np.diff(begins), len(norm)
        some = np.flatnonzero(self.n)
        of_term = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)
        under = norm[docs]
        under += tf
        self.share = tf * (K1 + 1)
        self.share /= under
        del under
        greatest, most = np.zeros(self.size), np.zeros(len(self.n), np.int64)
        np.maximum.at(greatest, docs, self.share)
        if len(some):
            most[some] = np.maximum.reduceat(tf, begins[some])
        self.group = np.searchsorted(np.quantile(greatest, np.arange(1, GROUPS) / GROUPS), greatest).astype(np.int8)
        self.best = np.zeros((len(self.n), GROUPS))
        np.maximum.at(self.best.reshape(-1), of_term * GROUPS + self.group[docs], self.share)
        self.key = of_term.astype(np.int64)
        self.key *= self.size
        self.key += docs
        # the commonest terms' counts stand in a table; the others' postings are sought by key
        common = np.argsort(np.where(most < 256, -self.n, 0), kind="stable")[: TABLE_BYTES // max(self.size, 1)]
        common = common[(self.n[common] > self.size // 256) & (most[common] < 256)]
        self.row = np.full(len(self.n), -1, np.int64)
        self.row[common] = np.arange(len(common)) * self.size
        self.table = np.zeros(len(common) * self.size, np.uint8)
        for t, low, high in zip(common.tolist(), begins[common].tolist(), begins[common + 1].tolist()):
            self.table[self.row[t] + docs[low:high]] = tf[low:high]

    def shares(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The shares of terms in documents, pair by pair, 0 where a document lacks the term."""
        row, out = self.row[terms], np.zeros(len(docs))
        i = np.flatnonzero(row >= 0)
        tf = self.table[row[i] + docs[i]].astype(np.int64)
        out[i] = tf * (K1 + 1) / (tf + self.norm[docs[i]])
        i = np.flatnonzero(row < 0)
        if len(i) and len(self.key):
            wanted = terms[i] * self.size + docs[i]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            out[i] = np.where(self.key[at] == wanted, self.share[at], 0.0)
        return out


def better(block: Block, ids: np.ndarray, counts: np.ndarray, term: np.ndarray, idf: np.ndarray, score: np.ndarray, sought: np.ndarray, k: int) -> np.ndarray:
    """How many documents of a block come before the one that each question seeks, ``k`` at most.

    Question i has ``counts[i]`` entries of ``term`` and ``idf`` and seeks the document ``sought[i]``, whose
    score is ``score[i]``.  Its terms come from the rarest to the commonest; a document is met at the first
    of them that it has, and left once the rest can't bring it to the score.
    """
    of = np.repeat(np.arange(len(counts)), counts)
    above, goal, near = np.zeros(len(counts), np.int64), score - EQUAL, []
    order = np.lexsort((block.n[term], of))
    order = order[block.n[term[order]] > 0]
    if not len(order):
        return above
    of, entry_term, entry_idf = of[order], term[order], idf[order]
    most = entry_idf[:, None] * block.best[entry_term]
    firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    ends = np.r_[firsts[1:], len(of)]
    upto = np.cumsum(most, 0)
    after = np.maximum(np.repeat(np.add.reduceat(most, firsts) + (upto - most)[firsts], ends - firsts, 0) - upto, 0) + EQUAL  # what later terms add at most
    may = (most + after).max(1) >= goal[of]
    need = (goal[of][:, None] - after).reshape(-1)  # by entry and group, from here on
    for place in range(int((ends - firsts).max())):
        mine = firsts + place
        on = np.flatnonzero(mine < ends)
        on = on[may[mine[on]] & (above[of[mine[on]]] < k)]
        mine, stop = mine[on], ends[on]
        many = block.n[entry_term[mine]]
        cuts = np.r_[0, np.flatnonzero(np.diff((np.cumsum(many) - 1) // POSTINGS_AT_ONCE)) + 1, len(mine)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e, end, m = mine[a:b], stop[a:b], many[a:b]
            if not len(e):
                continue
            at = np.arange(m.sum()) + np.repeat(block.begins[entry_term[e]] - (np.cumsum(m) - m), m)
            i, doc, got, whole = np.repeat(np.arange(b - a), m), block.docs[at], np.repeat(entry_idf[e], m) * block.share[at], []
            keep = np.flatnonzero(got >= need[e[i] * GROUPS + block.group[doc]])
            i, doc, got = i[keep], doc[keep], got[keep]
            for step in range(1, int((end - e).max())):
                has = (e + step < end)[i]
                whole.append((i[~has], doc[~has], got[~has]))
                i, doc, got = i[has], doc[has], got[has]
                if not len(i):
                    break
                later = e[i] + step
                got = got + entry_idf[later] * block.shares(entry_term[later], doc)
                keep = np.flatnonzero(got >= need[later * GROUPS + block.group[doc]])
                i, doc, got = i[keep], doc[keep], got[keep]
            i, doc, got = (np.concatenate(c) for c in zip(*whole, (i, doc, got)))
            keep = np.flatnonzero(got >= goal[of[e[i]]])
            i, doc, got = i[keep], doc[keep], got[keep]
            for step in range(1, place + 1):  # documents that have a rarer term were met there
                keep = np.flatnonzero(block.shares(entry_term[e[i] - step], doc) == 0.0)
                i, doc, got = i[keep], doc[keep], got[keep]
            who = of[e[i]]
            sure = got > score[who] + EQUAL
            above += np.bincount(who[sure], minlength=len(above))
            near.append((who[~sure], doc[~sure]))
    who, doc = (np.concatenate(c) for c in zip(*near)) if near else (above[:0], above[:0])
    # scores that may be equal are added up again in the order in which the sought one's was
    begins, got = np.cumsum(counts) - counts, np.zeros(len(who))
    for place in range(int(counts.max(initial=0))):
        i = np.flatnonzero(place < counts[who])
        e = begins[who[i]] + place
        got[i] += idf[e] * block.shares(term[e], doc[i])
    mine, wanted = np.round(got, 9), np.round(score[who], 9)
    won = (mine > wanted) | ((mine == wanted) & (ids[doc] < sought[who]))
    return np.minimum(above + np.bincount(who[won], minlength=len(above)), k)


def better_in_block(k: int, mean: float):
    """For ``applyInPandas``: packets and rows of questions of a block to (query_id, above), where there are any."""

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"), "above": pd.Series([], dtype="int64")})
        terms = np.unique(np.concatenate(asking["terms"].to_list()))
        own = own.sort_values("packet")
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in own["ids"]])
        size = np.concatenate([np.frombuffer(x, np.int32) for x in own["sizes"]]).astype(np.float64)
        block = Block(*postings(own, terms), K1 * (1 - B + B * size / mean))
        found = []
        for q in asking.itertuples():
            above = better(block, ids, q.counts.astype(np.int64), np.searchsorted(terms, q.terms), q.idf, q.score, q.doc_id, k)
            some = np.flatnonzero(above)
            found.append(pd.DataFrame({"query_id": q.query_id[some], "above": above[some]}))
        return pd.concat(found)

    return search


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def ranks(docs: DataFrame, sought: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id): the best placed of the documents that each question should find, if among the ``k`` best.

    ``docs`` has (doc_id, words); ``sought`` (query_id, asked, doc_id, words): a row for each document that a
    question should find, with the question's words, which are a set.  Ranks are those of full BM25 scores in nine
    places, ties by id.  Words go by 64-bit hashes.
    """
    spark = docs.sparkSession
    release(spark)
    last = F.lit((1 << 63) - 1)  # documents without an id or without words count, too
    hashed = docs.select(F.coalesce("doc_id", last).alias("doc_id"), _hashes(F.col("words")).alias("held"))
    packets = written(hashed.mapInArrow(packed, PACKET), "packets")
    whole = packets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    mean = max(whole.words / max(whole.known, 1), 1.0)

    hashed = sought.select("query_id", "doc_id", F.array_sort(F.array_distinct(_hashes(F.array_compact("asked")))).alias("terms"), _hashes(F.col("words")).alias("held"))
    each = hashed.select(F.monotonically_increasing_id().alias("row"), "query_id", "doc_id", F.size("held").alias("len"), F.transform("terms", lambda t: F.struct(t.alias("term"), F.size(F.filter("held", lambda w: w == t)).alias("tf"))).alias("terms"))
    df = packets.select("terms", "begins").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    rows = each.where(F.exists("terms", lambda t: t["tf"] > 0)).select("row", "query_id", "doc_id", "len", F.inline("terms")).join(df, "term")
    idf = F.log(1 + (F.lit(whole.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    grouped = rows.groupBy("row", "query_id", "doc_id", "len").agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf"), "tf"))).alias("terms"))
    norm = K1 * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.lit(mean))
    scored = grouped.withColumn("score", F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["idf"] * (t["tf"] * F.lit(K1 + 1) / (t["tf"] + norm))))
    target = F.min_by(F.struct("doc_id", "score", F.col("terms.term").alias("terms"), F.col("terms.idf").alias("idf")), F.struct(-F.round("score", 9), "doc_id"))
    targets = written(scored.groupBy("query_id").agg(target.alias("t")).select("query_id", "t.*"), "targets")

    release(spark)
    asked = targets.count()
    at_once, cost = -(-asked // QUESTIONS_AT_ONCE) or 1, F.greatest("words", F.col("n") * (WORDS_A_BLOCK // DOCUMENTS_A_BLOCK))
    total = packets.agg(F.coalesce(F.sum(cost), F.lit(0))).first()[0]
    a_block = max(min(WORDS_A_BLOCK, -(-total // spark.sparkContext.defaultParallelism)), 1)
    parts = total // a_block + 1
    # a row of two numbers for each packet
    placed = packets.select("packet", F.floor((F.sum(cost).over(Window.orderBy("packet")) - cost) / a_block).cast("int").alias("part"))
    row = F.pmod(F.xxhash64("query_id"), F.lit(-(-asked // QUESTIONS_A_ROW) or 1))
    # a document that has k better ones in a few blocks needs no others
    few = spark.sparkContext.defaultParallelism
    few = few if parts >= FEW_OF * few else 0
    left, above = targets, []
    for low, high in ((0, few), (few, parts)):
        if low < high:
            rowed = left.groupBy(row.alias("row")).agg(F.collect_list(F.struct("query_id", "doc_id", "score", "terms", "idf")).alias("q"))
            flat = rowed.select((F.col("row") % at_once).cast("int").alias("asking"), "q.query_id", "q.doc_id", "q.score", F.transform("q", lambda q: F.size(q["terms"])).alias("counts"), F.flatten("q.terms").alias("terms"), F.flatten("q.idf").alias("idf"))
            questions = flat.withColumn("part", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
            block = packets.join(F.broadcast(placed.where(F.col("part").between(low, high - 1))), "packet").withColumn("asking", F.explode(F.sequence(F.lit(0), F.lit(at_once - 1))))
            keys, tasks = ["part", "asking"], (high - low) * at_once
            found = block.repartition(tasks, *keys).groupBy(*keys).cogroup(questions.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(better_in_block(k, mean), "query_id long, above long")
            above.append(written(found.groupBy("query_id").agg(F.sum("above").alias("above")), "above"))
            left = left.join(above[-1].where(F.col("above") >= k), "query_id", "left_anti")
    found = reduce(DataFrame.unionByName, above).groupBy("query_id").agg(F.sum("above").alias("above"))
    place = (1 + F.coalesce("above", F.lit(0))).cast("int")
    out = written(targets.select("query_id", "doc_id").join(found, "query_id", "left").select("query_id", place.alias("rank"), "doc_id").where(place <= k), "ranks")
    discard(packets, targets, *above)
    release(spark)
    return out
