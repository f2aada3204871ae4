"""Toxicity by maximum-scoring segments.

Words, and their beginnings, have log-odds between toxic and other documents under a Dirichlet prior
that follows the pooled frequencies.  What is left of them after a margin for doubt says how much
more often than in clean text a token stands among those that make documents toxic.  A toxic passage
is clean text into which such tokens are mixed at a given share, and every token scores its log-odds
between such a passage and clean text: the telling ones much, all others a little below 0.  One
linear scan then finds every maximal scoring segment of a text.

Scores of segments follow an extreme-value law: by chance, a text of n tokens has about
K n exp(-lambda S) segments of score S or more.  lambda and K come from the scores of tokens in clean
documents that the odds weren't learned from, and on such documents, too, the passages' evidence is
calibrated to a text's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import discard, written
from ._arrow import fields, id_remainder, text_slices

#: At most about this many labelled documents of each label are learned from, by a hash of the id.
LEARNED_PER_LABEL = 12_000
#: One of so many of them is kept apart, for the law and the calibration.
APART = 4
#: A feature counts if at least this many learned documents hold it (a beginning: so many words).
LEAST = 4
#: Pseudo-documents of each feature, spread by the pooled frequencies.
PRIOR = 4.0
#: Odds count by what is left of them after so many standard deviations.
DOUBT = 3.0
#: Share of telling tokens in a toxic passage, and in a toxic document.
MIXED, TELLING = 0.3, 0.01
#: Tokens within which a word tells but once.
AGAIN = 64
#: Log-odds are below this.
MOST_ODDS = 8.0
#: The evidence of a text without any passage, empty texts included.
NO_PASSAGE = -5.0
#: The log-odds of a token that tells nothing.
PLAIN = math.log(1 - MIXED)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """A word and its beginnings of 6, 5 and 4 letters, the most telling first."""
    return [word, *("^" + word[:k] for k in (6, 5, 4) if len(word) >= k)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), by Ruzzo and Tompa's linear scan.

    Runs of equal sign are added up first, as no maximal segment begins or ends inside one.
    """
    if not len(scores):
        return []
    positive = scores > 0
    cuts = np.flatnonzero(positive[1:] != positive[:-1]) + 1
    begins = np.concatenate(([0], cuts))
    ends = np.concatenate((cuts, [len(scores)]))
    sums = np.add.reduceat(scores, begins)
    stack: list[tuple[int, int, float, float]] = []  # begin, end, total before, total after
    total = 0.0
    for begin, end, value in zip(begins.tolist(), ends.tolist(), sums.tolist(), strict=True):
        if value <= 0:
            total += value
            continue
        now = (begin, end, total, total + value)
        total += value
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= now[2]:
                k -= 1
            if k < 0 or stack[k][3] >= now[3]:
                stack.append(now)
                break
            now = (stack[k][0], now[1], stack[k][2], now[3])
            del stack[k:]
    return [(b, e, right - left) for b, e, left, right in stack]


@dataclass
class Model:
    """Log-odds of telling features, the extreme-value law of segment scores, and the calibration."""

    odds: dict[str, float]
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    offset: float = -2.0
    held: dict[str, float] = field(default_factory=dict)

    def token(self, word: str) -> float:
        """Log-odds of the most telling feature of a word."""
        found = self.held.get(word)
        if found is None:
            odds = self.odds
            found = next((odds[f] for f in features(word) if f in odds), PLAIN)
            if len(self.held) >= 500_000:
                self.held.clear()
            self.held[word] = found
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """Every token's log-odds; a word said again within ``AGAIN`` tokens tells nothing new."""
        out = np.fromiter(map(self.token, words), float, len(words))
        last: dict[str, int] = {}
        for i in np.flatnonzero(out > 0).tolist():
            if i - last.get(words[i], -AGAIN) < AGAIN:
                out[i] = PLAIN
            last[words[i]] = i
        return out

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments of a text by token number, and its number of tokens."""
        words = words_of(text)
        return (segments(self.scores(words)) if self.odds and words else []), len(words)

    def significant(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
        """The segments that chance would give less than one of in so long a text."""
        return [x for x in found if self.decay * x[2] > math.log(max(self.scale * n, 1e-9))]

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """Minus the log of the chance of a text's best passage, more with further significant ones."""
        if not found:
            return NO_PASSAGE
        best = self.decay * max(s for _, _, s in found) - math.log(max(self.scale * max(n, 1), 1e-9))
        return best + math.log1p(len(self.significant(found, n)))

    def score(self, evidence: float) -> float:
        z = self.slope * evidence + self.offset
        return 1 / (1 + math.exp(-min(60.0, max(-60.0, z))))


def karlin_altschul(scores: dict[float, int], step: float = 0.1, turns: int = 60) -> tuple[float, float]:
    """lambda with E exp(lambda s) = 1, and K, of the law of maximal segment scores.

    K = exp(-2 sum_k (E[exp(lambda S_k); S_k < 0] + P(S_k >= 0)) / k) / (lambda E[s exp(lambda s)]),
    S_k being sums of k scores; scores are on a grid of ``step``, so sums are convolutions.
    """
    total = sum(scores.values())
    if not total or max(scores) <= 0 or sum(s * n for s, n in scores.items()) >= 0:
        return 1.0, 1.0
    places = np.round(np.array(list(scores)) / step).astype(int)
    low = int(places.min())
    p = np.zeros(int(places.max()) - low + 1)
    np.add.at(p, places - low, np.array(list(scores.values()), float) / total)
    s = (np.arange(len(p)) + low) * step
    left, right = 1e-6, 1.0
    while p @ np.exp(np.minimum(right * s, 500)) < 1 and right < 64:
        right *= 2
    for _ in range(80):
        middle = (left + right) / 2
        left, right = (middle, right) if p @ np.exp(np.minimum(middle * s, 500)) < 1 else (left, middle)
    decay, sums, begin, total = right, np.ones(1), 0, 0.0
    for k in range(1, turns + 1):
        sums, begin = np.convolve(sums, p), begin + low
        at = (np.arange(len(sums)) + begin) * step
        term = (sums * np.exp(np.minimum(decay * at, 0)))[at < 0].sum() + sums[at >= 0].sum()
        total += term / k
        if term < 1e-6:
            break
    mean = float(p @ (s * np.exp(np.minimum(decay * s, 500))))
    return decay, max(1e-9, math.exp(-2 * total) / (decay * max(mean, 1e-9)))


COUNTS = fields(feature=T.StringType(), y=T.LongType(), n=T.LongType())


def odds_of(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds, between a toxic passage and clean text, of the features that tell anything.

    ``counts``: {feature: (toxic documents, documents) that hold it}.  With r a feature's ratio of
    frequencies after the margin for doubt and p its frequency in clean documents, telling tokens
    are drawn from q = p (r - 1) / TELLING, as a toxic document draws from (1 - TELLING) p + TELLING q;
    a passage draws from (1 - MIXED) p + MIXED q.
    """
    share = toxic / max(1, toxic + clean)
    out = {}
    for f, (y, n) in counts.items():
        one, other = (y + PRIOR * share) / (toxic + PRIOR * share), (n - y + PRIOR * (1 - share)) / (clean + PRIOR * (1 - share))
        doubt = DOUBT * math.sqrt(1 / (y + PRIOR * share) + 1 / (n - y + PRIOR * (1 - share)))
        left = math.log(one / other) - doubt
        if left > 0:
            out[f] = min(MOST_ODDS, math.log(1 - MIXED + MIXED * math.expm1(left) / TELLING))
    return out


def _odds(sample: DataFrame) -> dict[str, float]:
    """:func:`odds_of` the documents of ``sample`` (toxic, text).

    Beginnings count where they are used: in words that are too rare to count themselves.
    """

    def run(batches):
        every, bad = Counter(), Counter()
        for batch in batches:
            for part, texts in text_slices(batch):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    own = set(words_of(text.decode()))
                    every.update(own)
                    if toxic:
                        bad.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), *[pa.array([c[f] for f in every], pa.int64()) for c in (bad, every)]], names=COUNTS.names)

    sums = sample.select("toxic", "text").mapInArrow(run, COUNTS).groupBy("feature").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # under as many as a bounded sample has
    beginnings = F.array(*[F.when(F.length("feature") >= k, F.concat(F.lit("^"), F.substring("feature", 1, k))) for k in (6, 5, 4)])
    rare = sums.where(F.col("n") < LEAST).select(F.explode(F.array_compact(beginnings)).alias("feature"), "y", "n").groupBy("feature").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    counts = {r["feature"]: (r["y"], r["n"]) for r in sums.unionByName(rare).where((F.col("n") >= LEAST) & (F.col("y") > 0)).collect()}
    return odds_of(counts, sizes.get(1, 0), sizes.get(0, 0)) if sizes.get(1) and sizes.get(0) else {}


def _tokens_of_clean(sample: DataFrame, model: Model) -> dict[float, int]:
    """How often clean documents' tokens have each score, in steps of a tenth."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for part, texts in text_slices(batch):
                for text, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                    if not toxic and (words := words_of(text.decode())):
                        total.update(np.round(10 * model.scores(words)).astype(int).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["tenths", "n"])

    rows = sample.select("toxic", "text").mapInArrow(run, fields(tenths=T.LongType(), n=T.LongType())).groupBy("tenths").agg(F.sum("n").alias("n")).collect()  # under 130 scores
    return {r["tenths"] / 10: r["n"] for r in rows}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) marks.

    Rows without text or label count for nothing; an id with several labels is toxic if any is.
    The learned rows are bounded by ``LEARNED_PER_LABEL``; of these one in ``APART`` is kept apart.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    if len(sizes) < 2:
        return Model({})
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = marks.where(place < F.when(F.col("toxic") == 1, min(1.0, LEARNED_PER_LABEL / sizes[1])).otherwise(min(1.0, LEARNED_PER_LABEL / sizes[0])))
    chosen = chosen.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(APART)) == 0)
    sample = written(docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")  # at most about 2 x LEARNED_PER_LABEL ids
    near, apart = sample.where("not apart"), sample.where("apart")
    model = Model(_odds(near))
    law = _tokens_of_clean(apart, model) or _tokens_of_clean(sample, model)
    if law and max(law) <= 0 and model.odds:  # no telling token in clean texts: one pseudo-token of each strength
        law |= {round(x, 1): 1 for x in model.odds.values()}
    model.decay, model.scale = karlin_altschul(law) if law else (1.0, 1.0)

    def weighed(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                found = [model.passages(t.decode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array([model.evidence(*x) for x in found], pa.float64())], names=["toxic", "evidence"])

    judge = lambda df: df.select("toxic", "text").mapInArrow(weighed, fields(toxic=T.IntegerType(), evidence=T.DoubleType())).collect()  # noqa: E731  bounded by LEARNED_PER_LABEL
    seen = judge(apart)
    if len({r["toxic"] for r in seen}) < 2:  # too few labels to keep any apart
        seen = judge(sample)
    x, y = np.array([r["evidence"] for r in seen], float), np.array([r["toxic"] for r in seen], float)
    if len(set(y.tolist())) == 2:
        # kept rows stand for the labelled rows of their label
        w = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
        model.slope, model.offset = _calibrated(x, y, w * len(y) / max(1e-9, w.sum()))
    discard(sample)
    model.held.clear()
    return model


def _calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, by damped Newton steps with a slight ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(w * (p - y) * x).sum() + 1e-2 * a, (w * (p - y)).sum()])
        v = w * p * (1 - p) + 1e-6
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = max(1e-3, a - step[0]), b - step[1]
    return float(a), float(b)


PASSAGE = T.ArrayType(fields(begin=T.IntegerType(), end=T.IntegerType(), text_score=T.DoubleType()))
SCORED = fields(doc_id=T.LongType(), score=T.DoubleType(), predicted=T.IntegerType(), passages=PASSAGE)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score, decision and toxic passages (ranges of token numbers) of every row.

    A null or empty text has no passage and scores as such; repeated rows score alike.
    """

    def run(batches):
        for batch in batches:
            scores, passages = [], []
            for _, texts in text_slices(batch):
                for text in texts:
                    found, n = model.passages(text.decode())
                    scores.append(model.score(model.evidence(found, n)))
                    passages.append([{"begin": b, "end": e, "text_score": s} for b, e, s in model.significant(found, n)])
            kind = pa.list_(pa.struct({"begin": pa.int32(), "end": pa.int32(), "text_score": pa.float64()}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, kind)], names=SCORED.names)

    return docs.select("doc_id", "text").mapInArrow(run, SCORED)


def held_out():
    """Rows whose labels the registered query doesn't learn from."""
    return id_remainder(5) == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that are not held out, and score every row."""
    model = learn(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "passages")
