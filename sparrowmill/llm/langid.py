"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram binds its letters' vectors, each
permuted by its place, by multiplication; a text bundles (adds) the vectors of its n-grams, a
language bundles its documents, and a text goes to the language whose prototype, less what all
prototypes have in common, has the greatest cosine with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._arrow import fields, id_remainder, text_slices

DIMENSIONS = 2048
GRAM = 3
#: At most about this many documents of each language are learned from, chosen by a hash of the id.
LEARNED_PER_LANGUAGE = 4000
#: A worker forgets its letters' vectors once it holds those of so many; they are drawn anew.
LETTERS_HELD = 20_000
_letters: dict[tuple[int, int], np.ndarray] = {}
_codes = np.zeros(0x110000, np.uint32)
_seen = np.zeros(0x110000, bool)


def _letter(code: int, dimensions: int) -> np.ndarray:
    if (code, dimensions) not in _letters:
        if len(_letters) >= LETTERS_HELD:
            _letters.clear()
        draw = np.random.Generator(np.random.PCG64([code, dimensions]))
        _letters[code, dimensions] = draw.integers(0, 2, dimensions, np.int8) * np.int8(2) - np.int8(1)
    return _letters[code, dimensions]


def _folded(text: str) -> np.ndarray:
    """Code points in small form, each run of other characters as one space, one at both ends."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    new = raw[~_seen[raw]]
    for code in np.unique(new).tolist():
        _codes[code], _seen[code] = code if chr(code).isalpha() else 32, True
    codes = _codes[raw]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The vector of every text; zeros if it has no letter."""
    out = np.zeros((len(texts), dimensions), np.float32)
    parts = [_folded(t) for t in texts]
    sizes = np.array([max(0, len(p) - GRAM + 1) for p in parts])
    if not sizes.sum():
        return out
    flat = np.concatenate(parts)
    letters, index = np.unique(flat, return_inverse=True)
    count = len(letters)
    index = index.astype(np.int64)
    gram = (index[:-2] * count + index[1:-1]) * count + index[2:]
    begins = np.cumsum([0, *map(len, parts)])[:-1]
    at = np.arange(int(sizes.sum())) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    space = np.searchsorted(letters, 32)
    gram = gram[at]
    kept = gram // count % count != space  # the middle of a gram is a letter
    pairs, times = np.unique(owner[kept] * count**3 + gram[kept], return_counts=True)
    who, gram = np.divmod(pairs, count**3)
    grams, where = np.unique(gram, return_inverse=True)
    table = np.stack([_letter(int(c), dimensions) for c in letters])
    first, second = np.roll(table, 2, 1), np.roll(table, 1, 1)
    for a in range(0, len(grams), 1024):
        some = grams[a : a + 1024]
        vectors = (first[some // count**2] * second[some // count % count] * table[some % count]).astype(np.float32)
        inside = (where >= a) & (where < a + 1024)
        counts = np.zeros((len(texts), len(some)), np.float32)
        counts[who[inside], where[inside] - a] = times[inside]
        out += counts @ vectors
    return out


PARTIAL = fields(lang=T.StringType(), vector=T.ArrayType(T.DoubleType()))


def learn(docs: DataFrame, most: int = LEARNED_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and centred prototypes from rows with a text and a language.

    ``most`` bounds the documents of each language: a language with more keeps those whose id
    hashes below the matching share.  Each task sends one sum for each language it has met.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return [], np.zeros((0, DIMENSIONS))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / n))])
    sample = known.where(place < share[F.col("lang")])

    def summed(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in text_slices(batch, 1 << 18):
                langs = part.column("lang").to_pylist()
                vectors = bundles([t.decode() for t in texts]).astype(np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                vectors /= np.where(norms, norms, 1)
                for lang in set(langs):
                    own = vectors[[x == lang for x in langs]].sum(0)
                    total[lang] = total[lang] + own if lang in total else own
        yield pa.RecordBatch.from_pylist([{"lang": k, "vector": v.tolist()} for k, v in total.items()], schema=pa.schema({"lang": pa.string(), "vector": pa.list_(pa.float64())}))

    partial = sample.select("lang", "text").mapInArrow(summed, PARTIAL).select("lang", F.posexplode("vector").alias("at", "x"))
    # rounded to integers, sums don't depend on the order of tasks
    whole = partial.groupBy("lang", "at").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x"))
    langs = sorted(sizes)
    out = np.zeros((len(langs), DIMENSIONS))
    for r in whole.collect():  # languages x dimensions values
        out[langs.index(r["lang"]), r["at"]] = r["x"]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        out -= out.mean(0)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return langs, out


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, extra: list[str] | None = None, named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``doc_id``, the language and score of every row, and the columns named in ``extra``.

    A null text, one without letters, or a model without languages gives ``und`` and 0.  The
    score is the cosine with the best prototype, 0 if negative; ties go to the first language
    by code point.
    """
    extra = extra or []
    made = [T.StructField("doc_id", T.LongType()), T.StructField(named[0], T.StringType()), T.StructField(named[1], T.DoubleType())]
    schema = T.StructType([*made, *[docs.schema[c] for c in extra]])
    proto = prototypes.astype(np.float32).T.copy()

    def run(batches):
        for batch in batches:
            best, score = [], []
            for _, texts in text_slices(batch, 1 << 18):
                vectors = bundles([t.decode() for t in texts])
                norms = np.linalg.norm(vectors, axis=1)
                near = vectors @ proto / np.where(norms, norms, 1)[:, None] if langs else np.zeros((len(texts), 0))
                top = near.argmax(1) if langs else np.zeros(len(texts), int)
                best += [langs[k] if langs and n else "und" for k, n in zip(top.tolist(), norms.tolist(), strict=True)]
                score += [min(1.0, max(0.0, float(near[i, k]))) if langs else 0.0 for i, k in enumerate(top.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(best, pa.string()), pa.array(score, pa.float64()), *[batch.column(c) for c in extra]], names=schema.names)

    return docs.select("doc_id", "text", *[c for c in extra if c != "text"]).mapInArrow(run, schema)


def held_out():
    """Rows that the prototypes of the registered query are not learned from."""
    return id_remainder(3) == 1


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and predict the language of every row."""
    langs, prototypes = learn(docs.where(~held_out()))
    return predict(docs, langs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
