"""BPE encoding and decoding by speculation and verification.

``WordBPE`` encodes words of a word-end vocabulary.  Greedy longest match proposes the tokens
of all new words of a batch; each distinct pair of neighbours is then checked, in arrays, for
compatibility (a pair is compatible if merging its joined text gives that pair again).  A
proposal whose neighbours are all compatible is the exact encoding, and only words with an
incompatible pair are merged step by step.

White space never joins tokens in such a vocabulary, so a text is its white-space-separated
units one after another, and each distinct unit is encoded once per worker process.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from ._arrow import batches_of, fields, text_slices

#: A worker keeps the encodings of this many distinct units at most, in two halves: the older
#: half goes as the newer fills up, and units met again move to the newer.
CACHE_UNITS = 600_000
#: White space of the tokenizers library: the Unicode property, without the separators 1C-1F that Python adds.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_LETTERS, _MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", "!-&(-/:-@\\[-`{-~"
_COMMON = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
#: Stands for a word that no tokens spell.
NONE = -1
_WORKERS: dict[str, "WordBPE"] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordBPE:
    """Encoder of one vocabulary file, with the caches of one worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = [t["content"] for t in spec["added_tokens"]]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.width = max(self.ids.values()) + 1
        self.compatible: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.names = {i: str(i) for i in self.tokens}
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.older: tuple[dict[str, str], dict[str, str]] = ({}, {})
        self.letters = byte_letters()
        self.marked = {t.removesuffix(self.end) + "\n" if t.endswith(self.end) else t: i for t, i in self.ids.items()}
        self.reach: dict[str, int] = {}
        for token in self.marked:
            self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 2))

    # exact merging

    def merged(self, symbols: list[int]) -> list[int]:
        """Merges of least rank first, leftmost first, until none applies."""
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                found = self.merges.get((symbols[i], symbols[i + 1]))
                if found and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            symbols[at : at + 2] = [best[1]]
        return symbols

    def exact(self, word: str, ends: bool = True) -> list[int]:
        """The encoding of a word by merging alone; ``ends`` if it is the end of a word."""
        pieces = list(word)
        if ends and pieces:
            pieces[-1] += self.end
        return self.merged([self.ids[p] for p in pieces])

    # speculation

    def proposed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words, end to end, and how many each word takes.

        A line feed stands for the word-end mark and never stands alone; ``reach`` has the longest token that begins
        with three given letters, so few lengths are tried at each place.
        """
        out, sizes, find, reach = [], [], self.marked.get, self.reach.get
        for word in words:
            word += "\n"
            at, end, held = 0, len(word), len(out)
            while at < end:
                to = min(end, at + reach(word[at : at + 3], 2))
                while to > at and (to == end - 1 or (token := find(word[at:to])) is None):  # a mark goes with a letter
                    to -= 1
                if to == at:  # no token begins here: the word fails whole
                    del out[held:]
                    token, to = NONE, end
                out.append(token)
                at = to
            sizes.append(len(out) - held)
        return np.array(out, np.int64), np.array(sizes, np.int64)

    def _holds(self, token: int) -> bool:
        if token == NONE:
            return False
        if token not in self.alone:
            text = self.tokens[token]
            ends = text.endswith(self.end)
            self.alone[token] = self.exact(text.removesuffix(self.end) if ends else text, ends) == [token]
        return self.alone[token]

    def _fits(self, key: int) -> bool:
        if key not in self.compatible:
            a, b = divmod(key, self.width)
            text = self.tokens[b]
            ends = text.endswith(self.end)
            whole = self.tokens[a] + (text.removesuffix(self.end) if ends else text)
            self.compatible[key] = self.exact(whole, ends) == [a, b]
        return self.compatible[key]

    def words(self, words: list[str]) -> list[list[int]]:
        """The encodings of distinct words: proposals, one check in arrays, repairs."""
        if not words:
            return []
        flat, sizes = self.proposed(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = np.zeros(len(words), bool)
        single = sizes[owner] == 1
        kinds, where = np.unique(flat[single], return_inverse=True)
        bad[owner[single][~np.fromiter(map(self._holds, kinds.tolist()), bool, len(kinds))[where]]] = True
        inside = owner[1:] == owner[:-1]
        keys, where = np.unique((flat[:-1] * self.width + flat[1:])[inside], return_inverse=True)
        fits = np.fromiter(map(self._fits, keys.tolist()), bool, len(keys))
        bad[owner[1:][inside][~fits[where]]] = True
        listed, stops = flat.tolist(), np.cumsum(sizes).tolist()
        out = [listed[a:b] for a, b in zip([0, *stops], stops)]
        for i in np.flatnonzero(bad).tolist():
            out[i] = [t.id for t in self.library.model.tokenize(words[i])]  # merges step by step
        return out

    # units and texts

    def _pieces(self, unit: str) -> list[str]:
        """The words of a unit, in byte letters, as the library splits its normal form."""
        if _COMMON.fullmatch(unit):  # splits and lower-cases without context
            low = unit.lower()
            parts = _PARTS.findall(low)
            return parts if low.isascii() else [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        normal = self.library.normalizer.normalize_str(unit)
        return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, units: set[str]) -> None:
        """Hold the encodings of ``units`` in the newer half of the cache."""
        new = units.difference(self.ids_of)
        if len(self.ids_of) + len(new) > CACHE_UNITS // 2:
            self.older, self.ids_of, self.text_of, new = (self.ids_of, self.text_of), {}, {}, units
        old_ids, old_text = self.older
        met = [u for u in new if u in old_ids]
        self.ids_of.update([(u, old_ids[u]) for u in met])
        self.text_of.update([(u, old_text[u]) for u in met])
        pieces = {u: self._pieces(u) for u in new if u not in old_ids}
        words = list({p for ps in pieces.values() for p in ps})
        known = dict(zip(words, self.words(words), strict=True))
        names, letters = self.names, self.tokens
        for unit, parts in pieces.items():
            ids = known[parts[0]] if len(parts) == 1 else [t for p in parts for t in known[p]]
            self.ids_of[unit] = " ".join([names[i] for i in ids])
            self.text_of[unit] = " ".join([letters[i] for i in ids])

    def forget(self) -> None:
        """Drop the units of a finished task: its worker lives on in stages that need the memory."""
        self.ids_of, self.text_of, self.older = {}, {}, ({}, {})

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, decimal ids joined by spaces, decoded text) of every text."""
        for begin, end in batches_of(texts, 1 << 22):
            units = [None if any(s in t for s in self.special) else _units(t) for t in texts[begin:end]]
            every: set[str] = set()
            every.update(*[own for own in units if own])
            self.learn(every)
            for text, own in zip(texts[begin:end], units, strict=True):
                if own is None:  # it spells a special token
                    found = self.library.encode(text, add_special_tokens=False).ids
                    yield len(found), " ".join(map(str, found)), self.library.decode(found, skip_special_tokens=False)
                    continue
                ids = " ".join(filter(None, map(self.ids_of.__getitem__, own)))
                yield ids.count(" ") + 1 if ids else 0, ids, " ".join(filter(None, map(self.text_of.__getitem__, own)))


def _units(text: str) -> list[str]:
    return [u for u in _SPACE.split(text) if u] if _SEPARATORS.search(text) else text.split()


def encoder(path: str) -> WordBPE:
    """The encoder of this process for a vocabulary file."""
    if path not in _WORKERS:
        _WORKERS[path] = WordBPE(path)
    return _WORKERS[path]


RESULT = fields(doc_id=T.LongType(), n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType())


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: token count, and digests of its ids and of its decoded text.

    A null text counts as empty (no token, digests of the empty text); repeated rows and null
    ids give a row each; other columns of ``docs`` are not looked at.
    """

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, 1 << 22):
                out = [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for n, i, d in coder.encode([t.decode() for t in texts])]
                n, ids, decoded = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=RESULT.names)
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


ENCODED = fields(doc_id=T.LongType(), ids=T.ArrayType(T.IntegerType()), decoded=T.StringType())


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """The operator proper: every document's ids and its decoded text, by the same rules."""

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, 1 << 22):
                out = [([*map(int, ids.split())], decoded) for _, ids, decoded in coder.encode([t.decode() for t in texts])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.string())], names=ENCODED.names)
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)
