"""Benchmark windows in documents against plain Python: overlaps, short items, copies, edges, forced clashes."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark import cloudpickle

from sparrowmill.llm import decontamination

DOCS = "doc_id long, text string, row long, n_words string, found int, shingle string"
ITEMS = "item_id long, text string, words string, class int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (t := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[t]
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, window=10):
    d = spark.createDataFrame([(*r, 5, "x", 6, "y") for r in docs], DOCS).repartition(3)
    got = decontamination.contamination(d, spark.createDataFrame([(*r, "w", 1) for r in items], ITEMS), window)
    return sorted(map(tuple, got.collect()), key=str)


def passages(seed):
    """Documents with whole and partial windows of items, in other case and with other separators."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "漢字", "x", "the", "of"]
    items = []
    for i in range(25):
        n = rnd.choice([1, 2, 3, 5, 9, 10, 11, 14, 40])
        items.append((i, " ".join(rnd.choice(vocabulary) for _ in range(n))))
    items += [(100, items[3][1]), (3, items[3][1]), (None, items[8][1]), (101, None), (102, " .,; "), (103, "solo"), (104, "a " * 30)]
    docs = []
    for i in range(120):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 9, 10, 60, 300]))]
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            item = words(rnd.choice(items)[1])
            a = rnd.randrange(len(item) + 1)
            part = item[a : a + rnd.choice([9, 10, 11, 25])]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = part
        docs.append((i, rnd.choice([" ", ", ", "-", "\x00", "\n\n"]).join(x.upper() if rnd.random() < 0.2 and x.isascii() else x for x in w)))
    docs += [(None, docs[5][1]), (None, None), (200, ""), (5, docs[5][1]), (5, docs[6][1]), (201, "a " * 5_000), (202, "solo " * 40_000)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_like_plain_python(spark, seed):
    docs, items = passages(seed)
    want = brute(docs, items)
    assert 20 < sum(r[5] for r in want) < len(want)
    assert run(spark, docs, items) == want


def test_no_short_items_and_other_windows(spark):
    docs, items = passages(3)
    items = [(i, t) for i, t in items if len(words(t)) >= 10]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs[:60], items, window=6) == brute(docs[:60], items, window=6)


def test_empty_tables(spark):
    docs, items = passages(4)
    nothing = hashlib.sha256(b"").hexdigest()
    assert run(spark, docs[:20], []) == sorted([(i, len(words(t)), 0, 0, nothing, False) for i, t in docs[:20]], key=str)
    assert run(spark, [], items) == []
    assert run(spark, docs[:20], [(1, "zzz " * 12)]) == sorted([(i, len(words(t)), 0, 0, nothing, False) for i, t in docs[:20]], key=str)


def test_candidates_that_share_hashes_are_compared_word_by_word(spark, monkeypatch):
    """All shingles have one of four hashes, so that most places are false."""
    plain = decontamination.run_hashes
    docs, items = passages(5)
    docs, items = docs[:40], [(i, t) for i, t in items if len(words(t)) >= 5]

    def few(w, n):
        return plain(w, n) & np.uint64(3)

    monkeypatch.setattr(decontamination, "run_hashes", few)
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    cloudpickle.register_pickle_by_value(decontamination)  # so that workers get the change, too
    try:
        assert run(spark, docs, items) == brute(docs, items)
    finally:
        cloudpickle.unregister_pickle_by_value(decontamination)


def test_spans(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "lead in " + item.replace(" ", "; ") + " tail"), (2, "q0 q1")], "doc_id long, text string")
    got = decontamination.contaminated_spans(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted((r.doc_id, r.begin, r.end, r.ids) for r in got.collect()) == [(1, 2 + i, 12 + i, ["7"]) for i in range(3)]
