"""Edit distances and fuzzy anchors against the plain dynamic program."""

import random

from sparrowmill.functions import alignment, evidence
from sparrowmill.operators import anchors


def plain(pattern, text):
    """(distance, begin, end) by full tables: least distance, then first end, then shortest part."""
    n, m = len(text), len(pattern)
    best = (m, 0, 0)
    row = list(range(m + 1))
    ends = []
    for j, c in enumerate(text, 1):
        new = [0]
        for i in range(1, m + 1):
            new.append(min(row[i - 1] + (pattern[i - 1] != c), row[i] + 1, new[i - 1] + 1))
        row = new
        ends.append((row[m], j))
    distance, end = min(ends, default=(m, 0))
    if distance >= m:
        return best
    for begin in range(end, -1, -1):
        if edits(pattern, text[begin:end]) == distance:
            return distance, begin, end


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def noisy(rnd, text, n):
    for _ in range(n):
        at = rnd.randrange(len(text) + 1)
        text = text[:at] + rnd.choice(["", "x", "q "]) + text[at + rnd.choice([0, 1]) :]
    return text


def test_best_like_the_full_table():
    rnd = random.Random(1)
    for _ in range(400):
        pattern = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 90)))
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 60)))
        if rnd.random() < 0.5:
            text += noisy(rnd, pattern, rnd.randrange(6)) + text[::-1]
        assert alignment.best(pattern, text) == plain(pattern, text), (pattern, text)


def test_common_like_the_full_table():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(40))) for _ in "12")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        assert alignment.common(a, b) == row[-1]


def test_pieces_stay_whole():
    """Whatever edits are made, enough pieces keep their bytes on near diagonals."""
    for size in range(1, 400):
        for errors in {0, size // 20, size // 10, size // 4}:
            number, length, whole = anchors.pieces(size, errors)
            assert length >= 1 and number * length <= size and number - errors == whole >= 1


def test_located_like_the_full_table(spark):
    rnd = random.Random(2)
    words = ["the", "of", "tax", "law", "article", "public", "work", "amount", "x1", "act"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 5, 12, 30]))) for i in range(14)] + [(90, None), (91, " ., "), (92, say(20)), (92, "Ábc, dé!")]
    docs = []
    for i in range(40):
        parts = [say(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            parts += [noisy(rnd, rnd.choice(items)[1] or "", rnd.choice([0, 1, 3, 9])), say(rnd.randrange(20))]
        docs.append((i, " ".join(parts)))
    docs += [(None, items[3][1]), (7, items[4][1].upper()), (50, None), (51, ""), (52, "abc de"), (53, "-- ÁBC -- DE")]
    fold = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower().translate(str.maketrans("áéíóú", "aeiou"))).split())
    want = []
    for i, t in docs:
        for a, p in items:
            if (pattern := fold(p)) and fold(t):
                d, b, e = plain(pattern, fold(t))
                if d <= int(len(pattern) * 0.1):
                    want.append((i, a, d, b, e))
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, distance int").repartition(3)
    a = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, anchors.located(d, a).collect()), key=str)
    assert got == sorted(want, key=str) and any(0 < r[2] for r in got)
    whole, anchors.BLOCK = anchors.BLOCK, 200
    try:
        assert sorted(map(tuple, anchors.located(d, a).collect()), key=str) == got
    finally:
        anchors.BLOCK = whole
    assert anchors.located(d, a.where("false")).count() == 0 == anchors.located(d.where("false"), a).count()


def test_evidence_near_a_phrase():
    said = "trabaje tres anos como analista de datos senior en lima"
    assert evidence.nearest("analista de dato", said) == "analista de datos"
    assert evidence.nearest("analysta de datos", said) == "analista de datos"
    assert evidence.nearest("gerente comercial", said) is None
    assert evidence.nearest("", said) is None and evidence.nearest("x", "") is None
    assert evidence.coverage("abcd", "zzabxdzz") == 0.75 and evidence.coverage("", "a") == 0.0


def test_documents_are_dealt_and_folded_once(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(4000)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "text number 3999")], "item_id int, text string")
    got = anchors.located(docs, items, 0.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1
    assert got.rdd.getNumPartitions() > 1
    assert [tuple(r) for r in got.collect()] == [(3999, 1, 0, 0, 16)]


def test_texts_scanned_as_one_stay_apart(monkeypatch):
    """The same is found in a text whatever stands beside it, in stretches of any size; nothing lies across two texts."""
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice(["tax", "law", "of", "act", "x1"]) for _ in range(n))
    items = ["a", "ab", "tax law"] + [say(rnd.choice([3, 8, 20])) for _ in range(12)]
    texts = [items[-1][:20], items[-1][20:], "", "a"] + [noisy(rnd, rnd.choice(["", say(9)]) + rnd.choice(items), rnd.choice([0, 1, 4])) for _ in range(60)] + ["", items[-1]]
    seeds = anchors.Seeds(items, [len(x) // 10 for x in items])
    want = [(t, i, *b) for t, x in enumerate(texts) for i, p in enumerate(items) if (b := plain(p, x))[0] <= len(p) // 10]
    assert len(want) > 60 and seeds.found(texts) == want
    for stretch in (1, 100, 1 << 17):
        monkeypatch.setattr(anchors, "STRETCH", stretch)
        assert [(first + t, *f) for first, held in anchors.stretches(texts) for t, *f in seeds.found(held)] == want
    assert anchors.Seeds([], []).found(texts) == [] and list(anchors.stretches([])) == []
