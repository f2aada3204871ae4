"""Headings that were misread, what follows them, and words that only look like headings."""

from sparrowmill.operators import structure

KEYWORDS = {"title": "TITULO", "chapter": "CAPITULO", "article": "ARTICULO"}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_headings(spark):
    text = "Preámbulo\nCAPÍTULO 12. De las obras\n«ARTlCUL0 l5.- Objeto\nCAPITULO\nDISPOSICIONES FINALES\nTlTULO O7\nsigue aquí\nCAPTURA 3\n\n123\nCapítulo I"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, level string")
    got = [(r.line, r.level, r.distance, r.number, r.title) for r in structure.headings(df, KEYWORDS).orderBy("line").collect()]
    assert got == [(1, "chapter", 0, 12, "De las obras"), (2, "article", 2, 15, "Objeto"), (3, "chapter", 0, None, "DISPOSICIONES FINALES"), (5, "title", 1, 7, ""), (10, "chapter", 0, 1, "")]


def test_words_near_a_keyword_like_plain_distances(spark):
    words = [w[:i] + c + w[i + d :] for w in KEYWORDS.values() for i in range(len(w)) for c in ("", "X", "0") for d in (0, 1, 2)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: (r.level, r.distance) for r in structure.headings(df, KEYWORDS).collect()}
    want = {}
    for i, w in enumerate(words):
        near = [(edits(w, k), n, level) for n, (level, k) in enumerate(KEYWORDS.items()) if edits(w, k) <= len(k) // 4]
        if near:
            want[i] = (min(near)[2], min(near)[0])
    assert got == want
