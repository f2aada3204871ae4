"""The pipeline's stages one by one, and as a whole against plain Python."""

import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_corpus_operators import PASSAGE, brute_groups, library, table  # noqa: E402


def test_stages_keep_columns_and_take_effect(spark):
    filler = lambda k: " ".join(f"{'abcdefgh'[(k * 7 + i) % 8]}{k * 1000 + i}q" for i in range(120))
    rows = [(1, f"{filler(1)} {PASSAGE}"), (2, f"{PASSAGE} {filler(2)}"), (3, filler(3)), (4, filler(3) + " extra"), (5, "123 !!"), (6, None), (7, filler(7)), (None, filler(8))]
    docs = table(spark, rows)
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language"](spark, docs, "")
    assert kept.columns == names and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 7, None], key=str)
    one = stage["near_duplicates"](spark, kept, "")
    groups = brute_groups([(i, t) for i, t in rows if i in (1, 2, 3, 4, 7)])
    assert one.columns == names and sorted(r.doc_id for r in one.collect() if r.doc_id) == sorted({c for _, c in groups.values()})
    cut = stage["repeated_passages"](spark, one, "")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == names and "word40" in texts[1] and "word40" not in texts[2]
    mixed = stage["mixture"](spark, cut, "")
    assert mixed.columns == names and mixed.count() >= 1
    assert stage["tokens"](spark, mixed, "").count() == mixed.count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_run_gives_every_row(spark, tmp_path):
    """From Parquet to tokens, row by row; with one source the mix takes every document once."""
    filler = lambda k: " ".join(f"{'abcdefgh'[(k * 7 + i) % 8]}{k * 1000 + i}q" for i in range(120))
    rows = [(1, f"{filler(1)} {PASSAGE} {filler(9)}"), (2, f"{filler(2)} {PASSAGE} {filler(5)}"), (3, filler(3)), (4, filler(3) + " extra"), (5, "123 !!"), (6, None), (7, filler(7)), (8, filler(7)), (None, filler(8))]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    root = brute_groups([r for r in kept if r[0] is not None])
    kept = [(i, t) for i, t in kept if i is None or root[i][1] == i]
    kept = [(i, t.replace(f"{PASSAGE} ", "") if i == 2 else t) for i, t in kept]
    expected = []
    tok = library("word_bpe_49k.json")
    for i, t in kept:
        ids = tok.encode(t, add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)


def test_run_on_odd_tables(spark, tmp_path):
    """Empty tables, blank texts, repeated and null ids, and sources that the mix weighs otherwise."""
    table(spark, [(1, "x")]).where("false").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    table(spark, [(1, None), (2, ""), (None, None), (3, " ")]).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    filler = lambda k, n=60: " ".join(f"{'abcdefgh'[(k * 7 + i) % 8]}{k * 1000 + i}q" for i in range(n))
    rows = [*[(i, filler(i)) for i in range(1, 41)], (1, filler(100)), (None, filler(101)), (None, filler(102)), (90, filler(2) + " more")]
    table(spark, rows, source=lambda i: "a" if i is None or i % 4 else "b").write.parquet(f"{tmp_path}/c/documents.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/c").collect()]
    assert got.count(None) == 2 and 90 not in got
    a, b = [i for i in got if i and i % 4], [i for i in got if i and i % 4 == 0]
    # source b has 600 of 2,620 words and a target of two thirds of them, in documents of 60 words
    assert len(b) == round(2620 * 2 / 3 / 60) and set(b) == set(range(4, 41, 4)) and 0 < len(a) < 33 and max(a.count(i) for i in set(a)) <= 2
