"""Repeated passages whatever earlier documents hold of them, whatever digests do, and whatever columns are called."""

import random

import numpy as np
from pyspark import cloudpickle

from sparrowmill.llm import substring_dedup

WORDS = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in ("n", "rt", "st", "mp")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def covered(spark, rows, doc):
    return sum(r.end - r.begin for r in substring_dedup.repeated_spans(table(spark, rows)).collect() if r.doc_id == doc)


def woven(rnd, passage, n):
    """Documents that each hold a piece of under 160 bytes of a passage."""
    out = []
    for i in range(n):
        at = rnd.randrange(len(passage) - 150)
        out.append((i, f"{prose(rnd, 60)} {passage[at : at + 150]} {prose(rnd, 60)}"))
    return out


def test_earlier_owners_of_pieces_hide_nothing(spark):
    rnd = random.Random(5)
    passage = prose(rnd, 220)
    rows = woven(rnd, passage, 60) + [(500, f"{prose(rnd, 50)} {passage} {prose(rnd, 50)}"), (600, f"{prose(rnd, 70)} {passage} {prose(rnd, 30)}")]
    assert covered(spark, rows, 600) >= len(passage)
    assert covered(spark, rows, 500) == 0
    rows = [(i, t) for i, t in rows if i < 600] + [(600 + i, f"{prose(rnd, 20)} {passage[i * 30 : i * 30 + 310]} {prose(rnd, 20)}") for i in range(20)]
    got = {r.doc_id: 0 for r in substring_dedup.repeated_spans(table(spark, rows)).collect()}
    for r in substring_dedup.repeated_spans(table(spark, rows)).collect():
        got[r.doc_id] += r.end - r.begin
    assert all(got.get(600 + i, 0) >= 300 for i in range(20))


def test_equal_digests_of_other_texts_remove_nothing(spark, monkeypatch):
    """All seeds have one of sixteen digests, and sizes meet often."""
    rnd = random.Random(6)
    plain = substring_dedup.range_hashes
    monkeypatch.setattr(substring_dedup, "range_hashes", lambda *x: plain(*x) & np.uint64(0xF00000000000000))
    cloudpickle.register_pickle_by_value(substring_dedup)
    try:
        passage = prose(rnd, 100)
        rows = [(i, prose(rnd, 400)) for i in range(30)]
        assert substring_dedup.repeated_spans(table(spark, rows)).count() == 0
        rows += [(50, f"{prose(rnd, 9)} {passage}"), (60, f"{passage} {prose(rnd, 9)}")]
        texts = {i: t.encode() for i, t in rows}
        for r in substring_dedup.repeated_spans(table(spark, rows)).collect():
            assert texts[r.doc_id][r.begin : r.end].strip() in texts[r.first_doc_id]
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)


def test_columns_of_any_name_stay(spark):
    rnd = random.Random(7)
    passage = prose(rnd, 80)
    names = ["text_hash", "__hash0", "__spans0", "__spans", "__hit0", "__word0", "__bits0", "begin", "digest", "first_doc_id", "chunk", "n_chars"]
    rows = [(1, passage, *(f"{n}1" for n in names)), (2, f"{prose(rnd, 20)} {passage}", *(f"{n}2" for n in names)), (None, passage, *(f"{n}3" for n in names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = substring_dedup.deduplicated(df)
    assert got.columns == df.columns
    kept = {r.doc_id: r for r in got.collect()}
    assert set(kept) == {1, 2} and kept[1].text == passage and passage not in kept[2].text
    for i in (1, 2):
        assert [kept[i][n] for n in names[:-1]] == [f"{n}{i}" for n in names[:-1]]
