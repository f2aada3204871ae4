"""Indexes, searches, roll-ups and streams on literal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import config
from sparrowmill.operators import benchmarks, indexing, logs, norms, predictors, questions, retrieval, text
from sparrowmill.streaming import events


def vectors(spark, n=300):
    rnd = np.random.default_rng(3)
    m = rnd.normal(size=(n, 16))
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(n, None), (n + 1, [0.5, 0.5])], "vec_id long, embedding array<double>")


def brute(m, q, k, others=False):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit[q]
    return [int(i) for i in np.lexsort((np.arange(len(m)), -np.round(near, 9))) if not (others and i == q)][:k]


def test_nearest_in_blocks_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTORS_A_BLOCK", 64)
    monkeypatch.setattr(retrieval, "QUERIES_A_BLOCK", 2)
    m, df = vectors(spark)
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for others in (False, True):
        got = {}
        for r in retrieval.nearest(df, asked, 7, others=others).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == {q: brute(m, q, 7, others) for q in range(0, 300, 50)}
    assert retrieval.nearest(df, asked, 3, F.col("vec_id") < 0).count() == 0


def test_unknown_mode_is_refused(spark):
    one = spark.createDataFrame([(1, 2, 0.5, 1)], "query_id int, id int, score double, rank int")
    assert retrieval.found_by("bm25", one, one, "id", 1).count() == 1
    with pytest.raises(ValueError, match="unknown mode"):
        retrieval.found_by("magic", one, one, "id", 1)


def test_index_builds_are_repeatable_and_resume(spark, tmp_path):
    path, seen = str(tmp_path / "index"), []

    def embed(df):
        seen.append(sorted(r.k for r in df.collect()))
        return df.withColumn("v", F.length("d"))

    first = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, d string")
    second = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "44")], "k string, d string")
    assert indexing.build(spark, first, path, 0, "k", "d", embed).count() == 3
    got = indexing.build(spark, second, path, 1, "k", "d", embed)
    assert sorted((r.k, r.d, r.v) for r in got.collect()) == [("a", "1", 1), ("b", "x", 1), ("d", "44", 2)] and seen == [["a", "b", "c"], ["b", "d"]]
    again = indexing.build(spark, second, path, 1, "k", "d", embed)  # nothing to do
    assert again.count() == 3 and len(seen) == 2
    (tmp_path / "index" / "v1" / "_SUCCESS").unlink()  # a build that broke off is done anew
    assert sorted(r.k for r in indexing.build(spark, second, path, 1, "k", "d", embed).collect()) == ["a", "b", "d"] and len(seen) == 3


def test_trailing_count_of_a_busy_key(spark):
    rows = [(i, "k", f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(0, 600, 7)]
    df = spark.createDataFrame(rows, "id int, k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: r.trailing for r in logs.trailing_count(df, "k", "ts", 60).collect()}
    assert got == {i: sum(i - 60 <= j <= i for j, _, _ in rows) for i, _, _ in rows}


def test_edit_distance():
    assert text.edit_distance("kitten", "sitting") == 3 and text.edit_distance([], [1, 2]) == 2 and text.edit_distance([1, 2], []) == 2
    rnd = np.random.default_rng(5)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(50):
        a, b = (rnd.integers(0, 4, rnd.integers(0, 20)).tolist() for _ in range(2))
        assert text.edit_distance(a, b) == plain(a, b)


def test_effects_of_too_few_pairs_are_open(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("b", -2.0)], "g string, delta double")
    got = {r.g: (r.pairs, r.improved, r.worsened, r.excludes_0) for r in benchmarks.effect(df, ["g"]).collect()}
    assert got == {"a": (1, 0, 1, None), "b": (2, 2, 0, True)}


def test_questions(spark):
    df = spark.createDataFrame([("¿Más de 2 millones?",), ("desde 2020",), ("desde 2,020 soles",), (None,)], "q string")
    got = questions.extracted_filters(df, "q", {}, []).collect()
    assert [r.at_least for r in got] == [2_000_000.0, None, 2020.0, None] and {r.place for r in got} == {None}


def test_page_of_an_offset(spark):
    ends = spark.createDataFrame([([10, 30],)], "e array<long>")
    assert [ends.select(norms.page_of(F.lit(x).cast("long"), F.col("e"))).first()[0] for x in (0, 9, 10, 29, 30)] == [1, 1, 2, 2, 3]


def test_a_stream_is_upserted_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k int, at int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        events.upsert(stream, str(tmp_path / "out"), "k", "at")
    assert sorted(tuple(r) for r in events.current(spark, str(tmp_path / "out"), rows).collect()) == [(1, 20, "b"), (2, 5, "c")]


def test_a_batch_writes_touched_buckets_only(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k int, at int, v string"
    one = spark.createDataFrame([(i, 1, f"a{i}") for i in range(40)], schema)
    one.coalesce(1).write.parquet(source)
    run = lambda: events.upsert(spark.readStream.schema(one.schema).parquet(source), out, "k", "at", buckets=8)
    held = lambda: {r.k: (r.at, r.v) for r in events.current(spark, out, one).collect()}
    files = lambda: {str(p.relative_to(out)): p.stat().st_mtime_ns for p in (tmp_path / "out" / "rows").rglob("part-*.parquet")}
    run()
    before, want = files(), {i: (1, f"a{i}") for i in range(40)}
    assert held() == want
    spark.createDataFrame([(3, 2, "new"), (5, 0, "late"), (99, 1, "more")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    want |= {3: (2, "new"), 99: (1, "more")}
    after = files()
    assert held() == want and all(after[f] == t for f, t in before.items())  # what isn't touched stays as it is
    touched = {f.split("/")[2] for f in after if f.startswith("rows/batch=1/")}
    assert 1 <= len(touched) <= 3
    # the driver was lost after writing the table, before it told the stream: the batch runs again
    (tmp_path / "out" / "checkpoint" / "commits" / "1").unlink()
    for crc in (tmp_path / "out" / "checkpoint" / "commits").glob(".1.crc"):
        crc.unlink()
    run()
    assert held() == want
    spark.createDataFrame([(3, 3, "newest")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert held() == want | {3: (3, "newest")}
    old = {f.split("/")[2] for f in files() if f.startswith("rows/batch=0/")}
    assert not old & touched  # two manifests back, and no longer named


def test_ridge_learns_what_words_say(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(240):
        words = [str(w) for w in rnd.choice(["junior", "senior", "lead", "blue", "green"], 6)]
        rows.append((i, " ".join(words), float(words.count("senior") * 3 + words.count("lead") * 5)))
    df = spark.createDataFrame([*rows, (999, None, 0.0)], "id int, text string, years double")
    model, strength, error = predictors.fitted(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), "text", "years", [1000.0, 0.001])
    assert strength == 0.001 and error < 1.5
    assert predictors.predicted(model, df, "text").count() == 241


def test_settings_name_every_fault():
    settings = [config.Setting("a.size", (int,), lambda x: x > 0, "must be above 0"), config.Setting("a.overlap", (int,)), config.Setting("name", (str,), needed=False)]
    between = [(lambda c: c["a"]["overlap"] < c["a"]["size"], "overlap must be below size")]
    assert config.faults({"a": {"size": 5, "overlap": 1}}, settings, between) == []
    assert config.faults({"a": {"size": 5, "overlap": 9}}, settings, between) == ["overlap must be below size"]
    assert config.faults({"a": {"size": -1, "overlap": True, "x": {}}, "name": 3}, settings, between) == ["a.size must be above 0", "a.overlap is no int", "name is no str", "a.x is unknown"]
    assert config.faults({"a": 3}, settings) == ["a.size is missing", "a.overlap is missing"]
