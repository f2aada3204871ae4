"""Sources and sinks on small files."""

import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from sparrowmill.sources import files, sqlite


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute('create table "votes" (id integer primary key, user_id int, "valor x" real, note text)')
        db.executemany("insert into votes values (?, ?, ?, ?)", [(i, i % 3, i / 2, None if i % 5 else f"n{i}") for i in range(1, 101)])
        db.execute("create table none (a text)")
    df = sqlite.table(spark, path, "votes", 7)
    assert dict(df.dtypes) == {"id": "bigint", "user_id": "bigint", "valor x": "double", "note": "string"}
    assert df.count() == 100 and df.agg(F.sum("valor x")).first()[0] == sum(i / 2 for i in range(1, 101))
    assert df.where("note is not null").count() == 20 and sqlite.table(spark, path, "none").count() == 0


def test_zip_entries(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/a.csv", "id\n1\n" * 500)
        z.writestr("b.txt", "no")
    got = files.zip_entries(spark, str(tmp_path / "a.zip"), ".csv").collect()
    assert [(r.name, r.size) for r in got] == [("x/a.csv", 2500)] and bytes(got[0].content) == b"id\n1\n" * 500
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[60] ^= 255
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.zip").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="CRC|Error|invalid"):
        files.zip_entries(spark, str(tmp_path / "bad"), "").collect()


def test_page_store_round_trip(spark, tmp_path):
    rows = [("d1", "v1", 1, "uno", "texto", [(1.0, 0, "uno", 2.0)]), ("d1", "v1", 2, None, "ocr", []), ("d2", "v1", 1, "dos", "texto", None)]
    df = spark.createDataFrame(rows, files.PAGE)
    files.write_pages(df, str(tmp_path / "p"))
    back = spark.read.json(str(tmp_path / "p"))
    assert back.count() == 3 and set(back.columns) >= {"document", "page"}
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.json").write_text('{"document": "d", "page": 1,\n"text": "t", "lines": [{"y": 1.5}]}')
    (tmp_path / "q" / "2.json").write_text('{"document": "d", "page": null, "text": "t"}')
    got = files.page_store(spark, str(tmp_path / "q")).collect()
    assert [(r.document, r.page, r.lines[0].y) for r in got] == [("d", 1, 1.5)]


def test_logs_and_nested_items(spark, tmp_path):
    df = spark.createDataFrame([(1, [("a", 2), ("b", 3)])], "k int, items array<struct<n:string,q:int>>")
    assert sorted(tuple(r) for r in files.nested_items(df, "k", "items", {"name": "n", "amount": "q"}).collect()) == [(1, "a", 2), (1, "b", 3)]
    log = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log, str(tmp_path / "log"))
    part = next((tmp_path / "log").glob("*.json"))
    (tmp_path / "log" / f".{part.name}.crc").unlink()
    with open(part, "a") as out:
        out.write('{"id": 3, "v"\n')
    assert files.json_lines(spark, str(tmp_path / "log"), log.schema).count() == 4


def test_names_texts_and_samples(spark, tmp_path):
    df = spark.createDataFrame([("clip_noise_10.json",), ("other",)], "path string")
    got = files.name_parts(df, "path", r"clip_([a-z]+)_(\d+)", ["family", "level"]).collect()
    assert [(r.family, r.level) for r in got] == [("noise", "10"), (None, None)]
    csv, scripts = spark.createDataFrame([("a", ""), ("b", "x")], "k string, t string"), spark.createDataFrame([("a", "y"), ("c", "z")], "k string, t string")
    assert {(r.k, r.t) for r in files.reference_texts(csv, scripts, "k", "t").collect()} == {("a", "y"), ("b", "x"), ("c", "z")}
    files.write_sample(spark.range(10), str(tmp_path / "s"), ["id"], 3)
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 3
    good, bad = files.split_valid(spark.range(4), F.when(F.col("id") > 1, F.array(F.lit("large"), F.lit("odd"))).otherwise(F.expr("cast(array() as array<string>)")))
    assert good.count() == 2 and {r.errors for r in bad.collect()} == {"large; odd"}
    files.write_rejected([bad, spark.createDataFrame([("n",)], "note string")], str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert [c.lstrip("﻿") for c in back.columns] == ["id", "errors", "note"] and back.count() == 3
    for kind in ("csv", "json"):
        files.write_report(spark.range(3), str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", True).load(str(tmp_path / kind)).count() == 3
    assert files.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n|---|---|\n| 1 |  |\n"
    with pytest.raises(ValueError, match="over 2 rows"):
        files.markdown(spark.range(3), 2)
    assert len(spark.range(1).select(files.collection_name("p", "c", "m")).first()[0]) == 10


def test_numbers_and_places(spark, tmp_path):
    df = spark.createDataFrame([(" 1.0",), ("2.5",), ("",), ("x",)], "v string")
    assert [r.v for r in files.numbers(df, ["v"]).collect()] == [1.0, 2.5, None, None]
    assert [r[0] for r in df.select(files.whole_or_fraction(F.col("v"))).collect()] == ["1", "2.5", None, "x"]
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert sorted((r.id, r.row_number) for r in files.numbered_rows(spark, str(tmp_path / "t")).collect()) == [(i, i + 1) for i in range(5)]
