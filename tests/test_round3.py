"""Odd rows and larger jobs that earlier tests did not have."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sparrowmill import plans
from sparrowmill.functions import spanish
from sparrowmill.operators import hybrid, norms, pruned, retrieval
from sparrowmill.scratch import spread

from compare import rows_of_spark, rows_of_sql


def both(spark, tmp_path, query, **tables):
    """Rows of a query and of its SQL over tables of our own."""
    c = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        c.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    return rows_of_spark(plans.QUERIES[query](spark, str(tmp_path))), rows_of_sql(c, plans.ORACLE_SQL[query])


ORDERS = [(1, 7, "1995-01-01 00:00:00"), (2, 7, None), (3, 7, "1996-01-01 00:00:00"), (4, 8, None), (5, None, "1995-05-01 00:00:00"), (6, None, None), (7, 9, None), (8, 9, "1995-01-01 00:00:00")]


def orders(spark):
    return spark.createDataFrame(ORDERS, "o_orderkey long, o_custkey long, o_orderdate string").withColumn("o_orderdate", F.to_timestamp("o_orderdate"))


def test_gaps_open_at_no_unknown_date(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "interval_gaps", orders=orders(spark))
    assert got == wanted == (["gap_from", "gap_to", "o_custkey"], [("1156", "1461", "7")])


def test_union_counts_no_island_of_unknown_dates(spark, tmp_path):
    got, wanted = both(spark, tmp_path, "interval_union", orders=orders(spark))
    assert got == wanted
    assert {r[2]: r[1] for r in got[1]} == {"7": "2", "8": "1", "9": "1", "null": "1"}


def test_best_documents_do_not_hang_on_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 3}", "all"]) for i in range(60)] + [(60, []), (61, None)], "doc_id long, words array<string>")
    asked = spark.createDataFrame([(q, [f"w{q}", "all", None, "none"]) for q in range(7)] + [(7, ["none"])], "query_id long, words array<string>")
    full = retrieval.top(retrieval.bm25(docs.where("words is not null"), asked), 5, [F.desc(F.round("score", 9)), F.col("doc_id")])
    wanted = sorted((r.query_id, r["rank"], r.doc_id) for r in full.collect())
    monkeypatch.setattr(pruned, "WORDS_A_BLOCK", 20)
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in pruned.best(docs, asked, 5).collect()) == wanted


SHOP = "/root/testdata/sf0.001"


def test_calls_withdraw_items_and_lack_prices(spark):
    rows = plans.QUERIES["extract_order"](spark, SHOP)
    assert rows.where("price is null").count() > 0 and rows.where("item = 'ensalada'").count() == 0


def test_every_kind_of_verdict_is_given(spark):
    rows = plans.QUERIES["transcript_to_verdict"](spark, SHOP).select("status", "who").distinct().collect()
    assert {tuple(r) for r in rows} == {("ok", "ok"), ("discrepancy", "speaker"), ("discrepancy", "recogniser"), ("incomplete", "undetermined")}


def test_words_are_deleted_too(spark):
    assert {r.op for r in plans.QUERIES["word_diff"](spark, SHOP).select("op").distinct().collect()} == {"replace", "insert", "delete"}


def test_rows_of_a_page_hold_their_lines(spark):
    rows = plans.QUERIES["page_reading_order"](spark, SHOP)
    assert rows.columns == ["l_orderkey", "row", "lines"]
    assert rows.where("lines like '%,%'").count() > 0


def test_best_of_block_like_full_scores():
    rnd = np.random.default_rng(5)
    held = [np.minimum(rnd.zipf(1.3, n), 400) for n in rnd.integers(1, 40, 800)]
    own = pd.DataFrame({"doc_id": np.arange(800), "len": [len(h) for h in held], "held": held})
    idf = {t: float(np.log(1 + (800 - n + 0.5) / (n + 0.5))) for t in range(1, 401) if (n := sum(t in h for h in held))}
    asking = pd.DataFrame([(q, t, idf.get(t, 1.0)) for q in range(60) for t in {1, 2 + q % 5, *rnd.integers(1, 401, 3).tolist()}], columns=["query_id", "term", "idf"])
    mean = float(own["len"].mean())
    got = pruned.best_of_block(5, mean)(own, asking)
    for q, part in asking.groupby("query_id"):
        scores = [(-round(sum(i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(h) / mean)) for t, i in zip(part["term"], part["idf"]) if (tf := int((h == t).sum()))), 9), d) for d, h in enumerate(held)]
        assert [(-round(s, 9), d) for s, d in zip(got[got["query_id"] == q]["score"], got[got["query_id"] == q]["doc_id"])] == [x for x in sorted(scores)[:5] if x[0] < 0]


def test_rows_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    spark.range(9000).coalesce(1).write.parquet(str(tmp_path / "t"))
    dealt = spread(spark.read.parquet(str(tmp_path / "t")), "id")
    held = [r[0] for r in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(held) > 8 and sum(held) == 9000
    assert spread(spark.range(0), "id").count() == 0


def test_interviews_are_dealt_over_tasks(spark):
    assert plans.QUERIES["extract_interview"](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() > 8


def test_normal_form_of_marks_and_cardinals():
    assert spanish.plain("ÀÉîõü Ñandú ¡Ｓí! á⃐") == "aeiou nandu ¡ｓi! a"
    assert spanish.normal("Mil uno, veintiún MILES y treinta y dos mil; mil millones un año, una casa. cien, cero y millón") == "1001 21 miles y 32000 1000000001 ano una casa 100 0 y millon"


def test_versions_meet_in_blocks_and_once(spark, tmp_path, monkeypatch):
    parts = [(143 * i, 5 if i % 2 else i % 4) for i in range(60)] + [(11 * i, i % 3 or None) for i in range(90)] + [(13 * i, 5) for i in range(40)] + [(143, 1), (143, 2), (286, 1), (286, 2), (286, 5)] * 3
    monkeypatch.setattr(norms, "MEETING", 16)
    got, wanted = both(spark, tmp_path, "versions_both_ways", part=spark.createDataFrame(parts, "p_partkey long, p_size int"))
    assert got == wanted and len(got[1]) > 500
    plan = plans.QUERIES["versions_both_ways"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_best_within_filters_like_full_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{i % 7}", f"w{i % 3}", "all", f"w{i % 5}"] * (1 + i % 2)) for i in range(90)] + [(90, []), (91, None)], "doc_id long, words array<string>")
    members = spark.createDataFrame([(f, i) for i in range(92) for f in (1, 2, 3) if i % f == 0], "filter_id long, doc_id long")
    asked = spark.createDataFrame([(q, 1 + q % 4, [f"w{q % 7}", "all", "w1", None, "none"]) for q in range(12)], "query_id long, filter_id long, words array<string>")
    full = retrieval.top(hybrid.lexical(docs, asked, members).where("doc_id <> query_id and score > 0"), 6, [F.desc(F.round("score", 9)), F.col("doc_id")])
    form = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 8)) for r in df.collect())
    wanted = form(full)
    monkeypatch.setattr(pruned, "WORDS_A_BLOCK", 60)
    got = form(pruned.best_within(docs, asked, members, 6))
    assert got == wanted and len(wanted) == 54, sorted(set(got) ^ set(wanted))


def test_units_are_added_up_before_draws(spark):
    plan = plans.QUERIES["error_rate_intervals"](spark, SHOP)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.rindex("__md5") :]


def test_orders_and_documents_are_dealt_over_tasks(spark):
    for name in ("extract_order", "verify_literal", "transcript_to_verdict", "cleaning_audit"):
        assert "RepartitionByExpression" in plans.QUERIES[name](spark, SHOP)._jdf.queryExecution().optimizedPlan().toString(), name


def test_corrected_calls_are_judged(spark):
    rows = plans.QUERIES["transcript_to_verdict"](spark, SHOP).where("call = 'corrected'").groupBy("who").count().collect()
    assert {r.who for r in rows} == {"ok", "speaker"} and sum(r[1] for r in rows) == spark.read.parquet(f"{SHOP}/orders.parquet").count()
