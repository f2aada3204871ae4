"""Operators on literal rows: nulls, ties, empty input, known values."""

import math

import pytest
from pyspark.sql import functions as F

from sparrowmill.functions import cues, evidence, sequences, spanish
from sparrowmill.operators import calendar, chunking, evaluation, grouping, logs, quality, records, relational, resampling, retrieval, text
from sparrowmill.sources import files


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


def test_left_join_keeps_sums_null_and_counts_zero(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    part = spark.createDataFrame([(1, 3, 2.5)], "k int, n long, s double")
    got = {r.k: (r.n, r.s) for r in relational.left_joined(base, [(part, ["n"])], "k").collect()}
    assert got == {1: (3, 2.5), 2: (0, None)}


def test_null_safe_anti_join_matches_null_with_null(spark):
    a = spark.createDataFrame([(1, None), (1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted((r.k, r.v or "") for r in relational.null_safe_anti_join(a, b, ["k"], ["v"]).collect()) == [(1, "x"), (2, "")]


def test_latest_per_key_is_total_on_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, None, "c")], "k int, d int, v string")
    got = relational.latest_per_key(df, ["k"], [F.desc_nulls_last("d"), F.desc("v")]).collect()
    assert [r.v for r in got] == ["b"]


def test_total_row_stays_apart_from_a_null_group(spark):
    df = spark.createDataFrame([(None,), ("a",)], "g string")
    got = {r.g: r.n for r in grouping.with_total(df, "g", [F.count("*").alias("n")]).collect()}
    assert got == {None: 1, "a": 1, "TOTAL": 2}


def test_histogram_shows_empty_bins_and_skips_nulls(spark):
    df = spark.createDataFrame([(0,), (9,), (None,)], "x long")
    assert [r.n for r in grouping.histogram(df, "x", 5).orderBy("bin").collect()] == [1, 0, 0, 0, 1]


@pytest.mark.parametrize(("rule", "expected"), [("half_even", 3), ("half_up", 4), ("floor", 4), ("upper", 3)])
def test_percentile_rules_differ(spark, rule, expected):
    c = grouping.nearest_rank(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), 0.5 + 0.0, rule) if rule != "floor" else grouping.nearest_rank(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), 0.75, rule)
    if rule == "half_up":
        c = grouping.nearest_rank(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]), 0.84, rule)
    assert one(spark, c) == expected


def test_rules_flag_and_unknown_is_not_marked(spark):
    rules = [quality.Rule("R1", "f1", "a > 1", "rows"), quality.Rule("R2", "f2", "b = 'x'", "rows")]
    df = spark.createDataFrame([(1, 2, None), (2, None, "x"), (3, 5, "x")], "k int, a int, b string")
    flagged = quality.flagged(df, rules)
    assert [r.n_flags for r in flagged.orderBy("k").collect()] == [1, 1, 2]
    got = {r.rule: (r.marked, r.total, r.examples) for r in quality.report(flagged, rules, "k", 1).collect()}
    assert got == {"R1": (2, 3, "1"), "R2": (2, 3, "2")}


def test_unknown_never_passes_a_filter(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "k int, amount double")
    assert [r.k for r in df.where(retrieval.structured(at_least={"amount": 1})).collect()] == [2]
    assert df.where(retrieval.structured()).count() == 2


def test_normal_forms_differ(spark):
    value = "Ñandú, ÁÉ-3"
    assert one(spark, text.folded_words(F.col("t")), value) == "nandu ae 3"
    assert one(spark, text.name_form(F.col("t")), value) == "ÑANDU AE"
    assert one(spark, text.spoken_form(F.col("t")), value) == "ñandú áé 3"
    assert one(spark, text.name_form(F.col("t")), "123") is None


@pytest.mark.parametrize(("word", "light", "coarse"), [("licitaciones", "licitacion", "licitacion"), ("contratos", "contrato", "contrato"), ("veces", "vec", "vez"), ("mes", "mes", "mes"), ("2024s", "2024", "2024"), ("ss12", "ss12", "ss12")])
def test_stems(spark, word, light, coarse):
    assert one(spark, text.light_stem(F.col("t")), word) == light
    assert one(spark, text.coarse_stem(F.col("t")), word) == coarse


def test_masks(spark):
    line = "mail a.b@c.org, www.x.com or 555-123-4567; over 8+ years of solid experience"
    assert one(spark, text.masked(F.col("t"), text.PERSONAL), line) == "mail [EMAIL], [URL] or [PHONE]; over 8+ years of solid experience"
    assert "[MASKED]" in one(spark, text.masked(F.col("t"), text.LEAKS, "[MASKED]"), line)


def test_word_errors(spark):
    words = lambda s: F.split(F.lit(s), " ")
    assert one(spark, text.word_error_counts(words("a b c"), words("a x c d"))) == 2
    assert one(spark, text.word_error_counts(words("a"), F.expr("cast(array() as array<string>)"))) == 1


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, [])], "doc_id long, words array<string>")
    asked = spark.createDataFrame([(7, ["a", "a", "z"])], "query_id int, words array<string>")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, asked).collect()}
    idf, mean = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5)), 5 / 3
    assert got == pytest.approx({d: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean)) for d, tf, n in ((1, 1, 2), (2, 2, 3))})


def test_gate_is_strict(spark):
    rows = [(0.5,), (0.499,), (None,)]
    df = spark.createDataFrame(rows, "s double").select(retrieval.gated(F.col("s"), 0.5).alias("g"))
    assert [r.g for r in df.collect()] == ["answer", "abstain", "abstain"]


def test_intervals_and_runs(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 12, 13)], "k int, s int, e int")
    assert sorted((r.s, r.e) for r in evaluation.interval_union(df, "k", "s", "e").collect()) == [(0, 9), (12, 13)]
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 3, 7, 9, 10)], "k int, p int")
    assert sorted((r["first"], r["last"]) for r in evaluation.consecutive_runs(pages, "k", "p").collect()) == [(1, 3), (7, 7), (9, 10)]


def test_f_beta_of_unknown_precision_is_zero(spark):
    assert one(spark, evaluation.f_beta(F.lit(None).cast("double"), F.lit(0.5), 0.5)) == 0.0


def test_price_window_wraps_midnight(spark):
    windows = spark.createDataFrame([("m", 1320, 360, 1.0), ("m", 360, 1320, 2.0)], "model string, start int, end int, price double")
    calls = spark.createDataFrame([("m", m) for m in (0, 359, 360, 1319, 1320)], "model string, minute int")
    assert [r.price for r in logs.priced(calls, windows).orderBy("minute").collect()] == [1.0, 1.0, 2.0, 2.0, 1.0]


def test_snapshot_diff_and_cache(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, d string")
    b = spark.createDataFrame([(2, "y"), (3, "w"), (4, "v")], "k int, d string")
    assert {r.k: r.status for r in logs.snapshot_diff(a, b, "k", "d").collect()} == {1: "obsolete", 2: "existing", 3: "updated", 4: "new"}


def test_split_is_disjoint_and_deterministic(spark):
    df = spark.range(1000).withColumn("s", F.col("id") % 2)
    split = lambda: {r.id: r.split for r in resampling.stratified_split(df, "id", F.col("s").cast("string"), "q", (0.7, 0.15), 10).collect()}
    first = split()
    assert first == split() and len(first) == 1000
    assert sum(v == "train" for v in first.values()) == 700


def test_calendar(spark):
    assert str(one(spark, calendar.any_date(F.col("t"), ["yyyy-MM-dd", "dd/MM/yyyy"]), "31/12/2023")) == "2023-12-31"
    assert one(spark, calendar.any_date(F.col("t"), ["yyyy-MM-dd"]), "no") is None
    assert one(spark, calendar.decimal_year(F.lit(2020), F.lit(13), 6)) == pytest.approx(2020 + 11 / 12)


def test_packed_chunks_fit_and_keep_words():
    body = "\n".join(["UNO DOS TRES", *(f"palabra{i} " * 40 for i in range(10))])
    chunks = list(chunking.packed(body, 300, 40))
    assert all(len(c) <= 300 for c in chunks)
    assert {w for c in chunks for w in c.split()} == set(body.split())
    assert list(chunking.packed("", 100, 10)) == []
    with pytest.raises(ValueError):
        list(chunking.packed("x", 10, 10))


def test_chunks_end_where_the_text_allows_it():
    body = "TITULO UNO\nHola a todos. Esto es 1. una prueba;\nfin de linea\n\n2) otro punto\nCAPITULO\ncosas y mas cosas"
    flow, places, kinds = chunking.flowing(body)
    assert flow == "TITULO UNO\nHola a todos. Esto es 1. una prueba; fin de linea\n2) otro punto\nCAPITULO\ncosas y mas cosas"
    ends = {flow[:p].split()[-1]: k for p, k in zip(places, kinds, strict=True)}
    assert ends["UNO"] == chunking.AFTER_HEADING == ends["CAPITULO"] and ends["1."] == chunking.BETWEEN_WORDS
    assert ends["todos."] == chunking.SENTENCE == ends["prueba;"] and ends["linea"] == chunking.PARAGRAPH == ends["punto"]
    assert not any(c.endswith("CAPITULO") for n in range(20, 90) for c in chunking.packed(body, n, 0) if len(c) > 8)
    assert " ".join(chunking.packed(body, 40, 0)).split() == body.split()
    assert chunking.packed("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 5]


@pytest.mark.parametrize(("said", "digits"), [("seis mil quinientos", "6500"), ("tres mil", "3000"), ("veinte", "20"), ("ciento diez soles", "110 soles"), ("mil doscientos cincuenta", "1250"), ("treinta y cinco", "35"), ("un año ocho meses", "1 año 8 meses"), ("unas cuartos", "unas cuartos"), ("4,500 y 1.5", "4500 y 1.5"), ("uno", "uno"), ("", ""), ("treinta y un mil", "31000"), ("veintiún años", "21 años"), ("un millón doscientos mil", "1200000"), ("dos, tres", "2, 3"), ("cero", "0")])
def test_spoken_numbers(said, digits):
    assert spanish.spoken_numbers(said) == digits


SAID = "Tengo experiencia total de un año ocho meses. Mi último puesto fue analista de datos en una empresa. Manejo Python y SQL. Antes ganaba dos mil soles. Mi pretensión salarial es tres mil soles. Estoy disponible a partir del 15 de marzo. Mi inglés es intermedio."
FIELDS = [
    cues.Field("years", r"\d+ anos?(?: \d+ meses)?", lambda m: round(evidence.durations(m.group())[0][0], 2), {"experien": 2.0, "edad": -3.0}),
    cues.Field("pay", r"\d{3,6}(?: soles)?", lambda m: float(m.group().split()[0]), {"pretensi": 3.0, "ganaba": -3.0}, 5),
    cues.Field("role", r"puesto (?:fue|es) (\w+ de \w+|\w+)", lambda m: m[1]),
    cues.Field("english", "basico|intermedio|avanzado", cues={"ingles": 1.0}, reach=4, least=0.1),
    cues.Field("never", "nada de nada"),
]


def test_fields_and_verification(spark):
    assert cues.extracted(SAID, FIELDS) == {"years": 1.67, "pay": 3000.0, "role": "analista de datos", "english": "intermedio", "never": None}
    assert cues.listed(SAID, ["SQL", "Python", "Scala"]) == ["Python", "SQL"]
    got = one(spark, records.fields(F.col("t"), FIELDS, {"years": "double", "pay": "double"}), SAID)
    assert (got.years, got.pay, got.english, got.never) == (1.67, 3000.0, "intermedio", None)
    assert evidence.verified(1.67, SAID)["status"] == "verified"
    assert evidence.verified(3000, SAID)["mode"] == "number"
    assert evidence.verified("analista de datos", SAID)["mode"] == "literal"
    assert evidence.verified("Pretension salarial", SAID)["mode"] == "normal"
    assert evidence.verified("gerente general", SAID)["status"] == "unverified"
    assert evidence.verified("analistas de dato", SAID)["near"] == "analista de datos"
    assert evidence.verified(["Python", "Cobol"], SAID) == {"status": "unverified", "mode": "list", "found_as": None, "near": "Cobol"}
    assert evidence.verified(None, SAID)["status"] == "empty"
    assert evidence.durations("2 anos y medio o 18 meses") == [(2.5, "2 anos y medio"), (1.5, "18 meses")]
    assert evidence.coverage("abcd", "xxabyycd") == 1.0 and evidence.coverage("", "x") == 0.0


ORDER = cues.OrderWords(withdraw="quita(?:me)?|ya no quiero|cambia(?:me)?", price=r"a (\d+(?:\.\d+)?)", measure="vasos?|porcion(?:es)?", sizes=("grande", "chica"), aliases={"saltado": "lomo saltado"})


def test_order_follows_corrections_and_totals(spark):
    menu = ["lomo saltado", "limonada", "ensalada"]
    call = "Quiero dos lomo saltado grandes a 35 soles, una limonada a 8 soles y una ensalada a 10 soles. Quítame la ensalada. Que sean tres vasos de limonada. El total son 94 soles."
    lines = cues.order_lines(call, menu, ORDER)
    assert [(x["item"], x["size"], x["amount"], x["price"]) for x in lines] == [("lomo saltado", "grande", 2, 35.0), ("limonada", None, 3, 8.0)]
    assert cues.order_lines("un saltado a 30", menu, ORDER)[0]["item"] == "lomo saltado" and cues.order_lines("nada", menu, ORDER) == [] == cues.order_lines("x", [], ORDER)
    df = spark.createDataFrame([(call, 94.0, None), (call, 80.0, None), (call, 94.0, 90.0), (None, 1.0, None)], "t string, stated double, other double")
    df = df.withColumn("items", records.order_lines(F.col("t"), menu, ORDER)).withColumn("c", records.order_totals(F.col("items"), F.col("stated")))
    df = df.withColumn("who", records.diagnosed(F.col("c"), F.col("items"), F.col("stated"), F.when(F.col("t").isNotNull(), records.numbers_said(F.coalesce("t", F.lit(""))))))
    assert [(r.c.status, r.c.difference, r.who) for r in df.collect()] == [("ok", 0.0, "ok"), ("discrepancy", -14.0, "recogniser"), ("ok", 0.0, "ok"), ("incomplete", None, "undetermined")]
    two = spark.createDataFrame([([("limonada", None, 3, 8.0), ("ensalada", None, 2, 10.0)],)], f"items {records.LINES}")
    two = two.select(records.paired_discount(F.col("items"), "limonada").alias("a"), records.bundle_discount(F.col("items"), "ensalada", F.lit(15.0)).alias("b"), records.order_totals(F.col("items"), F.lit(36.0), discount=records.paired_discount(F.col("items"), "limonada"))["status"].alias("s"))
    assert tuple(two.first()) == (8.0, 5.0, "ok")
    truth = df.where("stated = 80").select(records.diagnosed_by_truth(F.col("c"), F.col("stated"), F.lit(94.0), F.lit(80.0)).alias("a"), records.diagnosed_by_truth(F.col("c"), F.col("stated"), F.lit(94.0), F.lit(94.0)).alias("b")).first()
    assert tuple(truth) == ("speaker", "recogniser")


def test_matching_and_rows(spark):
    assert cues.matched([{"item": "lomo saltado", "amount": 1}], [{"item": "lomo saltado grande", "amount": 1}]) == 1
    assert cues.matched([{"item": "a b", "amount": 1}] * 2, [{"item": "a b", "amount": 1}, {"item": "c", "amount": 1}]) == 1
    assert sequences.longest_nondecreasing([1, 9, 2, 2, 3]) == [0, 2, 3, 4] and sequences.longest_nondecreasing([]) == []
    lines = [{"x": 50, "y": 1, "h": 10}, {"x": 0, "y": 0, "h": 10}, {"x": 0, "y": 30, "h": 10}]
    assert sequences.reading_rows(lines) == [[1, 0], [2]]
    df = spark.createDataFrame([([1, 9, 2], [(50.0, 1.0, 10.0), (0.0, 0.0, 10.0)])], "v array<int>, lines array<struct<x:double,y:double,h:double>>")
    assert tuple(df.select(records.anchors(F.col("v")), records.page_rows(F.col("lines"))).first()) == ([0, 2], [[1, 0]])
    assert one(spark, records.field_correct(F.col("t"), F.lit("LIMA ")), "lima") and not one(spark, records.field_correct(F.lit(1.0), F.lit(1.2), 0.1))


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1, x \n2,NA\n")
    df = files.strict_csv(spark, str(tmp_path / "a.csv"), ["id"])
    assert [(r.id, r.name) for r in df.orderBy("id").collect()] == [("1", "x"), ("2", "NA")]
    with pytest.raises(ValueError, match="missing columns: z"):
        files.strict_csv(spark, str(tmp_path / "a.csv"), ["z"])
    for month, rows in (("2024-01", "p/id,p/v\n1,\n"), ("2024-02", "p/id,p/v\n2,7\n")):
        (tmp_path / "m" / month).mkdir(parents=True)
        (tmp_path / "m" / month / "t.csv").write_text(rows)
    got = {(r.id, r.v, r.source_month) for r in files.month_tables(spark, str(tmp_path / "m"), "t", "p/").collect()}
    assert got == {("1", None, "2024-01"), ("2", "7", "2024-02")}
    (tmp_path / "s.md").write_text("A: hola\nnada\nB:  adiós\n")
    assert [(r.speaker, r.text) for r in files.speaker_lines(spark, str(tmp_path / "s.md")).orderBy("line").collect()] == [("A", "hola"), ("B", "adiós")]
    wide = spark.createDataFrame([("1", "a", "", "b")], "d1 string, v1 string, d2 string, v2 string")
    assert files.repeated_groups(wide, [["d1", "v1"], ["d2", "v2"]], ["d", "v"], []).count() == 1


def test_versions_rank_amendments_before_they_meet_hits(spark):
    hits = spark.createDataFrame([(i, [1, i % 3]) for i in range(1, 7)], "hit_id long, articles array<int>")
    offers = spark.createDataFrame([(20, [1, 1], 0), (21, [1], 1), (22, [2, 0], 0), (3, [1], 0)] + [(i, [1], 2) for i in range(30, 60)], "amendment_id long, articles array<int>, rank int")
    out = logs.versions_for(hits, offers, 2, 4)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.hit_id, r.position)):
        got.setdefault(r.hit_id, []).append(r.amendment_id)
    # an article that an amendment names twice takes one turn
    assert got == {i: ([20, 21] if i % 3 == 1 else [20, 22, 21]) for i in range(1, 7)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan[plan.index("Join Inner") :]
