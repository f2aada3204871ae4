"""Literal cases of operators whose registered queries run over tables: what each makes of texts written for it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparrowmill.functions import cues, evidence
from sparrowmill.operators import benchmarks, cleaning, indexing, norms, questions, records, text

CASES = {}


class Tables:
    def __init__(self, spark):
        self.spark = spark


def query(expected):
    def add(f):
        CASES[f.__name__] = f, expected
        return f

    return add


def values(rows, names):
    """Rows that a case must give, and their columns."""
    return [tuple(r) for r in rows], names.split(", ")


def _literal(t: Tables, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)

PAGES = [
    (1, "DIARIO OFICIAL\nLima, lunes\n\nArtículo 1. Objeto\ncuerpo del texto\nfin\nCódigo: 123\nsobra"),
    (2, "DIARIO OFICIAL\notra cosa\ncuerpo"),
    (3, "sin nada\nFirmado por\nuno"),
    (4, ""),
]

HEADER = ["^DIARIO", "^Lima, "]


@query(values([(1, "~Artículo 1. Objeto~cuerpo del texto~fin~Código: 123~sobra"), (2, "DIARIO OFICIAL~otra cosa~cuerpo"), (3, "sin nada~Firmado por~uno"), (4, "")], "id, page"))
def header_removal(t: Tables) -> DataFrame:
    df = _literal(t, PAGES, "id int, page string")
    return df.select("id", F.array_join(cleaning.without_header(cleaning.lines_of(F.col("page")), HEADER), "~").alias("page"))


@query(values([(1, PAGES[0][1].replace("\n", "~")), (2, PAGES[1][1].replace("\n", "~")), (3, "sin nada"), (4, "")], "id, page"))
def stamp_removal(t: Tables) -> DataFrame:
    df = _literal(t, PAGES, "id int, page string")
    return df.select("id", F.replace(cleaning.without_stamp(F.col("page"), "Firmado por"), F.lit("\n"), F.lit("~")).alias("page"))


@query(values([(1, 7), (2, 3), (3, 3), (4, 1)], "id, n_lines"))
def end_mark_cut(t: Tables) -> DataFrame:
    df = _literal(t, PAGES, "id int, page string")
    return df.select("id", F.size(cleaning.until_end_mark(cleaning.lines_of(F.col("page")), "^Código:")).alias("n_lines"))


@query(values([(1, "sobra"), (2, ""), (3, ""), (4, "")], "id, unaccounted"))
def cleaning_audit(t: Tables) -> DataFrame:
    df = _literal(t, PAGES, "id int, page string").withColumn("lines", cleaning.lines_of(F.col("page")))
    after = cleaning.until_end_mark(cleaning.without_header(F.col("lines"), HEADER), "^Código:")
    return df.select("id", F.array_join(cleaning.audited(F.col("lines"), after, HEADER), "~").alias("unaccounted"))

LINES = [(1, 100.0, [("cabeza", 2.0), ("uno", 20.0), ("dos", 55.0), ("tres", 90.0)]), (2, 50.0, [("x", None), ("y", 30.0)])]


@query(values([(1, "uno,dos,tres", "uno,dos"), (2, "x,y", "y")], "page, below, crop"))
def header_band_and_crop(t: Tables) -> DataFrame:
    df = _literal(t, LINES, "page int, height double, lines array<struct<t:string,y:double>>")
    join = lambda c: F.array_join(F.transform(c, lambda x: x["t"]), ",")
    return df.select("page", join(cleaning.below_band(F.col("lines"), 10.0)).alias("below"), join(cleaning.cropped(F.col("lines"), F.col("height"), 0.2, 0.6, 2)).alias("crop"))


@query(values([(1, "La experiencia laboral continúa aquí.~Otra línea"), (2, "fin.~minúscula tras punto"), (3, "")], "id, line"))
def broken_lines(t: Tables) -> DataFrame:
    df = _literal(t, [(1, "La expe-\nriencia laboral\ncontinúa aquí.\nOtra línea"), (2, "fin.\nminúscula tras punto"), (3, "")], "id int, line string")
    return df.select("id", F.replace(cleaning.mended(F.col("line")), F.lit("\n"), F.lit("~")).alias("line"))


@query(values([(1, "2010–2015 y 2016–present"), (2, "1999–2003"), (3, "2010 2015")], "id, line"))
def date_ranges(t: Tables) -> DataFrame:
    df = _literal(t, [(1, "2010 - 2015 y 2016 to present"), (2, "1999—2003"), (3, "2010 2015")], "id int, line string")
    return df.select("id", cleaning.year_ranges(F.col("line")).alias("line"))

CV = [(1, "Worked 2010 - 2015 as devel-\noper, mail a.b@c.org\n10 years of solid experience"), (2, "nothing")]


@query(values([(1, "Worked 2010–2015 as developer, mail [EMAIL]~[MASKED]", 1, 1, 1), (2, "nothing", 0, 0, 0)], "id, cleaned, n_joined, n_personal, n_leaks"))
def cv_cleaning(t: Tables) -> DataFrame:
    """Cleaning with its audit counters, in one plan."""
    out = cleaning.cleaned(_literal(t, CV, "id int, said string"), "said", text.PERSONAL, text.LEAKS)
    return out.select("id", F.replace("cleaned", F.lit("\n"), F.lit("~")).alias("cleaned"), "n_joined", "n_personal", "n_leaks")


@query(values([(1, 0, "uno dos~tres"), (1, 1, "cuatro cinco seis siete"), (1, 2, "ocho"), (2, 0, "x")], "id, position, chunk"))
def token_chunks(t: Tables) -> DataFrame:
    df = _literal(t, [(1, "uno dos\ntres\ncuatro cinco seis siete\n\nocho"), (2, "x"), (3, "")], "id int, said string")
    return cleaning.token_chunks(df, ["id"], "said", 3).select("id", "position", F.replace("chunk", F.lit("\n"), F.lit("~")).alias("chunk"))

NORMS = [(1, "Según los artículos 5, 6 y 7 y el art. 12 de la Ley"), (2, "artículo 999 y artículo 3"), (3, "sin menciones"), (4, "arts. 8.2 y 9")]


@query(values([(1, "5,6,7,12"), (2, "3"), (3, ""), (4, "8,9")], "id, articles"))
def article_mentions(t: Tables) -> DataFrame:
    df = _literal(t, NORMS, "id int, said string")
    return df.select("id", F.array_join(norms.mentioned(F.col("said"), 200).cast("array<string>"), ",").alias("articles"))


@query(values([(1, 12, "Objeto de la ley"), (2, 3, None), (3, None, None)], "id, article, title"))
def heading_parser(t: Tables) -> DataFrame:
    df = _literal(t, [(1, "Artículo 12.- Objeto de la ley"), (2, "ARTICULO 3"), (3, "En el artículo 3 se dice")], "id int, line string")
    return df.select("id", norms.heading(F.col("line")).alias("h")).select("id", "h.article", "h.title")


@query(values([(1, 0, "artículo 3"), (1, 1, "artículo 4"), (1, 2, "5 de la ley"), (2, 0, "uno")], "id, place, item"))
def amendment_items(t: Tables) -> DataFrame:
    df = _literal(t, [(1, "artículo 3; artículo 4 y 5 de la ley."), (2, "uno"), (3, " ; ")], "id int, said string")
    return df.select("id", F.posexplode(norms.amendment_items(F.col("said"))).alias("place", "item"))


@query(values([(1, "LEY 1", 3, True), (2, "ley uno", 4, True), (3, "otra", 3, False)], "id, name, page, cited"))
def cite_marking(t: Tables) -> DataFrame:
    hits = _literal(t, [(1, "LEY 1", 3), (2, "ley uno", 4), (3, "otra", 3)], "id int, name string, page int")
    citations = _literal(t, [("Ley Uno", 3), ("ley 1", 4), ("ley 1", 4)], "name string, page int")
    return norms.cited(hits, citations, ["page"], {"ley uno": "ley 1"}, "name").select("id", "name", "page", "cited")

PLACES = {"lima": "LIMA", "lima metropolitana": "LIMA METRO", "cusco": "CUSCO", "la libertad": "LA LIBERTAD"}

CATEGORIES = [("obras", ["obra", "construc"]), ("servicios", ["servicio", "consultor"]), ("bienes", ["compra", "bienes"])]

ASKED = [
    (1, "¿Obras en Lima Metropolitana de más de un millón?", "LIMA METRO", "obras", 1000000.0, None), (2, "servicios hasta 50 mil en Cusco", "CUSCO", "servicios", None, 50000.0),
    (3, "compras desde 2023", None, "bienes", None, None), (4, "consultoría entre otras, menos de S/ 1,500.50", None, "servicios", None, 1500.5), (5, "nada", None, None, None, None),
]


def _asked(t: Tables) -> DataFrame:
    return questions.extracted_filters(_literal(t, [x[:2] for x in ASKED], "id int, question string"), "question", PLACES, CATEGORIES)


@query(values([(x[0], *x[2:]) for x in ASKED], "id, place, category, at_least, at_most"))
def question_filters(t: Tables) -> DataFrame:
    return _asked(t).select("id", "place", "category", "at_least", "at_most")


@query(values([(1, "CUSCO", 1000000.0), (2, "CUSCO", None), (3, "CUSCO", None), (4, "CUSCO", 10.0), (5, "CUSCO", None)], "id, place, at_least"))
def stated_filters_win(t: Tables) -> DataFrame:
    asked = _asked(t)
    both = questions.merged({"place": F.lit("CUSCO"), "at_least": F.when(F.col("id") == 4, 10.0)}, {"place": F.col("place"), "at_least": F.col("at_least")})
    return asked.select("id", *[c.alias(n) for n, c in both.items()])

NAMES = [(1, "GOBIERNO REGIONAL DE CUSCO", None, None), (2, "OTRA ENTIDAD", "PROVINCIA DE LIMA", None), (3, "OTRA", "X", "LA LIBERTAD"), (4, "OTRA", None, None)]


@query(values([(1, "CUSCO", "entity"), (2, "LIMA", "province"), (3, "LA LIBERTAD", "department"), (4, None, "unknown")], "id, place, place_by"))
def territory_cascade(t: Tables) -> DataFrame:
    df = _literal(t, NAMES, "id int, entity string, province string, department string")
    places = _literal(t, [(v, v) for v in sorted(set(PLACES.values()))], "name string, value string")
    steps = [("entity", questions.place_in_name(F.col("entity"), r"^GOBIERNO REGIONAL (?:DE )?(.+)$")), ("province", questions.without_prefix(F.col("province"), ["PROVINCIA", "PROVINCIA DE"])), ("department", text.name_form(F.col("department")))]
    return questions.located(df, steps, places, "name", "value").select("id", "place", "place_by")


@query(values([(1, "falló con clave [SECRET] en url"), (2, "normal"), (3, "x" * 300)], "id, message"))
def secret_redaction(t: Tables) -> DataFrame:
    df = _literal(t, [(1, "falló con clave sk-abcDEF1234567890 en url"), (2, "normal"), (3, "x" * 400)], "id int, message string")
    return df.select("id", F.left(F.regexp_replace("message", r"\b(?:sk|key|tok)-[A-Za-z0-9]{12,}", "[SECRET]"), F.lit(300)).alias("message"))


@query(values([("a", "identical"), ("b", "drifted"), ("c", "registered"), ("d", "missing"), ("e", "downloaded")], "id, state"))
def manifest_state(t: Tables) -> DataFrame:
    known = _literal(t, [("a", "1"), ("b", "2"), ("d", "4"), ("e", None)], "id string, digest string")
    return indexing.manifest_state(known, _literal(t, [("a", "1"), ("b", "x"), ("c", "3"), ("e", "5")], "id string, digest string"), "id", "digest")

SPOKEN = [
    ("seis mil quinientos soles", "6500 soles"), ("treinta y un mil", "31000"), ("veintiún años y ocho meses", "21 años y 8 meses"), ("un año y medio", "1 año y medio"),
    ("un millón doscientos mil", "1200000"), ("de 4,500 a 5,250.50", "de 4500 a 5250.50"), ("unas cuantas", "unas cuantas"), ("ciento una", "101"), ("dos, tres y diez", "2, 3 y 10"),
]


@query(values([(i, x[1]) for i, x in enumerate(SPOKEN)], "id, line"))
def spoken_numbers(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(i, x[0]) for i, x in enumerate(SPOKEN)], "id int, line string")
    return rows.select("id", records.spoken_numbers("line").alias("line"))

INTERVIEWS = [
    (1, "Llevo dos años y medio de experiencia en total. Mi último puesto fue contador en un banco. Manejo Excel y SQL. Antes ganaba mil ochocientos soles y mi pretensión es de tres mil soles. Mi inglés es avanzado."),
    (2, "Tengo treinta años de edad y cinco años de experiencia. El puesto era cajera en una tienda. Inglés básico. Sé usar Python."),
    (3, "No recuerdo nada de eso."),
    (4, None),
]

#: What an interview's fields look like; the lists are these queries' own.
INTERVIEW = [
    cues.Field("years", r"\d+ anos?(?: y (?:medio|\d+ mes(?:es)?))?", lambda m: round(evidence.durations(m.group())[0][0], 2), {"experien": 2.0, "total": 1.0, "edad": -3.0}, 6, -2.0),
    cues.Field("pay", r"\d{3,6} soles", lambda m: float(m.group().split()[0]), {"pretensi": 3.0, "espero": 2.0, "ganaba": -3.0, "antes": -1.0}, 6),
    cues.Field("role", r"puesto (?:fue|era) (\w+)", lambda m: m[1]),
    cues.Field("english", "basico|intermedio|avanzado", cues={"ingles": 1.0}, reach=4, least=0.1),
]


@query(values([(1, 2.5, 3000.0, "contador", "avanzado", "Excel,SQL"), (2, 5.0, None, "cajera", "basico", "Python"), (3, None, None, None, None, ""), (4, None, None, None, None, "")], "id, years, pay, role, english, tools"))
def extract_interview(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(INTERVIEWS, "id int, said string")
    found = records.fields(F.col("said"), INTERVIEW, {"years": "double", "pay": "double"})
    return rows.select("id", found.alias("f"), F.array_join(records.listed(F.col("said"), ["Excel", "Python", "SQL"]), ",").alias("tools")).select("id", "f.*", "tools")

CALLS = [
    (1, "Quiero dos lomos saltados grandes a 35 soles y una limonada a 8 soles. Son 78 soles.", 78.0),
    (2, "Una ensalada a 10 soles y tres vasos de limonada a 8 soles. Quítame la ensalada. Son 30 soles.", 30.0),
    (3, "Una limonada a 8 soles, no, mejor dos limonadas a 9 soles. Son 18 soles.", 18.0),
    (4, "Una limonada. Son 5 soles.", 5.0),
    (5, "Dos ensaladas a 10 soles. Son 20 soles.", 25.0),
]

ORDER = cues.OrderWords(withdraw="quita(?:me)?|ya no quiero", price=r"a (\d+(?:\.\d+)?)", measure="vasos?", sizes=("grande", "chica"))

MENU = ["lomo saltado", "limonada", "ensalada"]


def _ordered(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(CALLS, "id int, said string, stated double")
    return rows.withColumn("items", records.order_lines(F.col("said"), MENU, ORDER)).withColumn("total", records.order_totals(F.col("items"), F.col("stated")))


@query(values([(1, "lomo saltado", "grande", 2, 35.0), (1, "limonada", None, 1, 8.0), (2, "limonada", None, 3, 8.0), (3, "limonada", None, 2, 9.0), (4, "limonada", None, 1, None), (5, "ensalada", None, 2, 10.0)], "id, item, size, amount, price"))
def extract_order(t: Tables) -> DataFrame:
    return _ordered(t).select("id", F.inline("items")).select("id", "item", "size", "amount", "price")


@query(values([(1, "ok", 0.0, "ok"), (2, "discrepancy", 6.0, "speaker"), (3, "ok", 0.0, "ok"), (4, "incomplete", None, "undetermined"), (5, "discrepancy", 5.0, "recogniser")], "id, status, difference, who"))
def transcript_to_verdict(t: Tables) -> DataFrame:
    """Transcript to lines, total and diagnosis, all in one plan."""
    who = records.diagnosed(F.col("total"), F.col("items"), F.col("stated"), records.numbers_said(F.col("said")))
    return _ordered(t).select("id", "total.status", "total.difference", who.alias("who"))

PROMOTIONS = [(1, [("limonada", None, 3, 8.0), ("ensalada", None, 1, 10.0)], 26.0), (2, [("limonada", None, 1, 8.0)], 8.0), (3, [("ensalada", None, 2, 10.0), ("lomo saltado", None, 1, 35.0)], 50.0)]


@query(values([(1, 8.0, 0.0, "ok"), (2, 0.0, 0.0, "ok"), (3, 0.0, 5.0, "ok")], "id, paired, bundle, status"))
def order_promotions(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(PROMOTIONS, f"id int, items {records.LINES}, stated double")
    paired = records.paired_discount(F.col("items"), "limonada")
    bundle = F.greatest(F.lit(0.0), F.when(F.col("id") == 3, records.bundle_discount(F.col("items"), "ensalada", F.lit(15.0))).otherwise(0.0))
    return rows.select("id", paired.alias("paired"), bundle.alias("bundle"), records.order_totals(F.col("items"), F.col("stated"), discount=paired + bundle)["status"].alias("status"))

EVIDENCE = [
    (1, "contador", INTERVIEWS[0][1], "verified", "literal"), (2, "Mi ultimo puesto", INTERVIEWS[0][1], "verified", "normal"), (3, "abogado", INTERVIEWS[0][1], "unverified", None),
    (4, None, INTERVIEWS[0][1], "empty", None), (5, "x", None, "unverified", None), (6, "3000 soles", INTERVIEWS[0][1], "verified", "normal"),
]


@query(values([(x[0], x[3], x[4]) for x in EVIDENCE], "id, status, mode"))
def verify_literal(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([x[:3] for x in EVIDENCE], "id int, value string, said string")
    return rows.select("id", records.verified(F.col("value"), F.col("said")).alias("v")).select("id", "v.status", "v.mode")


@query(values([(1, 2, 1.0), (2, 0, 0.0)], "id, hits, share"))
def greedy_item_match(t: Tables) -> DataFrame:
    line = lambda item, amount: (item, None, amount, None)
    rows = [(1, [line("lomo saltado", 2), line("limonada", 1)], [line("limonada", 1), line("lomo saltado grande", 2)]), (2, [line("ensalada", 1)], [line("ensalada", 2)])]
    df = t.spark.createDataFrame(rows, f"id int, a {records.LINES}, b {records.LINES}")
    hits = records.matched(F.col("a"), F.col("b"))
    return df.select("id", hits.alias("hits"), (hits / F.size("a")).alias("share"))


@query(values([(1, "0,2,3,4"), (2, "0,1,2"), (3, "")], "id, kept"))
def monotone_anchors(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([(1, [1, 9, 2, 2, 3]), (2, [5, 6, 7]), (3, [])], "id int, pages array<int>")
    return df.select("id", F.array_join(records.anchors(F.col("pages")).cast("array<string>"), ",").alias("kept"))


@query(values([(1, 0, "1,0"), (1, 1, "2"), (1, 2, "4,3")], "page, row, lines"))
def page_reading_order(t: Tables) -> DataFrame:
    lines = [(50.0, 1.0, 10.0), (0.0, 0.0, 10.0), (0.0, 30.0, 10.0), (90.0, 63.0, 10.0), (5.0, 60.0, 10.0)]
    df = t.spark.createDataFrame([(1, lines)], "page int, lines array<struct<x:double,y:double,h:double>>")
    rows = df.select("page", F.posexplode(records.page_rows(F.col("lines"))).alias("row", "held"))
    return rows.select("page", "row", F.array_join(F.col("held").cast("array<string>"), ",").alias("lines"))


@query(values([("city", 2, 3), ("pay", 2, 3)], "field, correct, n"))
def field_accuracy(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([("Lima", "LIMA ", 3000.0, 3000.2), ("Cusco", "Puno", None, None), (None, None, 10.0, 12.0)], "city string, true_city string, pay double, true_pay double")
    marks = df.select(records.field_correct(F.col("city"), F.col("true_city")).alias("city"), records.field_correct(F.col("pay"), F.col("true_pay"), 0.5).alias("pay"))
    each = marks.unpivot([], ["city", "pay"], "field", "right")
    return each.groupBy("field").agg(F.count_if("right").alias("correct"), F.count("*").alias("n"))


@query(values([(1, 2), (2, 1), (3, 0)], "id, pairs"))
def greedy_price_match(t: Tables) -> DataFrame:
    rows = [(1, [10.0, 20.0], [20.3, 9.8, 50.0]), (2, [10.0, 10.1], [10.2]), (3, [], [1.0])]
    df = t.spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    return df.select("id", benchmarks.greedy_pairs(F.col("a"), F.col("b"), 0.5).alias("pairs"))


@query(values([(1, "2012-2015 y 20201", "2010-2013 y 20201"), (2, "sin fecha", "sin fecha"), (3, "2001", "1999")], "id, forward, back"))
def shifted_years(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([(1, "2011-2014 y 20201"), (2, "sin fecha"), (3, "2000")], "id int, line string")
    return df.select("id", text.shifted_years(F.col("line"), 1).alias("forward"), text.shifted_years(F.col("line"), -1).alias("back"))


@query(values([(0, "cabeza~JOB b~dos"), (1, "cabeza~JOB a~uno"), (2, "cabeza~JOB a~uno~JOB b~dos")], "dropped, line"))
def dropped_block(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([("cabeza\nJOB a\nuno\nJOB b\ndos",)], "line string")
    runs = [df.select(F.lit(k).alias("dropped"), F.replace(text.without_block(F.col("line"), k, "^JOB"), F.lit("\n"), F.lit("~")).alias("line")) for k in range(3)]
    return reduce(DataFrame.unionByName, runs)


@query(values([(1, "replace", "dos", "doce"), (1, "insert", "", "cuatro"), (2, "delete", "a", "")], "id, op, old, new"))
def word_diff(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([(1, "uno dos tres", "uno doce tres cuatro"), (2, "a b", "b"), (3, "x", "x"), (4, None, None)], "id int, a string, b string")
    return df.select("id", F.inline(text.word_changes(F.col("a"), F.col("b"))))

RESUME = "Ana Pérez Soto\nDesarrolladora con años de oficio\nana@mail.com\nEXPERIENCIA\nTrabajo Grande Uno\nver www.x.com"


@query(values([(1, "Desarrolladora con años de oficio~EXPERIENCIA~Trabajo Grande Uno~ver [URL]"), (2, "Ana Pérez Soto~sin secciones")], "id, line"))
def contact_removal(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([(1, RESUME), (2, "Ana Pérez Soto\nsin secciones")], "id int, line string")
    return df.select("id", F.replace(cleaning.without_contacts(F.col("line"), "^EXPERIENCIA$", text.PERSONAL), F.lit("\n"), F.lit("~")).alias("line"))
