"""Queries of text operators over whole tables, whose texts are told from columns or added to documents.

What the added parts must become is plain from the rule that adds them, so each query has SQL that
says it without the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import cues, evidence
from ..operators import benchmarks, calendar, cleaning, indexing, logs, norms, predictors, questions, records, text
from ..scratch import spread
from .registry import Tables, query

NL = "chr(10)"
HEADER = ["^DIARIO", "^Lima, "]


def joined(*parts: object) -> Column:
    """Columns and plain texts in a row."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def chosen(by: Column, *texts: Column) -> Column:
    """One of some texts, by the remainder of a number."""
    out = texts[-1]
    for i in range(len(texts) - 2, -1, -1):
        out = F.when(by % len(texts) == i, texts[i]).otherwise(out)
    return out


def lines(page: Column) -> Column:
    return cleaning.lines_of(page)


C = F.col


@query(f"SELECT doc_id, md5(CASE WHEN doc_id % 3 = 1 THEN 'DIARIO OFICIAL' || {NL} || text ELSE text END) AS digest FROM documents")
def header_removal(t: Tables) -> DataFrame:
    """Documents under a running header, under half of one, and without."""
    page = chosen(C("doc_id"), joined("DIARIO OFICIAL\nLima, lunes\n", C("text")), joined("DIARIO OFICIAL\n", C("text")), C("text"))
    return t.documents.select("doc_id", F.md5(F.array_join(cleaning.without_header(lines(page), HEADER), "\n")).alias("digest"))


@query(f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN rtrim(text, {NL}) ELSE text END) AS digest FROM documents")
def stamp_removal(t: Tables) -> DataFrame:
    """Every other document has a stamp of three lines at its end."""
    page = chosen(C("doc_id"), joined(C("text"), "\nFirmado por\n", C("doc_id"), "\nuno"), C("text"))
    return t.documents.select("doc_id", F.md5(cleaning.without_stamp(page, "Firmado por")).alias("digest"))


@query(f"SELECT doc_id, (len(string_split(text, {NL})) + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END)::INT AS n_lines FROM documents")
def end_mark_cut(t: Tables) -> DataFrame:
    """Every other document ends at a mark, after which it stands once more."""
    page = chosen(C("doc_id"), joined(C("text"), "\nCódigo: ", C("doc_id"), "\n", C("text")), C("text"))
    return t.documents.select("doc_id", F.size(cleaning.until_end_mark(lines(page), "^Código:")).alias("n_lines"))


@query(f"SELECT doc_id, CASE WHEN text = '' THEN 'sobra ' || doc_id ELSE 'sobra ' || doc_id || '~' || split_part(text, {NL}, 1) END AS unaccounted FROM (SELECT doc_id, CASE WHEN trim(split_part(text, {NL}, 1)) = '' THEN '' ELSE text END AS text FROM documents)")
def cleaning_audit(t: Tables) -> DataFrame:
    """What cleaning took from every document beyond what its patterns know: a line of its own, and one that it also kept."""
    first = F.element_at(lines(C("text")), 1)
    page = joined("DIARIO OFICIAL\nLima, lunes\n", C("text"), "\nCódigo: 1\n", first, "\nsobra ", C("doc_id"))
    rows = spread(t.documents.select("doc_id", "text"), "doc_id").select("doc_id", lines(page).alias("before"))
    after = cleaning.until_end_mark(cleaning.without_header(C("before"), HEADER), "^Código:")
    gone = cleaning.audited(C("before"), after, HEADER)
    mine = F.filter(gone, lambda x: x == joined("sobra ", C("doc_id")))
    return rows.select("doc_id", F.array_join(F.concat(mine, F.filter(gone, lambda x: x != joined("sobra ", C("doc_id")))), "~").alias("unaccounted"))


@query("""WITH l AS (SELECT l_orderkey, list(l_linenumber::VARCHAR ORDER BY l_linenumber, l_quantity) FILTER (l_quantity >= 10) AS below,
        list(l_linenumber::VARCHAR ORDER BY l_linenumber, l_quantity) FILTER (l_quantity BETWEEN 10 AND 30) AS crop FROM lineitem GROUP BY 1)
    SELECT l_orderkey, coalesce(array_to_string(below, ','), '') AS below, coalesce(array_to_string(crop[1:2], ','), '') AS crop FROM l""")
def header_band_and_crop(t: Tables) -> DataFrame:
    """An order's lines as lines of a page, whose quantity is their place on it."""
    line = F.struct(C("l_linenumber").alias("n"), C("l_quantity").alias("y"))
    pages = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    said = lambda c: F.array_join(F.transform(c, lambda x: x["n"].cast("string")), ",")
    return pages.select("l_orderkey", said(cleaning.below_band(C("lines"), 10.0)).alias("below"), said(cleaning.cropped(C("lines"), F.lit(50.0), 0.2, 0.6, 2)).alias("crop"))


@query("SELECT p_partkey, 'La ' || lower(p_name) || 'riencia sigue aquí.' || chr(10) || p_brand || ' y más' AS line FROM part")
def broken_lines(t: Tables) -> DataFrame:
    """Names broken by hyphens and by line ends, before a line that begins anew."""
    line = joined("La\n", F.lower("p_name"), "-\nriencia\nsigue aquí.\n", C("p_brand"), "\ny más")
    return t.part.where(C("p_name").rlike(r"\p{L}$")).unionByName(t.part.where(~C("p_name").rlike(r"\p{L}$")).withColumn("p_name", joined(C("p_name"), "e"))).select("p_partkey", cleaning.mended(line).alias("line"))


@query("""WITH y AS (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN y || '–' || (y + 2) WHEN 1 THEN y || '–' || (y + 1) || ' y ' || (y + 3) || '–present' WHEN 2 THEN y || ' ' || (y + 1) ELSE 'desde ' || y || '–' || (y + 9) END AS line FROM y""")
def date_ranges(t: Tables) -> DataFrame:
    y = F.year("o_orderdate")
    line = chosen(C("o_orderkey"), joined(y, " - ", y + 2), joined(y, "—", y + 1, " y ", y + 3, " to present"), joined(y, " ", y + 1), joined("desde ", y, " until ", y + 9))
    return t.orders.select("o_orderkey", cleaning.year_ranges(line).alias("line"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Worked 2010–20' || (11 + c_nationkey % 9) || ' as developer, mail [EMAIL]' || chr(10) || '[MASKED]' ELSE c_name END AS cleaned,
    (c_custkey % 2 = 0)::INT AS n_joined, (c_custkey % 2 = 0)::INT AS n_personal, (c_custkey % 2 = 0)::INT AS n_leaks FROM customer""")
def cv_cleaning(t: Tables) -> DataFrame:
    """A résumé for every other customer, cleaned with its audit counters in one plan."""
    said = chosen(C("c_custkey"), joined("Worked 2010 - 20", 11 + C("c_nationkey") % 9, " as devel-\noper, mail a", C("c_custkey"), ".b@c.org\n10 years of solid experience"), C("c_name"))
    return cleaning.cleaned(t.customer.select("c_custkey", said.alias("said")), "said", text.PERSONAL, text.LEAKS).select("c_custkey", "cleaned", "n_joined", "n_personal", "n_leaks")


@query(f"""WITH l AS (SELECT doc_id, list_filter(string_split(text, {NL}), lambda x: trim(x) <> '') AS l FROM documents),
    f AS (SELECT doc_id, list_reduce(list_prepend({{'n': 0::BIGINT, 'k': 0}}, list_transform(l, lambda x: {{'n': len(list_filter(string_split(x, ' '), lambda w: w <> '')), 'k': 0}})),
        lambda s, x: CASE WHEN s.n = 0 OR s.n + x.n <= 50 THEN {{'n': s.n + x.n, 'k': s.k}} ELSE {{'n': x.n, 'k': s.k + 1}} END) AS s FROM l)
    SELECT doc_id, s.k + 1 AS chunks FROM f WHERE s.n > 0""")
def token_chunks(t: Tables) -> DataFrame:
    """How many chunks of fifty words the lines of every document make."""
    return cleaning.token_chunks(t.documents, ["doc_id"], "text", 50).groupBy("doc_id").agg((F.max("position") + 1).alias("chunks"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter([l_partkey % 300, l_suppkey, l_orderkey % 250, l_linenumber], lambda x: x BETWEEN 1 AND 200))), ',') AS articles FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)""")
def article_mentions(t: Tables) -> DataFrame:
    """Articles in a list, after a short form, and with a number of their own."""
    said = joined("Según los artículos ", C("l_partkey") % 300, ", ", C("l_suppkey"), " y ", C("l_orderkey") % 250, " y el art. ", C("l_linenumber"), ".2 de la Ley 7")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return rows.select("l_orderkey", "l_linenumber", F.array_join(norms.mentioned(said, 200).cast("array<string>"), ",").alias("articles"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS article, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS title FROM part")
def heading_parser(t: Tables) -> DataFrame:
    line = chosen(C("p_partkey"), joined("Artículo ", C("p_size"), ".- ", C("p_name")), joined("ARTICULO ", C("p_size")), joined("En el artículo ", C("p_size"), " se dice"))
    return t.part.select("p_partkey", norms.heading(line).alias("h")).select("p_partkey", "h.article", "h.title")


@query("""SELECT p_partkey, unnest([0, 1, 2])::INT AS place, unnest(['artículo ' || p_size, 'numeral ' || p_partkey || ' del artículo 3', p_size || ' de la ley ' || p_brand]) AS item FROM part""")
def amendment_items(t: Tables) -> DataFrame:
    said = joined("artículo ", C("p_size"), "; numeral ", C("p_partkey"), " del artículo 3 y ", C("p_size"), " de la ley ", C("p_brand"), ".")
    return t.part.select("p_partkey", F.posexplode(norms.amendment_items(said)).alias("place", "item"))


@query("""WITH c AS (SELECT DISTINCT CASE WHEN lower(p_brand) = 'brand#11' THEN 'brand#12' ELSE lower(p_brand) END AS name, p_size FROM part WHERE p_partkey % 9 = 0)
    SELECT p_partkey, c.name IS NOT NULL AS cited FROM (SELECT *, CASE WHEN lower(p_brand) = 'brand#11' THEN 'brand#12' ELSE lower(p_brand) END AS name FROM part) p LEFT JOIN c USING (name, p_size)""")
def cite_marking(t: Tables) -> DataFrame:
    """Parts whose brand, or its other name, and size are cited by every ninth part."""
    citations = t.part.where("p_partkey % 9 = 0").select(F.upper("p_brand").alias("p_brand"), "p_size")
    return norms.cited(t.part.select("p_partkey", "p_brand", "p_size"), citations, ["p_size"], {"brand#11": "brand#12"}, "p_brand").select("p_partkey", "cited")


PLACES = {"lima": "LIMA", "lima metropolitana": "LIMA METRO", "cusco": "CUSCO", "la libertad": "LA LIBERTAD"}
CATEGORIES = [("obras", ["obra", "construc"]), ("servicios", ["servicio", "consultor"]), ("bienes", ["compra", "bienes"])]
ASKED = """q AS (SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'LIMA METRO' WHEN 1 THEN 'CUSCO' END AS place, CASE o_orderkey % 5 WHEN 0 THEN 'obras' WHEN 1 THEN 'servicios' WHEN 2 THEN 'bienes' WHEN 3 THEN 'servicios' END AS category,
    CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) * 1000000.0::DOUBLE END AS at_least, CASE o_orderkey % 5 WHEN 1 THEN (o_custkey + 1) * 1000.0::DOUBLE WHEN 3 THEN 1000 + o_custkey % 900 + 0.5::DOUBLE END AS at_most FROM orders)"""


def asked(t: Tables) -> DataFrame:
    n = C("o_custkey") + 1
    question = chosen(
        C("o_orderkey"), joined("¿Obras en Lima Metropolitana de más de ", n, " millones?"), joined("servicios hasta ", n, " mil en Cusco"), joined("compras desde ", 1990 + n % 30),
        joined("consultoría entre otras, menos de S/ 1,", F.lpad((C("o_custkey") % 900).cast("string"), 3, "0"), ".50"), joined("nada de ", n))
    return questions.extracted_filters(t.orders.select("o_orderkey", "o_custkey", question.alias("question")), "question", PLACES, CATEGORIES)


@query(f"WITH {ASKED} SELECT o_orderkey, place, category, at_least, at_most FROM q")
def question_filters(t: Tables) -> DataFrame:
    """What questions about orders ask for: a place, a category, least and greatest amounts."""
    return asked(t).select("o_orderkey", "place", "category", "at_least", "at_most")


@query(f"WITH {ASKED} SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'CUSCO' ELSE place END AS place, CASE WHEN o_custkey % 3 = 0 THEN 10.0::DOUBLE ELSE at_least END AS at_least FROM q")
def stated_filters_win(t: Tables) -> DataFrame:
    rows = asked(t)
    stated = {"place": F.when(C("o_custkey") % 2 == 0, "CUSCO"), "at_least": F.when(C("o_custkey") % 3 == 0, 10.0)}
    both = questions.merged(stated, {"place": C("place"), "at_least": C("at_least")})
    return rows.select("o_orderkey", *[c.alias(n) for n, c in both.items()])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN n_name END AS place, CASE c_custkey % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'province' WHEN 2 THEN 'department' ELSE 'unknown' END AS place_by
    FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def territory_cascade(t: Tables) -> DataFrame:
    """A customer's nation out of an entity's name, else out of a province's, else as a department."""
    k = C("c_custkey") % 4
    spelled = F.translate("n_name", "_0123456789", " ABCDEFGHIJ")  # names of letters only
    rows = t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).select(
        "c_custkey", F.when(k == 0, joined("GOBIERNO REGIONAL DE ", spelled)).otherwise("OTRA").alias("entity"),
        F.when(k == 1, joined("PROVINCIA DE ", spelled)).otherwise("X").alias("province"), F.when(k == 2, F.lower(spelled)).alias("department"))
    steps = [("entity", questions.place_in_name(C("entity"), r"^GOBIERNO REGIONAL (?:DE )?(.+)$")), ("province", questions.without_prefix(C("province"), ["PROVINCIA", "PROVINCIA DE"])), ("department", text.name_form(C("department")))]
    return questions.located(rows, steps, t.nation.select(spelled.alias("name"), C("n_name").alias("value")), "name", "value").select("c_custkey", "place", "place_by")


@query("SELECT doc_id, left('falló con [SECRET] en ' || text, 300) AS message FROM documents")
def secret_redaction(t: Tables) -> DataFrame:
    message = joined("falló con sk-abcDEF123456", C("doc_id"), " en ", C("text"))
    return t.documents.select("doc_id", F.left(F.regexp_replace(message, r"\b(?:sk|key|tok)-[A-Za-z0-9]{12,}", "[SECRET]"), F.lit(300)).alias("message"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'registered' WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 11 = 0 THEN 'downloaded' WHEN doc_id % 7 = 0 THEN 'drifted' ELSE 'identical' END AS state FROM documents WHERE doc_id % 20 <> 0""")
def manifest_state(t: Tables) -> DataFrame:
    """Documents against a manifest that lacks some, knows some without a digest, and some that are gone or changed."""
    known = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.when(C("doc_id") % 11 != 0, F.md5("text")).alias("digest"))
    changed = F.when(C("doc_id") % 7 == 0, joined(C("text"), "!")).otherwise(C("text"))
    return indexing.manifest_state(known, t.documents.where("doc_id % 4 <> 0").select("doc_id", F.md5(changed).alias("digest")), "doc_id", "digest")


UNITS = ["uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"]
TENS = {30: "treinta", 40: "cuarenta", 50: "cincuenta"}


@query("SELECT p_partkey, ((10 * (3 + p_partkey % 3) + 2 + p_size % 8) * 1000 + 100 + 30 + 1 + p_partkey % 9) || ' soles por 1 año y un mesero' AS line FROM part")
def spoken_numbers(t: Tables) -> DataFrame:
    """Prices of parts in words: thousands of thirty-two to fifty-nine, and what follows a hundred and thirty."""
    word = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    line = F.concat_ws(" ", word(list(TENS.values()), C("p_partkey") % 3), F.lit("y"), word(UNITS[1:], C("p_size") % 8), F.lit("mil ciento treinta y"), word(UNITS, C("p_partkey") % 9), F.lit("soles por un año y un mesero"))
    return t.part.select("p_partkey", line.alias("said")).select("p_partkey", records.spoken_numbers("said").alias("line"))


#: What an interview's fields look like; the lists are these queries' own.
INTERVIEW = [
    cues.Field("years", r"\d+ anos?(?: y (?:medio|\d+ mes(?:es)?))?", lambda m: round(evidence.durations(m.group())[0][0], 2), {"experien": 2.0, "total": 1.0, "edad": -3.0}, 6, -2.0),
    cues.Field("pay", r"\d{3,6} soles", lambda m: float(m.group().split()[0]), {"pretensi": 3.0, "espero": 2.0, "ganaba": -3.0, "antes": -1.0}, 6),
    cues.Field("role", r"puesto (?:fue|era) (\w+)", lambda m: m[1]),
    cues.Field("english", "basico|intermedio|avanzado", cues={"ingles": 1.0}, reach=4, least=0.1),
]


@query("""SELECT c_custkey, 2.0::DOUBLE + c_nationkey AS years, 1000.0::DOUBLE + c_custkey AS pay, lower(c_mktsegment) AS role, ['basico', 'intermedio', 'avanzado'][1 + c_custkey % 3] AS english, CASE WHEN c_custkey % 2 = 0 THEN 'Excel,SQL' ELSE 'SQL' END AS tools FROM customer""")
def extract_interview(t: Tables) -> DataFrame:
    """An interview of every customer, with figures that must not be taken for those asked for."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("básico", "intermedio", "avanzado")]), (C("c_custkey") % 3 + 1).cast("int"))
    tool = F.when(C("c_custkey") % 2 == 0, "Excel y SQL").otherwise("SQL")
    said = joined("Tengo ", 30 + C("c_nationkey"), " años de edad. Llevo ", 2 + C("c_nationkey"), " años de experiencia en total. Mi último puesto fue ", F.lower("c_mktsegment"), " en un banco. Manejo ", tool, ". Antes ganaba 900 soles y mi pretensión es de ", 1000 + C("c_custkey"), " soles. Mi inglés es ", level, ".")
    rows = spread(t.customer, "c_custkey").select("c_custkey", said.alias("said"))
    found = records.fields(C("said"), INTERVIEW, {"years": "double", "pay": "double"})
    return rows.select("c_custkey", found.alias("f"), F.array_join(records.listed(C("said"), ["Excel", "Python", "SQL"]), ",").alias("tools")).select("c_custkey", "f.*", "tools")


ORDER = cues.OrderWords(withdraw="quita(?:me)?|ya no quiero", price=r"a (\d+(?:\.\d+)?)", measure="vasos?", sizes=("grande", "chica"))
MENU = ["lomo saltado", "limonada", "ensalada"]
#: Calls are plain, withdraw an item, lack a price, or are misheard in their total; the first two may overcharge.
CALLED = """c AS (SELECT *, CASE WHEN kind < 2 AND o_orderkey % 3 = 0 THEN 4 WHEN kind = 3 THEN 5 ELSE 0 END AS more
    FROM (SELECT o_orderkey, o_orderkey % 4 AS kind, 2 + o_orderkey % 7 AS n, 5 + o_custkey % 30 AS p, 3 + o_custkey % 9 AS q FROM orders))"""


def called(t: Tables) -> DataFrame:
    kind, n, p, q = C("o_orderkey") % 4, 2 + C("o_orderkey") % 7, 5 + C("o_custkey") % 30, 3 + C("o_custkey") % 9
    total = n * p + q + F.when((kind < 2) & (C("o_orderkey") % 3 == 0), 4).otherwise(0)
    meal, end = joined("Quiero ", n, " lomos saltados grandes a ", p, " soles"), joined(". Son ", total, " soles.")
    plain = joined(meal, " y una limonada a ", q, " soles", end)
    withdrawn = joined(meal, ", una ensalada a 10 soles y una limonada a ", q, " soles. Quítame la ensalada", end)
    priceless = joined(meal, " y una limonada", end)
    stated = total + F.when(kind == 3, 5).otherwise(0)
    rows = spread(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", chosen(C("o_orderkey"), plain, withdrawn, priceless, plain).alias("said"), stated.cast("double").alias("stated"))
    return heard(rows)


def heard(rows: DataFrame) -> DataFrame:
    return rows.withColumn("items", records.order_lines(C("said"), MENU, ORDER)).withColumn("total", records.order_totals(C("items"), C("stated")))


def corrected(t: Tables) -> DataFrame:
    """A call for every order that takes back an amount and a price, with numbers in words and a measure; every third overcharges."""
    n, p, q = 2 + C("o_orderkey") % 7, 5 + C("o_custkey") % 30, 3 + C("o_custkey") % 9
    total = n * p + 2 * q + F.when(C("o_orderkey") % 3 == 0, 4).otherwise(0)
    said = joined("Una limonada a 8 soles y ", n, " lomos saltados grandes a ", p, " soles, no, mejor dos vasos de limonada a ", q, " soles. Son ", total, " soles.")
    return heard(spread(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", said.alias("said"), total.cast("double").alias("stated")))


@query(f"WITH {CALLED} SELECT o_orderkey, 'lomo saltado' AS item, 'grande' AS size, n::INT AS amount, p::DOUBLE AS price FROM c UNION ALL SELECT o_orderkey, 'limonada', NULL, 1, CASE WHEN kind <> 2 THEN q::DOUBLE END FROM c")
def extract_order(t: Tables) -> DataFrame:
    """Lines out of a call for every order, of which some withdraw an item or lack a price."""
    return called(t).select("o_orderkey", F.inline("items")).select("o_orderkey", "item", "size", "amount", "price")


@query(f"""WITH {CALLED} SELECT o_orderkey, 'told' AS call, CASE WHEN kind = 2 THEN 'incomplete' WHEN more > 0 THEN 'discrepancy' ELSE 'ok' END AS status, CASE WHEN kind <> 2 THEN more::DOUBLE END AS difference,
    CASE WHEN kind = 2 THEN 'undetermined' WHEN kind = 3 THEN 'recogniser' WHEN more > 0 THEN 'speaker' ELSE 'ok' END AS who FROM c
    UNION ALL SELECT o_orderkey, 'corrected', CASE WHEN o_orderkey % 3 = 0 THEN 'discrepancy' ELSE 'ok' END, CASE WHEN o_orderkey % 3 = 0 THEN 4.0 ELSE 0.0 END::DOUBLE, CASE WHEN o_orderkey % 3 = 0 THEN 'speaker' ELSE 'ok' END FROM c""")
def transcript_to_verdict(t: Tables) -> DataFrame:
    """Two calls of every order to lines, totals and diagnoses in one plan: each kind of verdict, and a correction."""
    who = records.diagnosed(C("total"), C("items"), C("stated"), records.numbers_said(C("said")))
    judged = lambda rows, call: rows.select("o_orderkey", F.lit(call).alias("call"), "total.status", "total.difference", who.alias("who"))
    return judged(called(t), "told").unionByName(judged(corrected(t), "corrected"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'verified' WHEN doc_id % 3 = 1 THEN 'unverified' ELSE 'empty' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'literal' END AS mode FROM documents WHERE length(text) >= 40""")
def verify_literal(t: Tables) -> DataFrame:
    """A document's own words, words that no document has, and nothing."""
    value = F.when(C("doc_id") % 3 == 0, F.substring("text", 11, 20)).when(C("doc_id") % 3 == 1, F.lit("zqxj zqxk 00x00"))
    rows = spread(t.documents.select("doc_id", "text"), "doc_id").where(F.length("text") >= 40).select("doc_id", records.verified(value, C("text")).alias("v"))
    return rows.select("doc_id", "v.status", "v.mode")


@query("""SELECT 'segment' AS field, count(*) FILTER (c_mktsegment = 'BUILDING') AS correct, count(*) AS n FROM customer
    UNION ALL SELECT 'balance', count(*) FILTER (abs(c_acctbal - 4500) <= 1000), count(*) FROM customer""")
def field_accuracy(t: Tables) -> DataFrame:
    """How many customers have the segment, in any case, and about the balance that is told."""
    marks = t.customer.select(records.field_correct(F.lower("c_mktsegment"), F.lit("Building ")).alias("segment"), records.field_correct(C("c_acctbal"), F.lit(4500.0), 1000.0).alias("balance"))
    each = marks.unpivot([], ["segment", "balance"], "field", "right")
    return each.groupBy("field").agg(F.count_if("right").alias("correct"), F.count("*").alias("n"))


@query("""SELECT p_partkey, (p_size % 4)::INT AS pairs FROM part""")
def greedy_price_match(t: Tables) -> DataFrame:
    """Prices of a part that find one of another list, each taken once."""
    price = C("p_retailprice")
    left = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: price + 10 * i)
    right = F.filter(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.when(i <= C("p_size") % 4, price + 10 * i + 0.3).otherwise(price + 1000 * i)), lambda x: x.isNotNull())
    return t.part.select("p_partkey", benchmarks.greedy_pairs(left, right, 0.5).alias("pairs"))


@query("SELECT o_orderkey, (year(o_orderdate) + 1) || '-' || (year(o_orderdate) + 4) || ' y 20201' AS forward, (year(o_orderdate) - 1) || '-' || (year(o_orderdate) + 2) || ' y 20201' AS back FROM orders")
def shifted_years(t: Tables) -> DataFrame:
    line = joined(F.year("o_orderdate"), "-", F.year("o_orderdate") + 3, " y 20201")
    return t.orders.select("o_orderkey", text.shifted_years(line, 1).alias("forward"), text.shifted_years(line, -1).alias("back"))


@query("""WITH l AS (SELECT l_orderkey, list(l_linenumber::VARCHAR ORDER BY l_linenumber) AS v FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1)
    SELECT l_orderkey, 'cabeza' || chr(10) || array_to_string(list_transform(list_filter(v, lambda x, i: i <> 2), lambda x: 'JOB ' || x || chr(10) || 'uno'), chr(10)) AS line FROM l""")
def dropped_block(t: Tables) -> DataFrame:
    """An order's lines as blocks of a résumé, without the second."""
    pages = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n"))
    line = F.concat(F.lit("cabeza\n"), F.array_join(F.transform("n", lambda x: F.concat(F.lit("JOB "), x.cast("string"), F.lit("\nuno"))), "\n"))
    return pages.select("l_orderkey", text.without_block(line, 1, "^JOB").alias("line"))


@query("SELECT p_partkey, 'replace' AS op, 'size' || p_size AS old, 'doce' AS new FROM part UNION ALL SELECT p_partkey, 'insert', '', 'cuatro' FROM part UNION ALL SELECT p_partkey, 'delete', 'sobra', '' FROM part")
def word_diff(t: Tables) -> DataFrame:
    """What turns the words about a part into others."""
    rows = t.part.select("p_partkey", joined("sobra uno size", C("p_size"), " tres").alias("a"), F.lit("uno doce tres cuatro").alias("b"))
    return rows.select("p_partkey", F.inline(text.word_changes(C("a"), C("b"))))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Desarrolladora con años de oficio' || chr(10) || 'EXPERIENCIA' || chr(10) || c_name || chr(10) || 'ver [URL]' ELSE 'Ana Soto' || chr(10) || c_name END AS line FROM customer")
def contact_removal(t: Tables) -> DataFrame:
    """Résumés of customers without who they are about; those without a section keep their lines."""
    line = chosen(C("c_custkey"), joined("Ana Pérez Soto\nDesarrolladora con años de oficio\na", C("c_custkey"), "@mail.com\nEXPERIENCIA\n", C("c_name"), "\nver www.x", C("c_custkey"), ".com"), joined("Ana Soto\n", C("c_name")))
    return t.customer.select("c_custkey", cleaning.without_contacts(line, "^EXPERIENCIA$", text.PERSONAL).alias("line"))


@query("SELECT c_custkey, unnest(generate_series(date_trunc('month', d)::DATE, (date_trunc('month', d) + INTERVAL 2 MONTH)::DATE, INTERVAL 1 MONTH))::DATE AS month FROM (SELECT o_custkey AS c_custkey, min(o_orderdate) AS d FROM orders GROUP BY 1)")
def month_range(t: Tables) -> DataFrame:
    """The first three months of every customer, from the month of the first order on."""
    first = F.trunc(F.min("o_orderdate").cast("date"), "month")
    months = t.orders.groupBy(C("o_custkey").alias("c_custkey")).agg(first.alias("first"))
    return months.select("c_custkey", F.explode(calendar.months_between(C("first"), F.add_months("first", 2))).alias("month"))


def order_lines(*parts: tuple[str, Column, float]) -> Column:
    """Lines of an order: item, amount and price, of no size."""
    line = lambda item, amount, price: F.struct(F.lit(item).alias("item"), F.lit(None).cast("string").alias("size"), amount.cast("int").alias("amount"), F.lit(price).alias("price"))
    return F.array(*[line(*p) for p in parts]).cast(records.LINES)


@query("SELECT o_orderkey, ((1 + o_orderkey % 6) // 2) * 8.0::DOUBLE AS paired, CASE WHEN o_custkey % 3 = 0 THEN 'discrepancy' ELSE 'ok' END AS status FROM orders")
def order_promotions(t: Tables) -> DataFrame:
    """Every second lemonade of an order is free, which some totals forget."""
    n = 1 + C("o_orderkey") % 6
    rows = t.orders.select("o_orderkey", "o_custkey", order_lines(("limonada", n, 8.0), ("ensalada", F.lit(1), 10.0)).alias("items"), (8.0 * (n - F.floor(n / 2)) + 10 + F.when(C("o_custkey") % 3 == 0, 3).otherwise(0)).alias("stated"))
    paired = records.paired_discount(C("items"), "limonada")
    return rows.select("o_orderkey", paired.alias("paired"), records.order_totals(C("items"), C("stated"), discount=paired)["status"].alias("status"))


@query("SELECT o_orderkey, 1 + (o_custkey % 3 = o_orderkey % 3)::INT AS hits FROM orders")
def greedy_item_match(t: Tables) -> DataFrame:
    """Lines of two accounts of an order that tell of the same item and amount, each taken once."""
    a = order_lines(("lomo saltado", 1 + C("o_custkey") % 3, 30.0), ("limonada", F.lit(1), 8.0))
    b = order_lines(("limonada", F.lit(1), 8.0), ("lomo saltado grande", 1 + C("o_orderkey") % 3, 30.0))
    return t.orders.select("o_orderkey", records.matched(a, b).alias("hits"))


@query("""SELECT l_orderkey, array_to_string(generate_series(1, count(DISTINCT l_linenumber)), ',') AS kept FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1""")
def monotone_anchors(t: Tables) -> DataFrame:
    """The longest rising run of an order's line numbers, after a number that doesn't belong."""
    pages = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("n")).where("size(n) > 1")
    return pages.select("l_orderkey", F.array_join(records.anchors(F.concat(F.array(F.lit(99)), "n")).cast("array<string>"), ",").alias("kept"))


@query("SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INT AS row, string_agg(l_quantity::BIGINT::VARCHAR, ',' ORDER BY l_quantity) AS lines FROM lineitem GROUP BY l_orderkey, l_linenumber")
def page_reading_order(t: Tables) -> DataFrame:
    """An order's lines as lines on a page, whose height is their number: what stands in each row, from left to right."""
    line = F.struct(C("l_quantity").alias("x"), (C("l_linenumber") * 30.0).alias("y"), F.lit(10.0).alias("h"))
    pages = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))
    rows = pages.select("l_orderkey", "lines", F.posexplode(records.page_rows(C("lines"))).alias("row", "held"))
    return rows.select("l_orderkey", "row", F.array_join(F.transform("held", lambda i: F.get("lines", i)["x"].cast("long").cast("string")), ",").alias("lines"))


STUDIED = ["mae", "moved_change", "moved_mae", "cut_mae", "cut_change", "expected_change", "slope", "corr"]


@query(f"""WITH j AS (SELECT l_orderkey AS k, l_linenumber AS n, min(year(l_shipdate)) AS b, 1 + l_linenumber % 4 AS d FROM lineitem GROUP BY ALL),
    o AS (SELECT k, list(b ORDER BY n) AS b, list(d ORDER BY n) AS d, list(b + d ORDER BY n) AS e, sum(d) + k % 3 AS y FROM j GROUP BY k HAVING count(*) >= 2),
    m AS (SELECT 'date_rule' AS model, y, d[1] AS removed, list_sum(d) AS p0, list_sum(d) AS p1, list_sum(d) - d[1] AS p2 FROM o
        UNION ALL SELECT 'span', y, d[1], list_max(e) - list_min(b), list_max(e) - list_min(b), list_max(e[2:]) - list_min(b[2:]) FROM o
        UNION ALL SELECT 'latest_year', y, d[1], list_max(e) - 1990, list_max(e) + 5 - 1990, list_max(e[2:]) - 1990 FROM o
        UNION ALL SELECT 'fixed', y, d[1], 7, 7, 7 FROM o)
    SELECT model, count(*) AS n, {", ".join(f"round({x}, 9) AS {c}" for c, x in zip(STUDIED, ["avg(abs(p0 - y))", "avg(abs(p1 - p0))", "avg(abs(p1 - y))", "avg(abs(p2 - greatest(y - removed, 0)))", "avg(p2 - p0)", "avg(-removed)", "CASE WHEN stddev_pop(p2 - p0) <= 1e-9 THEN 0 ELSE regr_slope(p2 - p0, -removed) END", "CASE WHEN stddev_pop(p2 - p0) <= 1e-9 THEN 0 ELSE corr(p2 - p0, -removed) END"]))} FROM m GROUP BY 1""")
def perturbation_study(t: Tables) -> DataFrame:
    """Orders told as résumés, their lines as jobs: what moved dates and a dropped job do to four predictors."""
    jobs = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.year("l_shipdate")).alias("b")).withColumn("d", 1 + C("l_linenumber") % 4)
    told = lambda j: joined("JOB ", j["l_linenumber"], "\n", j["b"], "-", j["b"] + j["d"])
    people = jobs.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "b", "d"))).alias("jobs"), F.sum("d").alias("years")).where("size(jobs) >= 2")
    line = F.concat(F.lit("cabeza\n"), F.array_join(F.transform("jobs", told), "\n"))
    rows = people.select((C("years") + C("l_orderkey") % 3).alias("y"), F.get("jobs", 0)["d"].alias("removed"), line.alias("plain"))
    years = lambda c: F.transform(text.year_tokens(c), lambda y: y.cast("int"))
    texts = {"plain": C("plain"), "moved": text.shifted_years(C("plain"), 5), "cut": text.without_block(C("plain"), 0, "^JOB")}
    found = rows.select("y", "removed", *[years(c).alias(n) for n, c in texts.items()])  # once a text, whatever the rules ask of it
    signed = lambda c: F.aggregate(F.transform(c, lambda y, i: F.when(i % 2 == 1, y).otherwise(-y)), F.lit(0), lambda a, x: a + x)
    rules = {"date_rule": signed, "span": lambda c: F.array_max(c) - F.array_min(c), "latest_year": lambda c: F.array_max(c) - 1990, "fixed": lambda c: F.lit(7)}
    predicted = found.select("y", "removed", *[rule(C(c)).alias(f"{name}_{c}") for name, rule in rules.items() for c in texts])
    study = predictors.perturbation_study(predicted, "y", "removed", {name: tuple(f"{name}_{c}" for c in texts) for name in rules})
    return study.select("model", "n", *[F.round(c, 9).alias(c) for c in STUDIED])


@query("""SELECT event_type, CASE event_id % 7 WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'quota_spent' WHEN 3 THEN 'network' WHEN 4 THEN 'other' ELSE NULL END AS kind, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def error_kinds(t: Tables) -> DataFrame:
    """Logged errors by model and kind; calls without one have none."""
    k = C("event_id") % 7
    message = F.when(k == 1, joined("rate_limit: wait ", C("user_id"), " s")).when(k == 2, joined(" quota_spent : day ", C("event_id"))).when(k == 3, "network:").when(k == 4, joined("Timeout at: ", C("user_id"))).when(k == 5, " ")
    return t.events.groupBy("event_type", logs.error_kind(message).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\blicense\b') THEN 'legal' WHEN list_contains(string_split(lower(text), ' '), 'the') THEN 'english' WHEN n_chars BETWEEN 200 AND 500 THEN 'short' WHEN coalesce(n_chars < 200, false) THEN 'tiny' ELSE 'other' END AS cause FROM documents""")
def cause_rules(t: Tables) -> DataFrame:
    """The first of four kinds of rules that holds for a document: a pattern, a token, an interval, a bound."""
    rules = [("legal", C("text").rlike(r"(?i)\blicense\b")), ("english", F.array_contains(F.split(F.lower("text"), " "), "the")), ("short", C("n_chars").between(200, 500)), ("tiny", C("n_chars") < 200)]
    return t.documents.select("doc_id", benchmarks.cause(rules).alias("cause"))
