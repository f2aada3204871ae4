"""Queries over texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import evaluation, logs, retrieval, text
from .registry import Tables, query

FOLD = f"translate(lower({{0}}), '{text.ACCENTED}', '{text.PLAIN}')"
TEXT = FOLD.format("text")
STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TOKENS = f"list_filter(regexp_extract_all({TEXT}, '[a-z0-9]+'), lambda w: NOT list_contains([{STOP}], w))"


@query(f"SELECT doc_id, sha256({TEXT}) AS digest FROM documents")
def fold_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.folded(F.col("text")), 256).alias("digest"))


@query(f"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({TEXT}, '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))) AS digest FROM documents""")
def folded_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.folded_words(F.col("text")), 256).alias("digest"))


@query(f"""SELECT n_nationkey, nullif(trim(regexp_replace(regexp_replace(translate(upper(n_name || '-áñ1'), '{text.ACCENTED_UPPER}', '{text.PLAIN_UPPER}'), '[^A-ZÑ ]', ' ', 'g'), ' +', ' ', 'g')), '') AS form FROM nation""")
def name_form(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.name_form(F.concat("n_name", F.lit("-áñ1"))).alias("form"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS form FROM benchmark")
def spoken_form(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", text.spoken_form(F.col("text")).alias("form"))


@query("SELECT c_custkey, lower(regexp_replace(c_name, '[0-9]', ' ', 'g')) AS form FROM customer")
def strip_digits(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.without_digits(F.col("c_name")).alias("form"))


@query(f"SELECT doc_id, len({TOKENS})::INT AS n, sha256(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def tokenize(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("digest"))


@query(f"""SELECT w, CASE WHEN length(w) <= 3 OR regexp_full_match(w, '[0-9]+') THEN w WHEN regexp_matches(w, 'ciones$') THEN regexp_replace(w, 'ciones$', 'cion')
        WHEN regexp_matches(w, '[^aeiou]es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^s]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS light,
        CASE WHEN length(w) <= 3 OR regexp_full_match(w, '[0-9]+') THEN w WHEN regexp_matches(w, 'ces$') THEN regexp_replace(w, 'ces$', 'z')
        WHEN regexp_matches(w, 'es$') AND length(w) > 4 THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, 's$') THEN regexp_replace(w, 's$', '') ELSE w END AS coarse
    FROM (SELECT DISTINCT unnest({TOKENS}) AS w FROM documents)""")
def light_stem(t: Tables) -> DataFrame:
    words = t.documents.select(F.explode(text.tokens(F.col("text"))).alias("w")).distinct()
    return words.select("w", text.light_stem(F.col("w")).alias("light"), text.coarse_stem(F.col("w")).alias("coarse"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\pL\\pN]', '', 'g'))::INT AS useful, coalesce(length(regexp_replace(text, '[^\\pL]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0), 0) AS alphabetic FROM documents")
def text_quality(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.useful_characters(F.col("text")).alias("useful"), text.alphabetic_share(F.col("text")).alias("alphabetic"))


@query(f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all({TEXT}, '[a-z]{{3,}}')) AS w FROM benchmark),
    d AS (SELECT doc_id, unnest(regexp_extract_all({TEXT}, '[a-z]{{3,}}')) AS w FROM documents)
    SELECT doc_id, avg((v.w IS NOT NULL)::INT) AS known FROM d LEFT JOIN v ON v.w = d.w GROUP BY doc_id""")
def known_word_rate(t: Tables) -> DataFrame:
    words = lambda df, *c: df.select(*c, F.explode(F.regexp_extract_all(text.folded(F.col("text")), F.lit("([a-z]{3,})"), F.lit(1))).alias("w"))
    vocabulary = words(t.benchmark).distinct().withColumn("hit", F.lit(1))
    counted = words(t.documents, "doc_id").groupBy("doc_id", "w").agg(F.count("*").alias("n"))  # before the join
    return counted.join(vocabulary, "w", "left").groupBy("doc_id").agg((F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("known"))


@query(f"""SELECT doc_id, len(regexp_extract_all({TEXT}, 'license|released'))::INT AS legal, len(regexp_extract_all({TEXT}, 'und |der |die '))::INT AS german FROM documents""")
def keyword_counts(t: Tables) -> DataFrame:
    f = text.folded(F.col("text"))
    return t.documents.select("doc_id", F.regexp_count(f, F.lit("license|released")).alias("legal"), F.regexp_count(f, F.lit("und |der |die ")).alias("german"))


@query("""SELECT o_orderkey, regexp_extract_all(strftime(o_orderdate, 'on %Y-%m-%d') || ' ref ' || o_orderkey::VARCHAR || 'x', '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])', 1) AS years FROM orders""")
def year_tokens(t: Tables) -> DataFrame:
    line = F.concat(F.date_format("o_orderdate", "'on 'yyyy-MM-dd"), F.lit(" ref "), F.col("o_orderkey").cast("string"), F.lit("x"))
    return t.orders.select("o_orderkey", text.year_tokens(line).alias("years"))


def _masked_sql(column: str) -> str:
    for name, pattern in text.PERSONAL:
        column = f"regexp_replace({column}, '{pattern}', '[{name}]', 'g')"
    return column


@query(f"SELECT doc_id, sha256({_masked_sql('text')}) AS digest FROM documents")
def pii_mask(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(text.masked(F.col("text"), text.PERSONAL), 256).alias("digest"))


@query("SELECT " + ", ".join(f"coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0)::BIGINT AS {n.lower()}" for n, p in text.PERSONAL) + " FROM documents")
def pii_counts(t: Tables) -> DataFrame:
    return text.mask_counts(t.documents, "text", text.PERSONAL)


def _leak_sql(column: str) -> str:
    for _, pattern in text.LEAKS:
        column = f"regexp_replace({column}, '{pattern}', '[MASKED]', 'g')"
    return column


@query(f"SELECT c_custkey, {_leak_sql('line')} AS line FROM (SELECT c_custkey, c_name || ' has over ' || (c_custkey % 40)::VARCHAR || '+ years of proven experience, a decade' AS line FROM customer)")
def leak_mask(t: Tables) -> DataFrame:
    line = F.concat("c_name", F.lit(" has over "), (F.col("c_custkey") % 40).cast("string"), F.lit("+ years of proven experience, a decade"))
    return t.customer.select("c_custkey", text.masked(line, text.LEAKS, "[MASKED]").alias("line"))


PAIRS = "SELECT a.item_id AS a_id, b.item_id AS b_id, a.text AS a, b.text AS b FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"


def pairs(t: Tables) -> DataFrame:
    a = t.benchmark.select(F.col("item_id").alias("a_id"), F.col("text").alias("a"))
    b = t.benchmark.select(F.col("item_id").alias("b_id"), F.col("text").alias("b"))
    return a.join(b, F.col("b_id") == F.col("a_id") + 1)


@query(f"SELECT a_id, b_id, levenshtein(a, b)::DOUBLE / length(a) AS cer FROM (SELECT a_id, b_id, regexp_replace({FOLD.format('a')}, '[^ -~]', '', 'g') AS a, regexp_replace({FOLD.format('b')}, '[^ -~]', '', 'g') AS b FROM ({PAIRS}))")
def cer(t: Tables) -> DataFrame:
    """Character error rate of neighbouring items, folded to ASCII as the oracle counts bytes."""
    plain = lambda c: F.regexp_replace(text.folded(F.col(c)), "[^ -~]", "")
    rows = pairs(t).select("a_id", "b_id", plain("a").alias("a"), plain("b").alias("b"))
    return rows.select("a_id", "b_id", (F.levenshtein("a", "b") / F.length("a")).alias("cer"))


@query(f"""WITH w AS (SELECT a_id, b_id, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM ({PAIRS})),
    v AS (SELECT *, list_distinct(list_intersect(x, y)) AS common FROM w)
    SELECT a_id, b_id, levenshtein(array_to_string(list_transform(x, lambda k: CASE WHEN list_contains(common, k) THEN chr((2 + list_position(common, k))::INT) ELSE chr(1) END), ''),
                                   array_to_string(list_transform(y, lambda k: CASE WHEN list_contains(common, k) THEN chr((2 + list_position(common, k))::INT) ELSE chr(2) END), ''))::INT AS errors, len(x)::INT AS words FROM v""")
def wer(t: Tables) -> DataFrame:
    """Word errors of neighbouring items by dynamic programming over whole word arrays."""
    rows = pairs(t).select("a_id", "b_id", F.split("a", " ").alias("x"), F.split("b", " ").alias("y"))
    return rows.select("a_id", "b_id", text.word_error_counts(F.col("x"), F.col("y")).alias("errors"), F.size("x").alias("words"))


@query("""SELECT doc_id, i::INT AS position, substr(text, i * 800 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(greatest(1, ceil((length(text) - 200) / 800.0)::BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def chunk_fixed(t: Tables) -> DataFrame:
    from ..operators import chunking

    return chunking.fixed(t.documents.where(F.length("text") > 0), 1000, 200).select("doc_id", "position", "chunk")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)
    SELECT doc_id, line::INT AS line, last_value(CASE WHEN regexp_matches(content, '^[A-Z][a-z]+[.]$') THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS heading FROM l""")
def heading_carry_forward(t: Tables) -> DataFrame:
    return text.lines_carrying_heading(t.documents.select("doc_id", "text"), ["doc_id"], "text", "^[A-Z][a-z]+[.]$").select("doc_id", "line", "heading")


QUESTIONS = [(1, "the on that tion"), (2, "ung keit schaft heit"), (3, "cion mente ado que"), (4, "tionre ement eaux pour"), (5, "released under the mit license")]
QUESTION_SQL = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") q(query_id, question)"
BM25 = f"""
    d AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS mean FROM d),
    asked AS (SELECT DISTINCT query_id, unnest({TOKENS.replace(TEXT, FOLD.format('question'))}) AS term FROM {QUESTION_SQL}),
    p AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    bm AS (SELECT query_id, doc_id, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / mean))) AS score
           FROM p JOIN f USING (term) JOIN asked USING (term) CROSS JOIN n GROUP BY ALL)"""


def scored(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", text.tokens(F.col("text")).alias("words"))
    asked = t.spark.createDataFrame(QUESTIONS, "query_id int, question string").select("query_id", text.tokens(F.col("question")).alias("words"))
    return retrieval.bm25(docs, asked)


@query(f"WITH {BM25} SELECT query_id, row_number() OVER w AS rank, doc_id, round(score, 6) AS score FROM bm WHERE score > 0 WINDOW w AS (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) QUALIFY rank <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    top = retrieval.top(scored(t).where("score > 0"), 10, [F.desc(F.round("score", 9)), F.col("doc_id")])
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


UNIT = "list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))))"
COSINE = f"""
    e AS (SELECT vec_id, label, {UNIT} AS v FROM embeddings), a AS (SELECT vec_id AS query_id, label AS query_label, v AS q FROM e WHERE vec_id % 100 = 0),
    c AS (SELECT query_id, query_label, vec_id, label, list_dot_product(v, q) AS similarity FROM e CROSS JOIN a)"""


def questions(t: Tables) -> DataFrame:
    """Every hundredth vector asks; the set grows with the table."""
    return t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"WITH {COSINE} SELECT query_id, row_number() OVER w AS rank, vec_id, round(similarity, 6) AS similarity FROM c WINDOW w AS (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) QUALIFY rank <= 10")
def cosine_topk(t: Tables) -> DataFrame:
    top = retrieval.nearest(t.embeddings, questions(t), 10)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {COSINE} SELECT query_id, row_number() OVER w AS rank, vec_id, round(similarity, 6) AS similarity FROM c WHERE label <= 3 AND vec_id % 7 <> 0 WINDOW w AS (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) QUALIFY rank <= 5")
def filtered_cosine_topk(t: Tables) -> DataFrame:
    keep = retrieval.structured(at_most={"label": 3}) & (F.col("vec_id") % 7 != 0)
    top = retrieval.nearest(t.embeddings, questions(t), 5, keep)
    return top.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("similarity", 6).alias("similarity"))


@query("SELECT label, count(*) FILTER (embedding[1] >= 0 AND embedding[2] <= 0.1) AS candidates FROM embeddings GROUP BY label")
def candidate_count(t: Tables) -> DataFrame:
    keep = retrieval.structured(at_least={"x": 0.0}, at_most={"y": 0.1})
    return t.embeddings.select("label", F.get("embedding", 0).alias("x"), F.get("embedding", 1).alias("y")).groupBy("label").agg(F.count_if(keep).alias("candidates"))


RANKS = f"""WITH {COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM c WHERE vec_id <> query_id),
    h AS (SELECT query_id, min(CASE WHEN label = query_label AND rank <= 10 THEN rank END) AS rank, max(similarity) AS best FROM r GROUP BY query_id)"""


def first_hits(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    ranked = retrieval.nearest(t.embeddings, questions(t), 10, others=True)
    named = ranked.join(t.embeddings.select("vec_id", "label"), "vec_id").join(asked, "query_id")
    hit = F.when(F.col("label") == F.col("query_label"), F.col("rank"))
    return named.groupBy("query_id").agg(F.min(hit).alias("rank"), F.max("similarity").alias("best"))


@query(f"{RANKS} SELECT count(*) AS n, avg((coalesce(rank, 99) <= 1)::INT) AS recall_1, avg((coalesce(rank, 99) <= 3)::INT) AS recall_3, avg((coalesce(rank, 99) <= 5)::INT) AS recall_5, avg(coalesce(1.0 / rank, 0)) AS mrr FROM h")
def recall_mrr(t: Tables) -> DataFrame:
    return evaluation.recall_and_mrr(first_hits(t), [1, 3, 5])


@query(f"{RANKS} SELECT query_id, CASE WHEN best < 0.4 THEN 'abstain' ELSE 'answer' END AS decision FROM h")
def abstention_gate(t: Tables) -> DataFrame:
    return first_hits(t).select("query_id", retrieval.gated(F.col("best"), 0.4).alias("decision"))


SNAPSHOTS = "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 5 <> 0", "SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 4 <> 0"


@query(f"""SELECT doc_id, CASE WHEN a.digest IS NULL THEN 'new' WHEN b.digest IS NULL THEN 'obsolete' WHEN a.digest <> b.digest THEN 'updated' ELSE 'existing' END AS status
    FROM ({SNAPSHOTS[0]}) a FULL JOIN ({SNAPSHOTS[1]}) b USING (doc_id)""")
def index_diff(t: Tables) -> DataFrame:
    old = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("digest"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return logs.snapshot_diff(old, t.documents.where("doc_id % 4 <> 0").select("doc_id", F.md5(changed).alias("digest")), "doc_id", "digest")
