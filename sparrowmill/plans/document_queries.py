"""Queries of page cleaning, norms, questions in natural language, places, and index builds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import cleaning, indexing, norms, questions, ranks, relational, retrieval, text
from ..scratch import new_dir
from .registry import Tables, query


@query("""SELECT l_orderkey, string_agg(CASE WHEN b <> l_returnflag THEN chr(10) || l_linestatus ELSE l_linestatus END, chr(10) ORDER BY l_linenumber, k) AS text
    FROM (SELECT *, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, k) AS b FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, 0 AS k FROM lineitem GROUP BY ALL)) GROUP BY 1""")
def block_lines(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    return cleaning.page_text(rows, ["l_orderkey"], "l_returnflag", "l_linenumber", "l_linestatus")


@query("""SELECT doc_id, (list_filter(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN regexp_matches(x, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\\.') THEN i - 1 END), lambda x: x IS NOT NULL))::INT[] AS lines FROM documents""")
def personal_lines(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", cleaning.personal_lines(cleaning.lines_of(F.col("text")), [("mail", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.")]).alias("lines"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS page, sum(l_quantity::BIGINT) AS size FROM lineitem GROUP BY ALL), e AS (SELECT *, sum(size) OVER (PARTITION BY l_orderkey ORDER BY page) - size AS begins FROM p)
    SELECT o_orderkey, o_custkey % 120 AS at, (SELECT max_by(page, begins) FROM e WHERE l_orderkey = o_orderkey AND begins <= o_custkey % 120) AS page FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def page_of_offset(t: Tables) -> DataFrame:
    """The page that holds a character, an as-of join by position."""
    pages = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("page")).agg(F.sum(F.col("l_quantity").cast("long")).alias("size"))
    marks = t.orders.select("o_orderkey", (F.col("o_custkey") % 120).alias("at")).join(pages.select("o_orderkey").distinct(), "o_orderkey", "left_semi")
    return norms.with_pages(marks, pages, "o_orderkey", "at", "size", "page").select("o_orderkey", "at", F.col("page_found").alias("page"))


@query("""WITH h AS (SELECT p_partkey AS hit_id, p_size AS article, p_partkey % 3 = 0 AS is_change FROM part WHERE p_partkey % 11 = 0), c AS (SELECT p_partkey AS change_id, p_size AS article FROM part WHERE p_partkey % 13 = 0)
    SELECT DISTINCT hit_id, change_id AS other_id, 'amended_by' AS relation FROM h JOIN c USING (article) WHERE NOT is_change
    UNION SELECT a.hit_id, b.hit_id, 'amends' FROM h a JOIN h b USING (article) WHERE a.is_change AND NOT b.is_change""")
def versions_both_ways(t: Tables) -> DataFrame:
    hits = t.part.where("p_partkey % 11 = 0").select(F.col("p_partkey").alias("hit_id"), F.col("p_size").alias("article"), (F.col("p_partkey") % 3 == 0).alias("is_change"))
    changes = t.part.where("p_partkey % 13 = 0").select(F.col("p_partkey").alias("change_id"), F.col("p_size").alias("article"))
    return norms.two_way(hits, changes, [])


@query("SELECT p_brand, p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 3 = 0 THEN 1 ELSE 2 END, p_retailprice, p_partkey))::INT AS place FROM part")
def context_order(t: Tables) -> DataFrame:
    keys = norms.context_order(F.col("p_size") % 5 == 0, F.col("p_size") % 3 == 0)
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice", keys[0].alias("__class"))
    placed = ranks.ranked(rows, ["p_brand"], F.col("__class") * 1e6 + F.col("p_retailprice"), [F.col("__class"), F.col("p_retailprice"), F.col("p_partkey")], "place")
    return placed.select("p_brand", "p_partkey", "place")


@query("SELECT DISTINCT p_size AS article, p_size IN (SELECT p_size FROM part WHERE p_partkey % 9 = 0) AS covered FROM part")
def coverage_sets(t: Tables) -> DataFrame:
    return norms.covered(t.part.select(F.col("p_size").alias("article")).distinct(), t.part.where("p_partkey % 9 = 0").select(F.col("p_size").alias("article")))


@query("""WITH p AS (SELECT p_brand, p_partkey AS page, p_retailprice AS score, p_size % 10 = 0 AS needed FROM part), n AS (SELECT *, count(*) FILTER (needed) OVER (PARTITION BY p_brand) AS k, row_number() OVER (PARTITION BY p_brand, needed ORDER BY score DESC, page) AS r FROM p)
    SELECT p_brand, page, CASE WHEN NOT needed THEN r::INT END AS rank, CASE WHEN needed THEN 'mandatory' WHEN r <= greatest(0, 12 - k) THEN 'score' ELSE 'rejected' END AS reason FROM n""")
def page_selection(t: Tables) -> DataFrame:
    pages = t.part.select("p_brand", F.col("p_partkey").alias("page"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 10 == 0).alias("needed"))
    return norms.selected_pages(pages, "p_brand", "page", "score", "needed", 12).select("p_brand", "page", "rank", "reason")


@query("SELECT c_custkey, c_name AS stripped FROM customer")
def prefix_strip(t: Tables) -> DataFrame:
    """Customers' names under the longer of two prefixes, the shorter, and none."""
    k = F.col("c_custkey") % 3
    name = F.concat(F.when(k == 0, "PROVINCIA DE ").when(k == 1, "PROVINCIA  ").otherwise(""), F.col("c_name"))
    return t.customer.select("c_custkey", questions.without_prefix(name, ["PROVINCIA", "PROVINCIA DE"]).alias("stripped"))


@query("SELECT doc_id, regexp_matches(text, 'Ã|Â|�') OR regexp_matches(shown, 'Ã|Â|�') OR regexp_matches(coalesce(lang, ''), 'Ã|Â|�') OR regexp_matches(coalesce(source, ''), 'Ã|Â|�') AS garbled FROM (SELECT *, left(source, 3) || CASE WHEN doc_id % 9 = 0 THEN 'Ã©' ELSE 'é' END AS shown FROM documents)")
def mojibake(t: Tables) -> DataFrame:
    marks = [F.coalesce(F.col(c).rlike("Ã|Â|�"), F.lit(False)) for c in ("text", "shown", "lang", "source")]
    shown = F.concat(F.left("source", F.lit(3)), F.when(F.col("doc_id") % 9 == 0, "Ã©").otherwise("é"))
    return t.documents.withColumn("shown", shown).select("doc_id", reduce(lambda a, b: a | b, marks).alias("garbled"))


@query("SELECT o_orderkey AS \"key\", o_custkey AS buyer, o_totalprice AS amount FROM orders WHERE (o_orderstatus IN ('F', 'O')) AND o_totalprice BETWEEN 10000 AND 200000 AND (o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1996-12-31 23:59:59' OR o_orderdate IS NULL)")
def dashboard_filter(t: Tables) -> DataFrame:
    """Chosen values, an inclusive range, and days to their last second; unknown dates stay."""
    kept = t.orders.where(F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(10000, 200000))
    kept = kept.where(F.col("o_orderdate").between(F.lit("1993-01-01").cast("timestamp_ntz"), F.lit("1996-12-31 23:59:59").cast("timestamp_ntz")) | F.col("o_orderdate").isNull())
    names = {"o_orderkey": "key", "o_custkey": "buyer", "o_totalprice": "amount"}  # a configured renaming
    return kept.select(*[F.col(a).alias(b) for a, b in names.items()])


@query("SELECT doc_id, n_chars >= 200 AND coalesce(quality, 0) >= 1 AS is_text FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)")
def text_page_criterion(t: Tables) -> DataFrame:
    marks = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t.documents.select("doc_id", "n_chars").join(marks, "doc_id", "left").select("doc_id", ((F.col("n_chars") >= 200) & (F.coalesce("quality", F.lit(0)) >= 1)).alias("is_text"))


@query("""SELECT 'duplicate' AS problem, l_orderkey AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'reference', l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2) UNION ALL SELECT 'format', o_orderkey FROM orders WHERE NOT regexp_full_match(o_orderpriority, '[1-4]-[A-Z ]+')""")
def evaluation_set_errors(t: Tables) -> DataFrame:
    """Every violation as a row: repeated keys, dangling references, malformed values."""
    repeated = t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select(F.lit("duplicate").alias("problem"), F.col("l_orderkey").alias("id"))
    dangling = t.lineitem.join(t.part.where("p_size > 2"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.lit("reference").alias("problem"), F.col("l_orderkey").alias("id"))
    malformed = t.orders.where(~F.col("o_orderpriority").rlike("^[1-4]-[A-Z ]+$")).select(F.lit("format").alias("problem"), F.col("o_orderkey").alias("id"))
    return repeated.unionByName(dangling).unionByName(malformed)


@query("SELECT event_id, user_id, u.n AS votes FROM events JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY 1) u USING (user_id) WHERE event_type = 'purchase'")
def joined_feedback(t: Tables) -> DataFrame:
    votes = t.events.where("event_type <> 'purchase'").groupBy("user_id").agg(F.count("*").alias("votes"))
    return t.events.where("event_type = 'purchase'").select("event_id", "user_id").join(votes, "user_id")


@query("""SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS digest, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 1 ELSE 0 END AS built FROM documents WHERE doc_id % 4 <> 0""")
def incremental_index(t: Tables) -> DataFrame:
    """Two builds: the second embeds only what is new or changed, and drops what is gone."""
    path = new_dir(t.spark, "index")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    first = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("digest"))
    second = t.documents.where("doc_id % 4 <> 0").select("doc_id", F.md5(changed).alias("digest"))
    for version, entries in enumerate((first, second)):
        out = indexing.build(t.spark, entries, path, version, "doc_id", "digest", lambda df, v=version: df.withColumn("built", F.lit(v)))
    return out


@query("SELECT p_partkey, coalesce(nullif(concat_ws('. ', nullif(trim(CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END), ''), nullif(trim(CASE WHEN p_size % 2 = 0 THEN p_type END), '')), ''), 'sin texto') AS entry FROM part")
def index_entry(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name")).alias("a"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("b"))
    return rows.select("p_partkey", indexing.entry_text(["a", "b"], "sin texto").alias("entry"))


@query("SELECT doc_id, sha256(concat_ws(' ', source, source, text)) AS digest FROM documents")
def heading_weight(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(indexing.weighted_text(F.col("source"), F.col("text"), 2), 256).alias("digest"))


@query("""WITH l AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
    s AS (SELECT o_custkey AS query_id, o_orderkey AS id, -o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders),
    f AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT query_id, id, rank FROM l UNION ALL SELECT query_id, id, rank FROM s) GROUP BY ALL),
    h AS (SELECT f.query_id, f.id, row_number() OVER (PARTITION BY f.query_id ORDER BY round(rrf, 12) DESC, s.score DESC NULLS LAST, f.id) AS rank FROM f LEFT JOIN s ON s.query_id = f.query_id AND s.id = f.id)
    SELECT 'bm25' AS mode, query_id, id, rank::INT AS rank FROM l WHERE rank <= 2 UNION ALL SELECT 'semantic', query_id, id, rank::INT FROM s WHERE rank <= 2 UNION ALL SELECT 'hybrid', query_id, id, rank::INT FROM h WHERE rank <= 2""")
def search_modes(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    lexical = retrieval.top(rows, 10**9, [F.desc("score"), F.col("id")])
    semantic = retrieval.top(rows.withColumn("score", -F.col("score")), 10**9, [F.desc("score"), F.col("id")])
    lists = [retrieval.found_by(m, lexical, semantic, "id", 2).select(F.lit(m).alias("mode"), "query_id", "id", "rank") for m in ("bm25", "semantic", "hybrid")]
    return reduce(DataFrame.unionByName, lists)


@query("SELECT conv_id, turn, n IS NOT NULL AND length(trim(n)) > 0 AS valid FROM (SELECT conv_id, turn, json_extract_string(CASE WHEN turn % 3 = 0 THEN '{\"n\": \"' || turn || '\"}' WHEN turn % 3 = 1 THEN '{\"m\": 1}' ELSE '{\"n\": \" \"}' END, '$.n') AS n FROM conversations)")
def structured_output(t: Tables) -> DataFrame:
    """Model output as JSON against its schema: missing and blank fields are invalid."""
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"n": "'), F.col("turn").cast("string"), F.lit('"}'))).when(F.col("turn") % 3 == 1, '{"m": 1}').otherwise('{"n": " "}')
    got = F.from_json(line, "n string")["n"]
    return t.conversations.select("conv_id", "turn", (got.isNotNull() & (F.length(F.trim(got)) > 0)).alias("valid"))


@query("SELECT conv_id, turn, left(role || ': ' || regexp_replace(text, '\\s+', ' ', 'g'), 300) AS line FROM conversations")
def message_lines(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.left(F.concat("role", F.lit(": "), F.regexp_replace("text", r"\s+", " ")), F.lit(300)).alias("line"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?m)^[A-Z][a-z]+[.]$'))::INT AS headings, len(string_split(text, chr(10)))::INT AS lines, (text LIKE '%license%') AS legal FROM documents""")
def structure_map(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.documents.select("doc_id", F.regexp_count(c, F.lit("(?m)^[A-Z][a-z]+[.]$")).alias("headings"), F.size(F.split(c, "\n")).alias("lines"), c.contains("license").alias("legal"))


@query("""SELECT o_custkey, list_sort(list(o_orderkey) FILTER (o_orderstatus = 'F')) = list_sort(list(o_orderkey) FILTER (o_totalprice > 100000)) AS same FROM orders GROUP BY 1""")
def expected_pages_check(t: Tables) -> DataFrame:
    held = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("o_orderkey"))))
    out = t.orders.groupBy("o_custkey").agg(held(F.col("o_orderstatus") == "F").alias("a"), held(F.col("o_totalprice") > 100000).alias("b"))
    return out.select("o_custkey", F.when((F.size("a") > 0) & (F.size("b") > 0), F.col("a") == F.col("b")).alias("same"))


@query("""SELECT level, family, count(*) AS clips, round(avg(duration), 6) AS duration, max(peak) AS peak FROM (SELECT l_linenumber AS level, l_returnflag AS family, l_quantity AS duration, l_tax AS peak FROM lineitem) GROUP BY ALL""")
def ladder_manifest(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_linenumber").alias("level"), F.col("l_returnflag").alias("family"), F.col("l_quantity").alias("duration"), F.col("l_tax").alias("peak"))
    return rows.groupBy("level", "family").agg(F.count("*").alias("clips"), F.round(F.avg("duration"), 6).alias("duration"), F.max("peak").alias("peak"))


@query("SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS \"F\", sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS \"O\" FROM lineitem GROUP BY 1")
def notebook_pivot(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().fillna(0)


@query("""WITH o AS (SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers, count(*) FILTER (l_returnflag = 'R') AS n_returned, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, string_agg(DISTINCT l_linestatus, ' | ' ORDER BY l_linestatus) AS states FROM lineitem GROUP BY 1),
    p AS (SELECT l_orderkey, count(DISTINCT p_brand) AS n_brands, max(p_retailprice) AS dearest FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), s AS (SELECT l_orderkey, count(DISTINCT s_nationkey) AS n_nations FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
    c AS (SELECT c_custkey, c_mktsegment, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey), k AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1)
    SELECT o_orderkey, c_mktsegment, n_name, n_orders, coalesce(n_lines, 0) AS n_lines, coalesce(n_suppliers, 0) AS n_suppliers, coalesce(n_returned, 0) AS n_returned, coalesce(n_brands, 0) AS n_brands, coalesce(n_nations, 0) AS n_nations, dearest, first_ship, last_ship, states
    FROM orders LEFT JOIN o ON o.l_orderkey = o_orderkey LEFT JOIN p ON p.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN c ON c_custkey = orders.o_custkey LEFT JOIN k ON k.o_custkey = orders.o_custkey""")
def normalized_records(t: Tables) -> DataFrame:
    """One row per key over six child tables, whose grain never multiplies rows."""
    return normalized_rows(t)


def normalized_rows(t: Tables) -> DataFrame:
    key = F.col("l_orderkey").alias("o_orderkey")
    lines = t.lineitem.groupBy(key).agg(F.count("*").alias("n_lines"), F.count_distinct("l_suppkey").alias("n_suppliers"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), relational.distinct_concat("l_linestatus").alias("states"))
    parts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(key).agg(F.count_distinct("p_brand").alias("n_brands"), F.max("p_retailprice").alias("dearest"))
    nations = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(key).agg(F.count_distinct("s_nationkey").alias("n_nations"))
    base = relational.left_joined(t.orders.select("o_orderkey", "o_custkey"), [(lines, ["n_lines", "n_suppliers", "n_returned"]), (parts, ["n_brands"]), (nations, ["n_nations"])], "o_orderkey")
    buyers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    orders = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    return relational.left_joined(base, [(buyers, []), (orders, [])], "o_custkey").drop("o_custkey")
