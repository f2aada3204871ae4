"""The queries of this subpackage and their SQL; ``__spark_entry__`` registers them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, cohorts, conversation_repair, decontamination, jaccard_join, langid, merkle, mixing, substring_dedup, token_files, toxicity, vector_files, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of a folder of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored for toxicity, learned from labelled rows that are not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of all sources takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows that are not held out."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shingles of every document and the group that links put it in."""
    return jaccard_join.similarity_groups(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files, read back from them."""
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC into WARC files and back."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth one."""
    return vector_files.top_k(table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that an earlier one has, and which one has them."""
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "begin", "end", "first_doc_id")


def op11_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of clients by the week of their first error, as known in February and at the end."""
    known = [cohorts.known_before(3, "2024-02-01 00:00:00"), F.lit(True)]
    return cohorts.retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"), known)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items, and the items they are of."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation once damaged, and its cheapest repair."""
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"), damage=True)


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_mixing, op3_language_id, op4_jaccard_join, op5_fingerprints, op6_token_files, op7_bpe, op8_warc, op9_exact_top_k, op10_substring_dedup, op11_cohort_retention, op12_decontamination, op13_conversation_repair)
}

#: crc32 in SQL: ``crc`` is the list of the 256 values of a byte, ``of`` folds a text's ASCII bytes into its checksum.
CRC_TABLE = "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i))"


def crc(text: str) -> str:
    """SQL of the crc32 of an ASCII text, for queries that have the table ``crc``."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295)"


def after(state: str, cost: str, label: str, text: str = "NULL") -> str:
    """SQL of a path (cost, audit, repaired text) one edit later."""
    joined = f"{state}.r" if text == "NULL" else f"coalesce({state}.r || chr(10), '') || {text}"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{label}', 'r': {joined}}} END"


def least(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


def kept(state: str, initial: str, role: str) -> str:
    """SQL of a row that is kept where its role begins as the grammar asks, and gets another role where it doesn't."""
    told = after(state, "1 + more", "R", f"'{role}:' || text") if initial != "s" else "NULL"
    return f"CASE WHEN NOT lost THEN CASE WHEN role[1] = '{initial}' THEN {after(state, 'more', 'K', "role || ':' || text")} ELSE {told} END END"


ORACLE_SQL: dict[str, str] = {
    "op13_conversation_repair": rf"""
        WITH RECURSIVE {CRC_TABLE},
        c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h
            FROM conversations, crc),
        d AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                   CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
            FROM c WHERE h <> 0),
        n AS (
            SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS previous
            FROM d),
        rows AS (
            SELECT *, shown = '' AS blank, shown <> '' AND nth > 1 AS duplicate, shown <> '' AND nth = 1 AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated,
                   (shown = '' OR nth > 1) AS lost, CASE WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS more
            FROM n),
        steps AS (
            SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 'r': NULL::VARCHAR}} AS b0, NULL::STRUCT(c INT, a VARCHAR, r VARCHAR) AS b1,
                   {{'c': 5, 'a': 'I', 'r': 'user:'}} AS b2, {{'c': 10, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} AS b3
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, n0, n1, m2, {least("n3", after("m2", "5", "I", "'assistant:'"))} AS m3
            FROM (
                SELECT *, {least("n2", *[after(b, "5", "I", "'user:'") for b in ("n0", "n1", "n3")])} AS m2
                FROM (
                    SELECT s.conv_id, r.i,
                           {after("b0", "2", "D")} AS n0,
                           {least(after("b1", "2", "D"), kept("b0", "s", "system"))} AS n1,
                           {least(after("b2", "2", "D"), *[kept(b, "u", "user") for b in ("b0", "b1", "b3")])} AS n2,
                           {least(after("b3", "2", "D"), kept("b2", "a", "assistant"))} AS n3
                    FROM steps s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1))),
        best AS (SELECT conv_id, list_min([b0, b3]) AS b FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
                   count_if(previous IS NOT NULL AND left(previous, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
            FROM rows GROUP BY conv_id)
        SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
               coalesce(illegal, 0)::BIGINT AS illegal, b.b.c::BIGINT AS cost, b.b.a AS audit, sha256(coalesce(b.b.r, '')) AS repaired_sha256
        FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id""",
    "op11_cohort_retention": f"""
        WITH {CRC_TABLE},
        c AS (
            SELECT *, CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END AS late
            FROM (SELECT *, {crc('click_id::VARCHAR')} AS h FROM (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL), crc)),
        known AS (
            SELECT 1 AS state, * FROM c
            UNION ALL SELECT 0 AS state, * FROM c WHERE arrived_at + to_days(late::INT) < TIMESTAMP '2024-02-01 00:00:00'),
        starts AS (SELECT state, client_id, min(epoch_us(ts)) AS start FROM known WHERE kind = 'error' GROUP BY ALL),
        users AS (
            SELECT k.state, k.client_id, s.start // 604800000000 AS cohort, (epoch_us(k.ts) - s.start) // 604800000000 AS period,
                   sum(coalesce(floor(100 * value + 0.5), 0)::BIGINT) AS cents
            FROM known k JOIN starts s ON s.state = k.state AND s.client_id = k.client_id AND epoch_us(k.ts) >= s.start GROUP BY ALL),
        moving AS (
            SELECT a.client_id FROM starts a JOIN starts b ON a.client_id = b.client_id AND a.state = 0 AND b.state = 1 AND a.start // 604800000000 <> b.start // 604800000000),
        sources AS (SELECT client_id, min(source) AS source FROM clients GROUP BY ALL)
        SELECT state::INT AS state, coalesce(source, '') AS segment, cohort::BIGINT AS cohort, period::BIGINT AS period, count(*)::BIGINT AS users,
               sum({crc('u.client_id::VARCHAR')})::BIGINT AS users_crc32, count(m.client_id)::BIGINT AS moved, sum(cents)::BIGINT AS cents
        FROM users u CROSS JOIN crc LEFT JOIN sources USING (client_id) LEFT JOIN moving m USING (client_id)
        GROUP BY ALL""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
            FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (
            SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * common >= 80 * (x.n + y.n - common)),
        reached AS (
            SELECT doc_id, doc_id AS root FROM documents
            UNION SELECT links.v AS doc_id, reached.root FROM reached JOIN links ON links.u = reached.doc_id)
        SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
        FROM documents d JOIN (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id) r USING (doc_id) LEFT JOIN sizes s USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        kept AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN last <> page_id THEN last END AS refers_to
        FROM p LEFT JOIN kept USING (payload_digest)""",
    "op9_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT::DOUBLE) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 10""",
    "op12_decontamination": r"""
        WITH w AS (
            SELECT 'item' AS kind, item_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
            UNION ALL
            SELECT 'doc', doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM documents),
        windows AS (
            SELECT DISTINCT id AS item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s
            FROM w WHERE kind = 'item' AND len(w) > 0),
        sizes AS (SELECT DISTINCT n FROM windows),
        runs AS (
            SELECT id AS doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
            FROM w, sizes WHERE kind = 'doc' AND len(w) >= n),
        found AS (SELECT doc_id, item_id, i, n FROM runs JOIN windows USING (n, s)),
        hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM found) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
        SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN hit ON hit.doc_id = id LEFT JOIN named ON named.doc_id = id WHERE kind = 'doc'""",
}
