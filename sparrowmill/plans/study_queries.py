"""Queries of studies: rules in full, slices, sensitivity, reports, validation, and changes of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import benchmarks, chunking, evaluation, grouping, quality, relational, resampling, text
from . import document_queries, metric_queries, text_queries
from .registry import ORACLE_SQL, Tables, query

#: Seventeen lines of nine rules, over one row per order.
RULES = [
    ("R1", "n_lines = 0", "orders"), ("R2a", "n_orders < 2", "orders"), ("R2b", "n_orders > 40", "orders"), ("R2c", "n_orders IS NULL", "orders"), ("R3a", "first_ship IS NULL", "orders"),
    ("R3b", "last_ship < first_ship", "orders"), ("R4", "n_suppliers = 1", "orders"), ("R5", "dearest > 1800", "orders"), ("R6a", "n_returned > 0", "orders"), ("R6b", "n_returned = n_lines AND n_lines > 0", "orders"),
    ("R7a", "states = 'F | O'", "orders"), ("R7b", "states IS NULL", "orders"), ("R8a", "n_brands > 5", "orders"), ("R8b", "n_brands < n_lines", "orders"), ("R8c", "n_nations = n_suppliers AND n_lines > 0", "orders"),
    ("R9a", "n_name = 'FRANCE'", "buyers"), ("R9b", "c_mktsegment IS NULL", "buyers"),
]


@query(f"""WITH n AS ({ORACLE_SQL["normalized_records"]}), u AS (SELECT o_orderkey, unnest([{", ".join(f"'{r}'" for r, _, _ in RULES)}]) AS rule, unnest([{", ".join(f"'{u}'" for _, _, u in RULES)}]) AS unit, unnest([{", ".join(f"coalesce({p}, false)" for _, p, _ in RULES)}]) AS marked FROM n)
    SELECT rule, unit, count(*) FILTER (marked) AS marked, count(*) AS total, (count(*) FILTER (marked))::DOUBLE / count(*) AS share, array_to_string(list_sort(list(o_orderkey) FILTER (marked))[1:3], ', ') AS examples FROM u GROUP BY ALL""")
def rule_report(t: Tables) -> DataFrame:
    """Every line of the rule report, from one row per key over six child tables."""
    rules = [quality.Rule(name, f"flag_{name.lower()}", predicate, unit) for name, predicate, unit in RULES]
    return quality.report(quality.flagged(document_queries.normalized_rows(t), rules), rules, "o_orderkey", 3)


VALID = [("id", "c_custkey > 0"), ("name", "regexp_matches(c_name, '^Customer#[0-9]{9}$')"), ("nation", "c_nationkey BETWEEN 0 AND 24"), ("balance", "c_acctbal BETWEEN -900 AND 9000"), ("segment", "c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')"), ("phone", "regexp_matches(c_phone, '^9[0-9]{8}$')"), ("mail", "regexp_matches(c_mail, '^[a-z0-9.]+@[a-z]+[.]com$')"), ("document", "regexp_matches(c_document, '^[0-9]{8}$')"), ("born", "c_born IS NOT NULL"), ("joined", "c_joined >= c_born"), ("mode", "c_mode IN ('remoto', 'mixto')"), ("site", "length(trim(c_site)) > 0")]
PERSONS = """SELECT *, (900000000 + c_custkey * 7919 % 200000000)::VARCHAR AS c_phone, CASE WHEN c_custkey % 6 = 0 THEN 'sin correo' ELSE 'c' || c_custkey || '@mail.com' END AS c_mail, (1000000 + c_custkey * 104729 % 90000000)::VARCHAR AS c_document,
    coalesce(try_strptime(born, '%Y-%m-%d'), try_strptime(born, '%d/%m/%Y'))::DATE AS c_born, DATE '1999-06-01' AS c_joined, CASE WHEN c_custkey % 4 = 0 THEN 'otro' ELSE 'mixto' END AS c_mode, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'Lima' END AS c_site
    FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN '1990-02-03' WHEN 1 THEN '31/12/2000' ELSE 'ayer' END AS born FROM customer)"""


@query(f"""SELECT c_custkey, list_filter([{", ".join(f"CASE WHEN NOT coalesce({p}, false) THEN '{n}' END" for n, p in VALID)}], lambda x: x IS NOT NULL) AS errors FROM ({PERSONS})""")
def record_validation(t: Tables) -> DataFrame:
    """Twelve fields of a form: patterns, catalogues, ranges, and dates in several formats."""
    from ..operators import calendar

    k = F.col("c_custkey")
    born = F.when(k % 3 == 0, "1990-02-03").when(k % 3 == 1, "31/12/2000").otherwise("ayer")
    rows = t.customer.withColumns({
        "c_phone": (F.lit(900000000) + k * 7919 % 200000000).cast("string"), "c_mail": F.when(k % 6 == 0, "sin correo").otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.com"))),
        "c_document": (F.lit(1000000) + k * 104729 % 90000000).cast("string"), "c_born": calendar.any_date(born, ["yyyy-MM-dd", "dd/MM/yyyy"]), "c_joined": F.lit("1999-06-01").cast("date"),
        "c_mode": F.when(k % 4 == 0, "otro").otherwise("mixto"), "c_site": F.when(k % 9 == 0, " ").otherwise("Lima")})
    checks = [(n, ~F.coalesce(F.expr(p.replace("regexp_matches(", "regexp_like(")), F.lit(False))) for n, p in VALID]
    return rows.select("c_custkey", quality.errors(checks).alias("errors"))


@query(f"{text_queries.RANKS}, s AS (SELECT h.*, e.label FROM h JOIN embeddings e ON e.vec_id = h.query_id) SELECT coalesce(CASE WHEN grouping(label) = 1 THEN 'ALL' END, label::VARCHAR) AS label, count(*) AS n, avg((coalesce(rank, 99) <= 1)::INT) AS recall_1, avg((coalesce(rank, 99) <= 5)::INT) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM s GROUP BY ROLLUP (label)")
def recall_by_slice(t: Tables) -> DataFrame:
    ranks = text_queries.first_hits(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return evaluation.sliced(ranks, "label", [1, 5]).withColumn("mrr", F.round("mrr", 9))


@query(f"{text_queries.RANKS} SELECT query_id FROM h WHERE coalesce(rank, 99) > 1")
def failures_at_1(t: Tables) -> DataFrame:
    return evaluation.failures(text_queries.first_hits(t), 1).select("query_id")


@query(f"WITH {metric_queries.sweep(metric_queries.APART)}, r AS (SELECT t, round(f, 12) AS f, abstained, undue FROM f), m AS (SELECT max(t) AS top FROM r WHERE f = (SELECT max(f) FROM r)) SELECT t, round(f, 9) AS f FROM r WHERE t = (SELECT max(t) FROM r WHERE t <= (SELECT top - 5 FROM m))")
def cautious_threshold(t: Tables) -> DataFrame:
    table = evaluation.threshold_table(metric_queries.points_apart(t), 700, 950).withColumn("f", F.round("f", 12))
    return evaluation.cautious(table, 5).where("t is not null").withColumn("f", F.round("f", 9))


@query(f"WITH {metric_queries.sweep(metric_queries.APART)} SELECT t, abstained FROM f WHERE undue = (SELECT min(undue) FROM f) AND undue = 0 ORDER BY abstained, t DESC LIMIT 1")
def threshold_without_undue(t: Tables) -> DataFrame:
    return evaluation.without_undue(evaluation.threshold_table(metric_queries.points_apart(t), 700, 950)).where("t is not null")


@query("""WITH r AS (SELECT l_orderkey AS k, min(n) AS a, max(n) AS b FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)) GROUP BY l_orderkey, i)
    SELECT k AS l_orderkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges, sum(b - a + 1)::INT AS n FROM r GROUP BY 1""")
def ranges_there_and_back(t: Tables) -> DataFrame:
    """Runs of numbers as text, and the numbers of that text again."""
    out = evaluation.ranges_as_text(evaluation.consecutive_runs(t.lineitem, "l_orderkey", "l_linenumber"), "l_orderkey")
    return out.withColumn("n", F.size(evaluation.numbers_of_ranges(F.col("ranges"))))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, count(*) FILTER (value > 90) AS limited, count(*) FILTER (value < 10) AS refused, round(sum(value), 4) AS cost, round(sum(value) / count(*) * 1000, 4) AS per_thousand FROM events GROUP BY ALL")
def cost_by_day(t: Tables) -> DataFrame:
    cost = F.sum("value")
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(
        F.count("*").alias("calls"), F.count_if(F.col("value") > 90).alias("limited"), F.count_if(F.col("value") < 10).alias("refused"), F.round(cost, 4).alias("cost"), F.round(cost / F.count("*") * 1000, 4).alias("per_thousand"))


@query("""SELECT coalesce(CASE WHEN grouping(source) = 1 THEN 'TOTAL' END, source) AS source, count(*) AS n, min(n_chars) AS least, median(n_chars) AS middle, round(quantile_cont(n_chars, 0.95), 4) AS p95, max(n_chars) AS most, count(*) FILTER (n_chars > 2000) AS truncated FROM documents GROUP BY ROLLUP (source)""")
def index_report(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    plain = [F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(n > 2000).alias("truncated")]
    return grouping.with_total_and_quantiles(t.documents, "source", plain, "n_chars", {"middle": 0.5, "p95": 0.95}).withColumn("p95", F.round("p95", 4))


@query("""WITH s AS (SELECT p_brand, k, n / sum(n) OVER (PARTITION BY k) AS share FROM (SELECT p_brand, p_partkey % 3 AS k, count(*) AS n FROM part GROUP BY ALL))
    SELECT p_brand, round(max(share) FILTER (k = 0), 9) AS "0", round(max(share) FILTER (k = 1), 9) AS "1", round(max(share) FILTER (k = 2), 9) AS "2", round(max(share) - min(share), 9) AS apart FROM s GROUP BY 1 HAVING count(*) = 3""")
def balance_of_splits(t: Tables) -> DataFrame:
    """A group's share of each split, and how far apart the shares are."""
    counts = t.part.groupBy("p_brand", (F.col("p_partkey") % 3).alias("k")).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("k")))
    wide = shares.groupBy("p_brand").pivot("k", [0, 1, 2]).agg(F.max("share")).dropna()
    return wide.select("p_brand", *[F.round(c, 9).alias(c) for c in ("0", "1", "2")], F.round(F.greatest("0", "1", "2") - F.least("0", "1", "2"), 9).alias("apart"))


@query("""SELECT l_returnflag, round(avg(abs(l_extendedprice - 30000)) FILTER (b = '0-2'), 4) AS "0-2", round(avg(abs(l_extendedprice - 30000)) FILTER (b = '3-5'), 4) AS "3-5", round(avg(abs(l_extendedprice - 30000)) FILTER (b = '6-10'), 4) AS "6-10", round(avg(abs(l_extendedprice - 30000)) FILTER (b = '11+'), 4) AS "11+"
    FROM (SELECT *, CASE WHEN l_quantity <= 2 THEN '0-2' WHEN floor(l_quantity) <= 5 THEN '3-5' WHEN floor(l_quantity) <= 10 THEN '6-10' ELSE '11+' END AS b FROM lineitem) GROUP BY 1""")
def error_by_band(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("b", quality.band(F.col("l_quantity")))
    wide = rows.groupBy("l_returnflag").pivot("b", ["0-2", "3-5", "6-10", "11+"]).agg(F.avg(F.abs(F.col("l_extendedprice") - 30000)))
    return wide.select("l_returnflag", *[F.round(f"`{c}`", 4).alias(c) for c in ("0-2", "3-5", "6-10", "11+")])


@query("""SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS balance, count(DISTINCT c_nationkey) AS nations, count(*)::DOUBLE / count(DISTINCT c_nationkey) AS per_nation FROM customer GROUP BY 1 ORDER BY balance DESC NULLS LAST, 1""")
def counts_per_key(t: Tables) -> DataFrame:
    out = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("balance"), F.count_distinct("c_nationkey").alias("nations"))
    return out.withColumn("per_nation", F.col("n") / F.col("nations")).orderBy(F.desc_nulls_last("balance"), "c_mktsegment")


@query("SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS first_urgent FROM orders WHERE o_orderpriority LIKE '%URGENT%' GROUP BY 1")
def first_with_role(t: Tables) -> DataFrame:
    urgent = t.orders.where(F.col("o_orderpriority").contains("URGENT"))
    return relational.latest_per_key(urgent, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("first_urgent"))


@query(f"""SELECT p_partkey FROM part ORDER BY {metric_queries.DRAW.format("p_partkey || '|42'")}, p_partkey LIMIT 25""")
def seeded_sample(t: Tables) -> DataFrame:
    """Twenty-five rows drawn by a seed; the number is the sample's."""
    return t.part.select("p_partkey").orderBy(resampling.draw(F.col("p_partkey"), F.lit("42")), "p_partkey").limit(25)


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_returnflag, count(*) AS n FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag) GROUP BY ALL")
def five_key_join(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    left = t.lineitem.groupBy(*keys).agg(F.count("*").alias("a"))
    return left.join(t.lineitem.groupBy(*keys).agg(F.count("*").alias("b")), keys).select(*keys, (F.col("a") * F.col("b")).alias("n"))


@query("SELECT device, model, precision, l_returnflag || '/' || precision AS label FROM (SELECT DISTINCT l_returnflag FROM lineitem) CROSS JOIN (VALUES ('cpu', 'medium'), ('cuda', 'large')) d(device, model) CROSS JOIN (VALUES ('int8'), ('float16')) p(precision) WHERE NOT (device = 'cpu' AND precision = 'float16')")
def configuration_grid(t: Tables) -> DataFrame:
    """Every allowed combination of a few settings, the product of short literal lists."""
    flags = t.lineitem.select("l_returnflag").distinct()
    devices = t.spark.createDataFrame([("cpu", "medium"), ("cuda", "large")], "device string, model string").withColumn("precision", F.explode(F.array(F.lit("int8"), F.lit("float16"))))
    grid = flags.join(devices.where("not (device = 'cpu' and precision = 'float16')"), F.lit(True))
    return grid.select("device", "model", "precision", F.concat_ws("/", "l_returnflag", "precision").alias("label"))


@query("""SELECT size, count(*) AS chunks, round(avg(length(chunk)), 6) AS mean, count(DISTINCT doc_id) AS docs FROM (
    SELECT doc_id, size, substr(text, i * (size - 100) + 1, size) AS chunk FROM (SELECT doc_id, text, size, unnest(range(greatest(1, ceil((length(text) - 100) / (size - 100.0))::BIGINT))) AS i FROM documents CROSS JOIN (VALUES (500), (750), (1000)) v(size) WHERE length(text) > 0)) GROUP BY size""")
def chunk_configurations(t: Tables) -> DataFrame:
    """The same documents chunked by several configurations, one row for each."""
    docs = t.documents.where(F.length("text") > 0).select("doc_id", "text")
    runs = [chunking.fixed(docs, size, 100).select(F.lit(size).alias("size"), "doc_id", F.length("chunk").alias("n")) for size in (500, 750, 1000)]
    return reduce(DataFrame.unionByName, runs).groupBy("size").agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("mean"), F.count_distinct("doc_id").alias("docs"))


@query("""WITH v AS (SELECT variant, year(o_orderdate) + k AS y, o_totalprice AS p FROM orders CROSS JOIN (VALUES ('plain', 0), ('shifted', 3), ('far', 10)) v(variant, k))
    SELECT variant, count(*) AS n, round(avg(abs(y - 1995)), 9) AS mae, round(avg(y - 1995), 9) AS bias FROM v GROUP BY 1""")
def sensitivity_matrix(t: Tables) -> DataFrame:
    """The same figures for every variant of the input, in one table."""
    line = F.concat(F.lit("in "), F.year("o_orderdate").cast("string"), F.lit(" and 12345"))
    runs = [t.orders.select(F.lit(name).alias("variant"), text.year_tokens(text.shifted_years(line, by))[0].cast("int").alias("y")) for name, by in (("plain", 0), ("shifted", 3), ("far", 10))]
    off = F.col("y") - 1995
    return reduce(DataFrame.unionByName, runs).groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(off)), 9).alias("mae"), F.round(F.avg(off), 9).alias("bias"))


@query("""WITH d AS (SELECT l_linestatus AS model, l_returnflag AS arm, l_suppkey AS clip, sum(l_linenumber)::DOUBLE / sum(l_quantity) AS wer FROM lineitem GROUP BY ALL),
    p AS (SELECT model, clip, max(wer) FILTER (arm = 'A') AS a, max(wer) FILTER (arm = 'R') AS b FROM d GROUP BY ALL), e AS (SELECT model, count(*) AS pairs, count(*) FILTER (b < a) AS improved, round(avg(b - a), 9) AS mean FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
    SELECT model, errors / total AS rate, pairs, improved, mean FROM (SELECT l_linestatus AS model, sum(l_linenumber)::DOUBLE AS errors, sum(l_quantity) AS total FROM lineitem GROUP BY 1) JOIN e USING (model)""")
def benchmark_rollup(t: Tables) -> DataFrame:
    """Detail to corpus rate to paired effect, one row for each model."""
    rows = t.lineitem.select(F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("arm"), F.col("l_suppkey").alias("clip"), "l_linenumber", "l_quantity")
    detail = benchmarks.corpus_rate(rows, ["model", "arm", "clip"], "l_linenumber", "l_quantity", "wer")
    effect = benchmarks.effect(resampling.paired(detail, "arm", "A", "R", ["model", "clip"], "wer"), ["model"])
    whole = benchmarks.corpus_rate(rows, ["model"], "l_linenumber", "l_quantity")
    return whole.join(effect, "model").select("model", "rate", "pairs", "improved", F.round("mean", 9).alias("mean"))


@query("""SELECT layer, field, count(*) FILTER (ok) AS right, count(*) AS n FROM (SELECT unnest(['rules', 'model']) AS layer, unnest(['segment', 'segment']) AS field, unnest([c_mktsegment = 'BUILDING', c_custkey % 3 = 0]) AS ok FROM customer
    UNION ALL SELECT unnest(['rules', 'model']), unnest(['balance', 'balance']), unnest([c_acctbal > 0, c_acctbal > 1000]) FROM customer) GROUP BY ALL""")
def extractor_table(t: Tables) -> DataFrame:
    """Fields by extractor: right ones of all."""
    c = F.col
    facts = [("rules", "segment", c("c_mktsegment") == "BUILDING"), ("model", "segment", c("c_custkey") % 3 == 0), ("rules", "balance", c("c_acctbal") > 0), ("model", "balance", c("c_acctbal") > 1000)]
    each = t.customer.select(F.explode(F.array(*[F.struct(F.lit(a).alias("layer"), F.lit(b).alias("field"), x.alias("ok")) for a, b, x in facts])).alias("f")).select("f.*")
    return each.groupBy("layer", "field").agg(F.count_if("ok").alias("right"), F.count("*").alias("n"))
