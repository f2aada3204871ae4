"""Queries over keys, groups and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import grouping, quality, relational
from .registry import Tables, query

PROCESSES = """
    SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, coalesce(l.n_lines, 0) AS n_lines, coalesce(l.n_suppliers, 0) AS n_suppliers, l.revenue, l.first_ship
    FROM orders o LEFT JOIN (
        SELECT l_orderkey, count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers, sum(round(l_extendedprice * (1 - l_discount) * 10000)::BIGINT)::BIGINT / 10000.0::DOUBLE AS revenue, min(l_shipdate) AS first_ship
        FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey"""


def processes(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_lines"), F.count_distinct("l_suppkey").alias("n_suppliers"),
        (F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long")) / 10000.0).alias("revenue"), F.min("l_shipdate").alias("first_ship"))
    base = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return relational.left_joined(base, [(lines, ["n_lines", "n_suppliers"])], "o_orderkey")


@query(f"""WITH p AS ({PROCESSES})
    SELECT n.n_name, count(*) AS processes, count(*) FILTER (p.n_suppliers = 1) AS single_supplier,
           (count(*) FILTER (p.n_suppliers = 1))::DOUBLE / count(*) AS share, sum(round(p.revenue * 10000)::BIGINT)::BIGINT / 10000.0::DOUBLE AS amount
    FROM p JOIN customer c ON c.c_custkey = p.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
    WHERE p.n_lines > 0 GROUP BY n.n_name HAVING count(*) >= 20""")
def single_supplier_risk(t: Tables) -> DataFrame:
    """The flagship: share of single-supplier processes by nation, groups below 20 left out."""
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    rows = processes(t).where("n_lines > 0").join(named, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumn("units", F.round(F.col("revenue") * 10000).cast("long"))  # sums that don't hang on order
    out = grouping.share_by_group(rows, "n_name", F.col("n_suppliers") == 1, "units", 20)
    return out.select("n_name", F.col("n").alias("processes"), F.col("flagged").alias("single_supplier"), "share", (F.col("amount") / 10000.0).alias("amount")).orderBy(F.desc("share"), "n_name")


@query(f"SELECT o_orderkey, n_lines, n_suppliers, revenue, first_ship FROM ({PROCESSES})")
def one_row_per_key(t: Tables) -> DataFrame:
    return processes(t).select("o_orderkey", "n_lines", "n_suppliers", "revenue", "first_ship")


@query(f"""WITH p AS ({PROCESSES})
    SELECT count(*) AS processes, count(*) FILTER (n_suppliers = 1) AS single_supplier, (count(*) FILTER (n_suppliers = 1))::DOUBLE / count(*) AS share,
           (SELECT count(*) FROM (SELECT o_custkey FROM p WHERE n_lines > 0 GROUP BY 1 HAVING count(*) >= 5)) AS customers_with_enough
    FROM p WHERE n_lines > 0""")
def global_share(t: Tables) -> DataFrame:
    rows = processes(t).where("n_lines > 0")
    enough = rows.groupBy("o_custkey").count().agg(F.count_if(F.col("count") >= 5).alias("customers_with_enough"))
    whole = rows.agg(F.count("*").alias("processes"), F.count_if(F.col("n_suppliers") == 1).alias("single_supplier"))
    return whole.withColumn("share", F.col("single_supplier") / F.col("processes")).crossJoin(enough)  # one row each


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1""")
def latest_per_key(t: Tables) -> DataFrame:
    return relational.latest_per_key(t.events, ["user_id"], [F.desc_nulls_last("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, count(*) - 1 AS discarded FROM events GROUP BY user_id""")
def discarded_rows(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg((F.count("*") - 1).alias("discarded"))


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicate FROM documents")
def duplicate_flags(t: Tables) -> DataFrame:
    # a digest stands for the text, so texts are not shuffled
    return relational.with_duplicate_flag(t.documents.select("doc_id", F.sha2("text", 256).alias("digest")), ["digest"]).select("doc_id", "is_duplicate")


@query("""SELECT DISTINCT l_orderkey, n_suppliers FROM (SELECT l_orderkey, len(list_distinct(list(l_suppkey) OVER (PARTITION BY l_orderkey)))::INT AS n_suppliers FROM lineitem)""")
def distinct_over_window(t: Tables) -> DataFrame:
    return relational.with_distinct_count(t.lineitem.select("l_orderkey", "l_suppkey"), ["l_orderkey"], "l_suppkey", "n_suppliers").select("l_orderkey", "n_suppliers").distinct()


@query("""SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1) AS has_discount FROM orders""")
def semi_flag(t: Tables) -> DataFrame:
    marked = t.lineitem.where("l_discount >= 0.1").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.with_membership_flag(t.orders.select("o_orderkey"), marked, "o_orderkey", "has_discount")


@query("""SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders) o
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders WHERE o_orderstatus = 'F') f
                      WHERE f.o_orderkey = o.o_orderkey AND f.o_orderpriority IS NOT DISTINCT FROM o.o_orderpriority)""")
def anti_join_left(t: Tables) -> DataFrame:
    """Anti join on a composite key whose second part may be null on both sides."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"))
    done = rows.where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority")
    return relational.null_safe_anti_join(rows.select("o_orderkey", "o_orderpriority"), done, ["o_orderkey"], ["o_orderpriority"])


@query("""WITH o AS (SELECT o_orderkey AS k, nullif(o_orderpriority, '5-LOW') AS p FROM orders WHERE o_orderstatus = 'O'), l AS (SELECT l_orderkey AS k, nullif((l_orderkey % 5 + 1) || '-' || ['URGENT', 'HIGH', 'MEDIUM', 'NOT SPECIFIED', 'LOW'][1 + l_orderkey % 5], '5-LOW') AS p FROM lineitem)
    SELECT k AS l_orderkey, count(*) AS orphan_lines FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = l.k AND o.p IS NOT DISTINCT FROM l.p) GROUP BY 1""")
def anti_join_right(t: Tables) -> DataFrame:
    """Lines without an open order of their key and of the priority that they tell, which may be unknown on both sides."""
    open_ = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))
    told = F.expr("nullif(concat(l_orderkey % 5 + 1, '-', element_at(array('URGENT', 'HIGH', 'MEDIUM', 'NOT SPECIFIED', 'LOW'), cast(l_orderkey % 5 + 1 as int))), '5-LOW')")
    rows = t.lineitem.select("l_orderkey", told.alias("priority"))
    return relational.null_safe_anti_join(rows, open_, ["l_orderkey"], ["priority"]).groupBy("l_orderkey").agg(F.count("*").alias("orphan_lines"))


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ' | ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey""")
def distinct_concat(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(relational.distinct_concat("o_orderpriority").alias("priorities"))


@query("""SELECT p_partkey, (row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1)::INT AS round FROM part""")
def interleave_groups(t: Tables) -> DataFrame:
    return relational.interleaved(t.part.select("p_partkey", "p_type"), "p_type", [F.col("p_partkey")]).select("p_partkey", "round")


@query("""SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) % 4 AS shard FROM part""")
def shard_round_robin(t: Tables) -> DataFrame:
    return relational.sharded(t.part.select("p_partkey"), [F.col("p_partkey")], 4)


@query("""SELECT coalesce(CASE WHEN grouping(c_mktsegment) = 1 THEN 'TOTAL' END, c_mktsegment) AS c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean_balance
    FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def rollup_total(t: Tables) -> DataFrame:
    return grouping.with_total(t.customer, "c_mktsegment", [F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean_balance")])


@query("""SELECT p_brand, p_type, level::BIGINT AS level, n, n / sum(n) OVER (PARTITION BY level) AS share FROM (
    SELECT p_brand, p_type, grouping_id(p_brand, p_type) AS level, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), (p_brand, p_type)))""")
def grouping_sets_share(t: Tables) -> DataFrame:
    return grouping.share_tables(t.part.select("p_brand", "p_type"), "p_brand", "p_type")


@query("""SELECT c AS quality, count(*) FILTER (l.toxic = 0) AS predicted_0, count(*) FILTER (l.toxic = 1) AS predicted_1, count(*) FILTER (l.toxic = 2) AS predicted_2
    FROM (VALUES (0), (1), (2)) v(c) LEFT JOIN labels l ON l.quality = c GROUP BY c""")
def pivot_confusion(t: Tables) -> DataFrame:
    return grouping.confusion(t.labels, "quality", "toxic", [0, 1, 2])


@query("""WITH e AS (SELECT min(n_chars) AS low, greatest(1, ceil((max(n_chars) - min(n_chars) + 1) / 20.0))::BIGINT AS width FROM documents),
    c AS (SELECT least(floor((n_chars - low) / width), 19)::INT AS bin, count(*) AS n FROM documents, e GROUP BY 1)
    SELECT b::INT AS bin, (low + b * width)::BIGINT AS "from", coalesce(n, 0) AS n FROM range(20) r(b) CROSS JOIN e LEFT JOIN c ON c.bin = b""")
def histogram(t: Tables) -> DataFrame:
    return grouping.histogram(t.documents.select("n_chars"), "n_chars", 20)


@query("""SELECT l_returnflag, count(*) AS n, round(avg(x), 6) AS mean, median(x) AS median, quantile_cont(x, 0.9) AS p90, max(x) AS max
    FROM (SELECT l_returnflag, nullif(l_extendedprice, 0) AS x FROM lineitem) WHERE x IS NOT NULL GROUP BY 1""")
def describe_p90(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", F.nullif("l_extendedprice", F.lit(0)).alias("x"))
    return grouping.described(rows, "x", "l_returnflag").withColumn("mean", F.round("mean", 6))


@query("""WITH s AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents GROUP BY lang)
    SELECT lang, v[1 + round_even((len(v) - 1) * 0.95, 0)::INT] AS half_even, v[1 + floor((len(v) - 1) * 0.95 + 0.5)::INT] AS half_up,
           v[1 + least(len(v) - 1, floor(len(v) * 0.95))::INT] AS floor_index, v[1 + floor(len(v) / 2)::INT] AS upper_median FROM s""")
def percentile_rules(t: Tables) -> DataFrame:
    """The index rules of nearest-rank percentiles, which differ."""
    return grouping.ranked(t.documents, "lang", "n_chars", {"half_even": (0.95, "half_even"), "half_up": (0.95, "half_up"), "floor_index": (0.95, "floor"), "upper_median": (0.5, "upper")})


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1")
def monthly_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("""SELECT n_name, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT 10""")
def top10_nation(t: Tables) -> DataFrame:
    by_customer = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("amount"))
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    out = by_customer.join(named, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("amount").alias("amount"))
    return out.orderBy(F.desc("amount"), "n_name").limit(10).select("n_name", F.round("amount", 2).alias("amount"))


@query("SELECT nullif(event_type, 'click') AS event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return grouping.value_counts(t.events.select(F.expr("nullif(event_type, 'click')").alias("event_type")), "event_type")


@query("""SELECT count(*) AS orders, sum(o_totalprice) AS amount, count(DISTINCT o_custkey) AS customers, avg((o_orderstatus = 'F')::INT) AS finished FROM orders""")
def kpis(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("amount"), F.count_distinct("o_custkey").alias("customers"), F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("finished"))


@query("""SELECT event_type, CASE WHEN count(v) = count(*) THEN sum(v) END AS strict_sum, coalesce(sum(v), 0) AS lenient_sum
    FROM (SELECT event_type, CASE WHEN event_type = 'view' AND event_id % 97 = 0 THEN NULL ELSE event_id END AS v FROM events) GROUP BY 1""")
def null_policies(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", F.when(~((F.col("event_type") == "view") & (F.col("event_id") % 97 == 0)), F.col("event_id")).alias("v"))
    return rows.groupBy("event_type").agg(grouping.null_absorbing_sum("v").alias("strict_sum"), F.coalesce(F.sum("v"), F.lit(0)).alias("lenient_sum"))


@query("""SELECT o_orderkey, name AS measure, value FROM (SELECT o_orderkey, o_totalprice AS total, o_custkey::DOUBLE AS customer FROM orders) UNPIVOT (value FOR name IN (total, customer))""")
def wide_to_long(t: Tables) -> DataFrame:
    return relational.unpivoted(t.orders.select("o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_custkey").cast("double").alias("customer")), ["o_orderkey"], ["total", "customer"])


@query("""SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def except_keys(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("""SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def intersect_keys(t: Tables) -> DataFrame:
    keys = t.orders.select(F.col("o_custkey").alias("id"), "o_orderstatus")
    return keys.where("o_orderstatus = 'F'").select("id").intersect(keys.where("o_orderstatus = 'O'").select("id"))


@query("""SELECT 'first' AS half, count(*) AS n FROM (SELECT * FROM orders WHERE month(o_orderdate) <= 6 UNION ALL SELECT * FROM orders WHERE false)
    UNION ALL SELECT 'second', count(*) FROM orders WHERE month(o_orderdate) > 6""")
def tagged_union(t: Tables) -> DataFrame:
    halves = [t.orders.where(c).select(F.lit(n).alias("half")) for n, c in (("first", "month(o_orderdate) <= 6"), ("second", "month(o_orderdate) > 6"))]
    return halves[0].unionByName(halves[1]).groupBy("half").agg(F.count("*").alias("n"))


RULES = [
    quality.Rule("R1", "flag_no_lines", "n_lines = 0", "processes"),
    quality.Rule("R2", "flag_high_price", "o_totalprice > 300000", "processes"),
    quality.Rule("R3", "flag_revenue_mismatch", "abs(revenue - o_totalprice) > 0.5 * o_totalprice", "processes"),
    quality.Rule("R4", "flag_single_supplier", "n_suppliers = 1", "processes"),
    quality.Rule("R5", "flag_early_ship", "first_ship < timestamp '1993-01-01'", "processes"),
]
FLAGS = f"SELECT *, n_lines = 0 AS r1, o_totalprice > 300000 AS r2, coalesce(abs(revenue - o_totalprice) > 0.5 * o_totalprice, false) AS r3, n_suppliers = 1 AS r4, coalesce(first_ship < TIMESTAMP '1993-01-01', false) AS r5 FROM ({PROCESSES})"


@query(f"""WITH f AS ({FLAGS}), u AS (
        SELECT o_orderkey, unnest(['R1', 'R2', 'R3', 'R4', 'R5']) AS rule, unnest([r1, r2, r3, r4, r5]) AS marked FROM f)
    SELECT rule, 'processes' AS unit, count(*) FILTER (marked) AS marked, count(*) AS total, (count(*) FILTER (marked))::DOUBLE / count(*) AS share,
           array_to_string(list_sort(list(o_orderkey) FILTER (marked))[1:3], ', ') AS examples FROM u GROUP BY rule""")
def quality_report(t: Tables) -> DataFrame:
    return quality.report(quality.flagged(processes(t), RULES), RULES, "o_orderkey", 3)


@query(f"SELECT n_flags, count(*) AS n FROM (SELECT r1::INT + r2::INT + r3::INT + r4::INT + r5::INT AS n_flags FROM ({FLAGS})) GROUP BY 1")
def flag_counts(t: Tables) -> DataFrame:
    return quality.flagged(processes(t), RULES).groupBy("n_flags").agg(F.count("*").alias("n"))


@query(r"""SELECT c_custkey, list_filter([
        CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 'name' END,
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END,
        CASE WHEN c_acctbal < 0 THEN 'balance' END], lambda x: x IS NOT NULL) AS errors FROM customer""")
def row_validation(t: Tables) -> DataFrame:
    checks = [("name", ~F.col("c_name").rlike("^Customer#[0-9]{9}$")), ("segment", ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")), ("balance", F.col("c_acctbal") < 0)]
    return t.customer.select("c_custkey", quality.errors(checks).alias("errors"))


@query("""WITH d AS (SELECT n_nationkey AS k, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 <> 0)
    SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(a.r_name, b.r_name) AS region, CASE WHEN a.k IS NOT NULL THEN 'customer' WHEN b.k IS NOT NULL THEN 'supplier' END AS method
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN d a ON a.k = c_nationkey LEFT JOIN d b ON b.k = s_nationkey""")
def lookup_cascade(t: Tables) -> DataFrame:
    """Dimension lookup by several fields in order of priority, with the method that hit."""
    nation = t.nation.where("n_nationkey % 3 <> 0").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyers = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("buyer"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(buyers, "l_orderkey").join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    names = [("buyer", "customer"), ("s_nationkey", "supplier")]
    return quality.looked_up(rows, nation, "n_nationkey", "r_name", names, "region", "method").select("l_orderkey", "l_linenumber", "l_suppkey", "region", "method")


@query("""SELECT o_orderkey, l_linenumber, cn.n_name AS customer_nation, sn.n_name AS supplier_nation FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey
    JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey WHERE cn.n_regionkey <> sn.n_regionkey""")
def region_mismatch(t: Tables) -> DataFrame:
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "n_regionkey")
    other = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supplier_nation"), F.col("n_regionkey").alias("other_region"))
    both = t.orders.select("o_orderkey", "o_custkey").join(named, F.col("o_custkey") == F.col("c_custkey"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(other, F.col("l_suppkey") == F.col("s_suppkey"))
    met = both.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).where(F.col("n_regionkey") != F.col("other_region"))
    return met.select("o_orderkey", "l_linenumber", F.col("n_name").alias("customer_nation"), "supplier_nation")


@query("""SELECT p_partkey, CASE WHEN floor(p_size) <= 2 THEN '0-2' WHEN floor(p_size) <= 5 THEN '3-5' WHEN floor(p_size) <= 10 THEN '6-10' ELSE '11+' END AS band, least(greatest(p_size, 0), 20)::INT AS clipped FROM part""")
def banding(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", quality.band(F.col("p_size")).alias("band"), F.least(F.greatest("p_size", F.lit(0)), F.lit(20)).alias("clipped"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, o_totalprice, o_orderkey FROM orders)
    SELECT a.o_custkey, a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
    WHERE (a.o_orderpriority = b.o_orderpriority) <> (floor(a.o_totalprice / 100000) = floor(b.o_totalprice / 100000))""")
def differing_in_one(t: Tables) -> DataFrame:
    """Pairs of a key's rows that differ in exactly one of two axes; the key, a customer with some
    dozen orders, is the block that bounds them."""
    c = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", F.floor(F.col("o_totalprice") / 100000).alias("level"))
    a, b = c.alias("a"), c.alias("b")
    one = (F.col("a.o_orderpriority") == F.col("b.o_orderpriority")) != (F.col("a.level") == F.col("b.level"))
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & one).select(F.col("a.o_custkey"), F.col("a.o_orderkey").alias("a_key"), F.col("b.o_orderkey").alias("b_key"))


@query("""SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) = 1""")
def winner_per_group(t: Tables) -> DataFrame:
    n = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.groupBy("event_type").agg(F.min_by("user_id", F.struct(-F.col("n"), "user_id")).alias("user_id"), F.max("n").alias("n"))


@query("""SELECT l_orderkey, l_shipmonth, n, n - lag(n) OVER (PARTITION BY l_orderkey ORDER BY l_shipmonth) AS change FROM (
    SELECT l_orderkey, strftime(l_shipdate, '%Y-%m') AS l_shipmonth, count(*) AS n FROM lineitem GROUP BY ALL)""")
def change_by_month(t: Tables) -> DataFrame:
    n = t.lineitem.groupBy("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("l_shipmonth")).agg(F.count("*").alias("n"))
    return n.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("l_orderkey").orderBy("l_shipmonth")))
