"""Queries of evaluation, resampling, intervals and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import evaluation, grouping, logs, quantiles, relational, resampling
from ..scratch import new_dir
from ..streaming import events as streams
from .registry import Tables, query

POINTS = "SELECT vec_id % 5 <> 0 AS inside, (vec_id * 7919 % 1000) / 1000.0::DOUBLE AS similarity, label % 2 = 0 AS hit FROM embeddings"


def sweep(points: str) -> str:
    """SQL of the threshold table of some points."""
    return f"""p AS ({points}), g AS (SELECT t::INT AS t FROM range(700, 951) r(t)),
    s AS (SELECT t, count(*) FILTER (a AND inside AND hit) AS correct, count(*) FILTER (a AND inside AND NOT hit) AS wrong, count(*) FILTER (NOT a AND inside) AS abstained, count(*) FILTER (a AND NOT inside) AS undue
          FROM (SELECT *, floor(similarity * 1000 + 1e-9) >= t AS a FROM p CROSS JOIN g) GROUP BY t),
    q AS (SELECT *, correct::DOUBLE / nullif(correct + wrong + undue, 0) AS precision, correct::DOUBLE / nullif(correct + wrong + abstained, 0) AS coverage FROM s),
    f AS (SELECT *, coalesce(1.25 * precision * coverage / nullif(0.25 * precision + coverage, 0), 0) AS f FROM q)"""


SWEEP = sweep(POINTS)
#: Questions of the domain are mostly nearer than the others, so that the best threshold lies between.
APART = "SELECT vec_id % 5 <> 0 AS inside, (CASE WHEN vec_id % 5 <> 0 THEN 790 + vec_id * 7919 % 150 ELSE 720 + vec_id * 7919 % 120 END) / 1000.0::DOUBLE AS similarity, label % 5 <> 0 AS hit FROM embeddings"


def points_apart(t: Tables) -> DataFrame:
    i, inside = F.col("vec_id"), F.col("vec_id") % 5 != 0
    near = F.when(inside, 790 + i * 7919 % 150).otherwise(720 + i * 7919 % 120)
    return t.embeddings.select(inside.alias("inside"), (near / 1000.0).alias("similarity"), (F.col("label") % 5 != 0).alias("hit"))


def points(t: Tables) -> DataFrame:
    return t.embeddings.select((F.col("vec_id") % 5 != 0).alias("inside"), (F.col("vec_id") * 7919 % 1000 / 1000.0).alias("similarity"), (F.col("label") % 2 == 0).alias("hit"))


@query(f"WITH {SWEEP} SELECT t, correct, wrong, abstained, undue, precision, coverage, f FROM f")
def threshold_sweep(t: Tables) -> DataFrame:
    return evaluation.threshold_table(points(t), 700, 950)


@query(f"WITH {SWEEP}, m AS (SELECT list_sort(list(t)) AS ts, max(f) AS f FROM f WHERE round(f, 12) = (SELECT max(round(f, 12)) FROM f)) SELECT ts[1 + floor(len(ts) / 2)::INT] AS t, round(f, 9) AS f FROM m")
def threshold_plateau(t: Tables) -> DataFrame:
    table = evaluation.threshold_table(points(t), 700, 950).withColumn("f", F.round("f", 12))
    return evaluation.plateau_centre(table).withColumn("f", F.round("f", 9))


PRICES = "SELECT p_brand, l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON p_partkey = l_partkey"


def prices(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_partkey", "l_extendedprice", "l_quantity")
    return lines.join(t.part.select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * F.col("p_retailprice")).alias("p"))


@query(f"""SELECT count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(1 - sum((p - y) ** 2) / (var_pop(y) * count(y)), 8) AS r2, round(avg(p - y), 4) AS bias,
    avg((abs(p - y) <= 1000)::INT) AS within_1000, avg((abs(p - y) <= 10000)::INT) AS within_10000,
    avg(((p >= 20000)::INT + (p >= 50000)::INT = (y >= 20000)::INT + (y >= 50000)::INT)::INT) AS same_band FROM ({PRICES})""")
def regression_metrics(t: Tables) -> DataFrame:
    out = evaluation.regression_figures(prices(t), "y", "p", [1000, 10000], [20000, 50000])
    return out.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "bias": F.round("bias", 4), "r2": F.round("r2", 8)})


@query(f"SELECT p_brand, round(avg(abs(p - y)), 4) AS mae, count(*) AS n FROM ({PRICES}) GROUP BY p_brand")
def mae_by_group(t: Tables) -> DataFrame:
    return prices(t).groupBy("p_brand").agg(F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 4).alias("mae"), F.count("*").alias("n"))


CLASSES = "SELECT p_size % 4 AS r, CASE WHEN p_size % 7 = 0 THEN 9 ELSE (p_size + p_partkey // 10) % 4 END AS p FROM part"
F1 = f"""c AS ({CLASSES}), k AS (SELECT r AS label FROM c UNION SELECT p FROM c),
    s AS (SELECT label, (SELECT count(*) FROM c WHERE r = label AND p = label) AS tp, (SELECT count(*) FROM c WHERE r = label) AS support, (SELECT count(*) FROM c WHERE p = label) AS given FROM k)"""


def classes(t: Tables) -> DataFrame:
    return t.part.select((F.col("p_size") % 4).cast("long").alias("r"), F.when(F.col("p_size") % 7 == 0, F.lit(9).cast("long")).otherwise((F.col("p_size") + F.floor(F.col("p_partkey") / 10)) % 4).alias("p"))


@query(f"WITH {F1} SELECT round(avg(2.0 * tp / (support + given)), 9) AS macro_f1, count(*) AS labels FROM s")
def macro_f1_all(t: Tables) -> DataFrame:
    return evaluation.macro_f1(classes(t), "r", "p", False).withColumn("macro_f1", F.round("macro_f1", 9))


@query(f"WITH {F1} SELECT round(avg(2.0 * tp / (support + given)), 9) AS macro_f1, count(*) AS labels FROM s WHERE support > 0")
def macro_f1_supported(t: Tables) -> DataFrame:
    return evaluation.macro_f1(classes(t), "r", "p", True).withColumn("macro_f1", F.round("macro_f1", 9))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(corr(l_extendedprice, l_quantity), 9) AS corr FROM lineitem GROUP BY 1")
def slope_corr(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.corr("l_extendedprice", "l_quantity"), 9).alias("corr"))


SPANS = "SELECT o_custkey, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, datediff('day', DATE '1992-01-01', o_orderdate::DATE) + 60 AS e FROM orders"
ISLANDS = f"""x AS ({SPANS}), o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM x),
    i AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o), u AS (SELECT o_custkey, min(s) AS s, max(e) AS e FROM i GROUP BY o_custkey, island)"""


def spans(t: Tables) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return t.orders.select("o_custkey", day.alias("s"), (day + 60).alias("e"))


@query(f"WITH {ISLANDS} SELECT o_custkey, sum(e - s)::BIGINT AS covered, (max(e) - min(s))::INT AS span, count(*) AS islands FROM u GROUP BY 1")
def interval_union(t: Tables) -> DataFrame:
    u = evaluation.interval_union(spans(t), "o_custkey", "s", "e")
    return u.groupBy("o_custkey").agg(F.sum(F.col("e") - F.col("s")).alias("covered"), (F.max("e") - F.min("s")).alias("span"), F.count("*").alias("islands"))


@query(f"WITH {ISLANDS} SELECT o_custkey, e::INT AS gap_from, (lead(s) OVER w)::INT AS gap_to FROM u WINDOW w AS (PARTITION BY o_custkey ORDER BY s) QUALIFY gap_to IS NOT NULL")
def interval_gaps(t: Tables) -> DataFrame:
    u = evaluation.interval_union(spans(t), "o_custkey", "s", "e")
    return u.select("o_custkey", F.col("e").alias("gap_from"), F.lead("s").over(Window.partitionBy("o_custkey").orderBy("s")).alias("gap_to")).where("gap_to is not null")


@query("SELECT l_orderkey, min(n)::INT AS first, max(n)::INT AS last FROM (SELECT l_orderkey, n, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS i FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem)) GROUP BY l_orderkey, i")
def consecutive_runs(t: Tables) -> DataFrame:
    return evaluation.consecutive_runs(t.lineitem, "l_orderkey", "l_linenumber")


DRAW = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
BOOT = f"""i AS (SELECT n_nationkey::BIGINT AS item, sum(c_acctbal) AS num, count(*) AS den FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
    d AS (SELECT r AS replicate, {DRAW.format("r || '|' || k || '|s1'")} % 25 AS item FROM range(200) a(r) CROSS JOIN range(25) b(k)),
    b AS (SELECT replicate, sum(num) / sum(den) AS ratio FROM d JOIN i USING (item) GROUP BY 1)"""


def items(t: Tables) -> DataFrame:
    return t.customer.groupBy(F.col("c_nationkey").cast("long").alias("item")).agg(F.sum("c_acctbal").alias("num"), F.count("*").alias("den"))


@query(f"WITH {BOOT} SELECT round(quantile_cont(ratio, 0.025), 6) AS low, round(quantile_cont(ratio, 0.975), 6) AS high, avg((ratio > 0)::INT) AS share_above_0 FROM b")
def bootstrap_ci(t: Tables) -> DataFrame:
    b = resampling.bootstrap(items(t), 200, {"ratio": F.sum("num") / F.sum("den")}, "s1")
    return resampling.interval(b, "ratio").withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


PAIRED = "SELECT item, b - a AS delta FROM (SELECT c_nationkey::BIGINT AS item, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS a, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS b FROM customer GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL"


@query(f"""WITH i AS ({PAIRED}), d AS (SELECT r AS replicate, {DRAW.format("r || '|' || k || '|s2'")} % (SELECT count(*) FROM i) AS place FROM range(200) a(r) CROSS JOIN (SELECT row_number() OVER () - 1 AS k FROM i) b),
    n AS (SELECT row_number() OVER (ORDER BY item) - 1 AS place, delta FROM i), b AS (SELECT replicate, avg(delta) AS m FROM d JOIN n USING (place) GROUP BY 1)
    SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, avg((m > 0)::INT) AS share_above_0 FROM b""")
def paired_bootstrap(t: Tables) -> DataFrame:
    """Interval of the mean difference between two segments over the nations that have both."""
    pairs = resampling.paired(t.customer, "c_mktsegment", "BUILDING", "MACHINERY", ["c_nationkey"], "c_acctbal")
    deltas = pairs.select((F.row_number().over(Window.orderBy("c_nationkey")) - 1).cast("long").alias("item"), "delta")  # a row for each nation
    return resampling.interval(resampling.bootstrap(deltas, 200, {"m": F.avg("delta")}, "s2"), "m").withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(f"""WITH k AS (SELECT c_custkey, {DRAW.format("c_custkey || '|7'")} AS key, c_mktsegment || (c_nationkey % 9) AS s FROM customer),
    f AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s) < 30 THEN 'rare' ELSE s END AS stratum FROM k),
    r AS (SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY key, c_custkey) - 1)::DOUBLE / count(*) OVER (PARTITION BY stratum) AS part FROM f)
    SELECT c_custkey, stratum, CASE WHEN part < 0.7 THEN 'train' WHEN part < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM r""")
def stratified_split(t: Tables) -> DataFrame:
    return resampling.stratified_split(t.customer, "c_custkey", F.concat("c_mktsegment", (F.col("c_nationkey") % 9).cast("string")), "7", (0.7, 0.15), 30)


@query(f"""SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY {DRAW.format("p_partkey || '|11'")}, p_partkey) <= 5""")
def stratified_sample(t: Tables) -> DataFrame:
    return resampling.sample_per_group(t.part.select("p_type", "p_partkey"), "p_type", "p_partkey", 5, "11")


WINDOWS = [("click", 0, 480, 0.5, 1.0), ("click", 480, 0, 0.8, 1.6), ("view", 1320, 360, 0.2, 0.4), ("view", 360, 1320, 0.3, 0.9), ("purchase", 0, 0, 1.0, 2.0)]
WINDOW_SQL = "(VALUES " + ", ".join(f"('{m}', {a}, {b}, {x}, {y})" for m, a, b, x, y in WINDOWS) + ") w(model, s, e, pin, pout)"


@query(f"""SELECT event_type AS model, count(*) AS calls, count(pin) AS priced, round(sum(event_id % 1000 * pin + event_id % 300 * pout) / 1e6, 9) AS cost
    FROM (SELECT *, hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts) AS m FROM events) LEFT JOIN {WINDOW_SQL} ON event_type = model AND ((s < e AND m >= s AND m < e) OR (s >= e AND (m >= s OR m < e))) GROUP BY 1""")
def price_window_cost(t: Tables) -> DataFrame:
    """Cost by the price window of a call's minute in the price list's zone (no daylight saving)."""
    windows = t.spark.createDataFrame(WINDOWS, "model string, start int, end int, pin double, pout double")
    calls = t.events.select(F.col("event_type").alias("model"), "event_id", logs.minute_of_day(F.col("ts"), "America/Lima").alias("minute"))
    cost = logs.call_cost(F.col("event_id") % 1000, F.col("event_id") % 300, F.col("pin"), F.col("pout"))
    return logs.priced(calls, windows).groupBy("model").agg(F.count("*").alias("calls"), F.count("pin").alias("priced"), F.round(F.sum(cost), 9).alias("cost"))


@query("SELECT user_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS day, count(*) AS used, greatest(count(*) - 3, 0) AS over_quota FROM events GROUP BY ALL")
def daily_quota(t: Tables) -> DataFrame:
    day = F.date_format(F.from_utc_timestamp("ts", "America/Lima"), "yyyy-MM-dd")
    return t.events.groupBy("user_id", day.alias("day")).agg(F.count("*").alias("used")).withColumn("over_quota", F.greatest(F.col("used") - 3, F.lit(0)).cast("long"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS trailing FROM events")
def trailing_60s_rate(t: Tables) -> DataFrame:
    return logs.trailing_count(t.events.select("event_id", "event_type", "ts"), "event_type", "ts", 60).select("event_id", "trailing")


@query("""SELECT user_id, bucket, vote FROM (SELECT user_id, event_id % 20 AS bucket, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS vote, ts, event_id FROM events) WHERE vote <> 0
    QUALIFY row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts DESC, event_id DESC) = 1""")
def vote_upsert(t: Tables) -> DataFrame:
    votes = t.events.select("user_id", (F.col("event_id") % 20).alias("bucket"), F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0).alias("vote"), "ts", "event_id")
    return logs.last_vote(votes, ["user_id", "bucket"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "bucket", "vote")


@query("""SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 10 = 0) AS failed, median(value) AS median_value, list_sort(list(value))[1 + floor((count(*) - 1) * 0.9 + 0.5)::INT] AS p90 FROM events GROUP BY 1""")
def cost_by_model(t: Tables) -> DataFrame:
    out = t.events.groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(F.col("event_id") % 10 == 0).alias("failed"))
    out = quantiles.with_quantiles(out, t.events, ["event_type"], "value", {"median_value": 0.5})
    return out.join(grouping.ranked(t.events, "event_type", "value", {"p90": (0.9, "half_up")}), "event_type")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_20(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def props_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""WITH h AS (SELECT p_partkey AS hit_id, unnest([p_size, p_size % 7]) AS article, unnest([0, 1]) AS place FROM part WHERE p_size % 7 = 1),
    a AS (SELECT p_partkey AS amendment_id, unnest([p_size % 11, p_size]) AS article, p_partkey % 13 AS rank FROM part WHERE p_size % 5 = 0 OR p_size % 7 = 1),
    t AS (SELECT hit_id, place, amendment_id, row_number() OVER (PARTITION BY hit_id, h.article, place ORDER BY rank, amendment_id) AS turn FROM h JOIN (SELECT DISTINCT * FROM a) a ON a.article = h.article WHERE amendment_id NOT IN (SELECT hit_id FROM h)),
    o AS (SELECT hit_id, amendment_id, min(struct_pack(turn := turn, place := place)) AS f FROM t WHERE turn <= 3 GROUP BY ALL)
    SELECT hit_id, (row_number() OVER (PARTITION BY hit_id ORDER BY f.turn, f.place, amendment_id))::INT AS position, amendment_id FROM o QUALIFY position <= 4""")
def version_augment(t: Tables) -> DataFrame:
    hits = t.part.where("p_size % 7 = 1").select(F.col("p_partkey").alias("hit_id"), F.array_distinct(F.array("p_size", F.col("p_size") % 7)).alias("articles"))
    offers = t.part.where("p_size % 5 = 0 or p_size % 7 = 1").select(F.col("p_partkey").alias("amendment_id"), F.array_distinct(F.array(F.col("p_size") % 11, F.col("p_size"))).alias("articles"), (F.col("p_partkey") % 13).alias("rank"))
    return logs.versions_for(hits, offers, 3, 4)


@query("""SELECT c.c_custkey, o.n IS NULL AS missing, coalesce(abs(c.c_acctbal - o.n) > 5000, false) AS mismatch FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) / 50 AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o_custkey = c_custkey""")
def mismatch_audit(t: Tables) -> DataFrame:
    other = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_totalprice") / 50).alias("n"))
    return relational.matched_by_key(t.customer.select("c_custkey", "c_acctbal"), other, ["c_custkey"], 5000, "c_acctbal", "n").select("c_custkey", "missing", "mismatch")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN (max(l_partkey) % 100)::DOUBLE END AS y FROM lineitem GROUP BY 1, 2),
    w AS (SELECT l_orderkey, l_linenumber AS x, last_value(CASE WHEN y IS NOT NULL THEN l_linenumber END IGNORE NULLS) OVER b AS x0, last_value(y IGNORE NULLS) OVER b AS y0,
        first_value(CASE WHEN y IS NOT NULL THEN l_linenumber END IGNORE NULLS) OVER a AS x1, first_value(y IGNORE NULLS) OVER a AS y1 FROM r
        WINDOW b AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT l_orderkey, x AS l_linenumber, round(CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 9) AS value FROM w""")
def interpolated_lookup(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    rows = rows.withColumn("y", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, (F.col("p") % 100).cast("double")))
    return evaluation.interpolated(rows, "l_orderkey", "l_linenumber", "y", "value").select("l_orderkey", "l_linenumber", F.round("value", 9).alias("value"))


@query("SELECT user_id, count(*) FILTER (b <> event_type) AS switches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY 1")
def side_switches(t: Tables) -> DataFrame:
    return evaluation.side_switches(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS r FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS f FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL),
    h AS (SELECT k, sum(least(r, coalesce(f, 0))) AS hits, sum(r) AS total FROM a LEFT JOIN b USING (k, y) GROUP BY k)
    SELECT sum(hits)::DOUBLE / sum(total)::DOUBLE AS micro, round(avg(hits::DOUBLE / total::DOUBLE), 9) AS macro FROM h""")
def multiset_accuracy(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), "o_orderkey")
    return evaluation.multiset_accuracy(rows, rows.where("o_orderkey % 4 <> 0"), "k", "y").withColumn("macro", F.round("macro", 9))


#: An hour lets three requests of a kind go.
LIMITED = """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS came, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    r AS (
        SELECT event_type, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS waited, []::BIGINT[] AS ring FROM (SELECT DISTINCT event_type FROM e)
        UNION ALL
        SELECT event_type, i, event_id, leaves - came, list_append(CASE WHEN len(ring) = 3 THEN ring[2:] ELSE ring END, leaves)
        FROM (SELECT r.event_type, e.i, e.event_id, e.came, r.ring, CASE WHEN len(r.ring) = 3 THEN greatest(e.came, r.ring[1] + 3600000000) ELSE e.came END AS leaves
              FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1))
    SELECT event_type, event_id, waited FROM r WHERE i > 0"""


@query(LIMITED)
def limiter_waits(t: Tables) -> DataFrame:
    """How long a limiter of three an hour keeps each event of a kind, in microseconds."""
    return logs.paced(t.events, "event_type", "ts", "event_id", 3, 3600).select("event_type", "event_id", "waited")


@query(LIMITED)
def streamed_limiter(t: Tables) -> DataFrame:
    """The same limiter as a stream that keeps a ring of departures for each kind."""
    stream = streams.read(t.spark, f"{t.path}/events.parquet*", t.events)
    return streams.append(streams.limited(stream, "event_type", "event_id", 3, 3600), new_dir(t.spark, "limited")).select("event_type", "event_id", "waited")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, count(*) > 0 AS kept FROM events GROUP BY 1")
def streamed_upsert(t: Tables) -> DataFrame:
    """The last event of every user, merged by a stream into buckets."""
    path = new_dir(t.spark, "upserted")
    rows = lambda df: df.select("user_id", "event_id", "event_type", F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"))
    streams.upsert(rows(streams.read(t.spark, f"{t.path}/events.parquet*", t.events)), path, "user_id", "at")
    return streams.current(t.spark, path, rows(t.events)).select("user_id", "event_id", F.lit(True).alias("kept"))
