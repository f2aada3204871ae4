"""Queries of benchmark roll-ups, outcomes and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators import benchmarks, evaluation, quantiles, relational, resampling
from .registry import Tables, query


@query("SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS errors, sum(l_quantity) AS total, count(*) AS items, sum(l_linenumber) / sum(l_quantity) AS rate FROM lineitem GROUP BY ALL")
def corpus_error_rate(t: Tables) -> DataFrame:
    return benchmarks.corpus_rate(t.lineitem, ["l_returnflag", "l_linestatus"], "l_linenumber", "l_quantity")


PAIRS = """p AS (SELECT l_linestatus AS model, l_suppkey, avg(l_discount) FILTER (l_returnflag = 'A') AS a, avg(l_discount) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY ALL),
    d AS (SELECT model, l_suppkey, b - a AS delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(f"WITH {PAIRS} SELECT model, l_suppkey, round(delta, 9) AS delta FROM d")
def paired_on_off(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumnRenamed("l_linestatus", "model")
    return resampling.paired(rows, "l_returnflag", "A", "R", ["model", "l_suppkey"], "l_discount").select("model", "l_suppkey", F.round("delta", 9).alias("delta"))


@query(f"""WITH {PAIRS} SELECT model, count(*) AS pairs, count(*) FILTER (delta < -0.001) AS improved, count(*) FILTER (delta > 0.001) AS worsened, count(*) FILTER (abs(delta) <= 0.001) AS equal, round(avg(delta), 9) AS mean,
    abs(avg(delta)) > 1.96 * stddev_samp(delta) / sqrt(count(*)) AS excludes_0 FROM d GROUP BY 1""")
def paired_effect(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumnRenamed("l_linestatus", "model")
    pairs = resampling.paired(rows, "l_returnflag", "A", "R", ["model", "l_suppkey"], "l_discount")
    return benchmarks.effect(pairs, ["model"], tolerance=0.001).withColumn("mean", F.round("mean", 9))


@query("""WITH e AS (SELECT l_linenumber AS level, l_suppkey, avg(l_quantity) AS q FROM lineitem GROUP BY ALL), d AS (SELECT a.level, a.q - b.q AS delta FROM e a JOIN e b ON b.l_suppkey = a.l_suppkey AND b.level = 1)
    SELECT level, count(*) AS pairs, count(*) FILTER (delta < 0) AS improved, count(*) FILTER (delta > 0) AS worsened, round(avg(delta), 6) AS mean FROM d GROUP BY level""")
def degradation_curve(t: Tables) -> DataFrame:
    deltas = benchmarks.against_baseline(t.lineitem.withColumnRenamed("l_linenumber", "level"), "level", 1, ["l_suppkey"], "l_quantity")
    return benchmarks.effect(deltas, ["level"]).select("level", "pairs", "improved", "worsened", F.round("mean", 6).alias("mean"))


@query("""SELECT quality, count(*) FILTER (k = 0 AND toxic = 0) AS "0_right", count(*) FILTER (k = 0) AS "0_n", count(*) FILTER (k = 1 AND toxic = 0) AS "1_right", count(*) FILTER (k = 1) AS "1_n"
    FROM (SELECT *, doc_id % 2 AS k FROM labels) GROUP BY quality""")
def pivot_accuracy(t: Tables) -> DataFrame:
    return benchmarks.pivoted(t.labels.withColumn("k", F.col("doc_id") % 2), ["quality"], "k", [0, 1], F.col("toxic") == 0)


@query("""SELECT event_type, count(*) FILTER (trap) AS traps, count(*) FILTER (trap AND flagged) AS caught, count(*) FILTER (trap AND NOT flagged) AS missed, count(*) FILTER (trap AND flagged AND who = 'speaker') AS caught_rightly,
    count(*) FILTER (trap AND flagged AND who = 'recogniser') AS caught_wrongly, count(*) FILTER (NOT trap) AS clean, count(*) FILTER (NOT trap AND flagged) AS false_alarms, count(*) FILTER (NOT trap AND NOT flagged) AS passed, count(*) FILTER (flagged AND who IS NULL) AS undiagnosed
    FROM (SELECT event_type, event_id % 3 = 0 AS trap, value > 50 AS flagged, CASE user_id % 3 WHEN 0 THEN 'speaker' WHEN 1 THEN 'recogniser' END AS who FROM events) GROUP BY 1""")
def trap_detection(t: Tables) -> DataFrame:
    who = F.when(F.col("user_id") % 3 == 0, "speaker").when(F.col("user_id") % 3 == 1, "recogniser")
    return benchmarks.detections(t.events, ["event_type"], F.col("event_id") % 3 == 0, F.col("value") > 50, who)


FIELDS = """SELECT unnest(['segment', 'balance']) AS field, unnest([c_mktsegment, NULL]) AS s, unnest([NULL, nullif(c_acctbal, 0)]) AS b, unnest([c_mktsegment = 'BUILDING', abs(c_acctbal - 4500) <= 1000]) AS r, unnest([NULL, abs(c_acctbal - 4500)]) AS e FROM customer"""


@query(f"SELECT field, count(*) AS n, count(*) FILTER (r) AS right, count(*) FILTER (s IS NULL AND b IS NULL) AS without, avg(coalesce(r, false)::INT) AS accuracy, 2.0 * count(*) FILTER (r) / (2 * count(*) - count(*) FILTER (s IS NULL AND b IS NULL)) AS f1, round(avg(e), 6) AS mae FROM ({FIELDS}) GROUP BY field")
def metrics_by_field(t: Tables) -> DataFrame:
    off = F.abs(F.col("c_acctbal") - 4500)
    fields = {"segment": (F.col("c_mktsegment"), F.col("c_mktsegment") == "BUILDING", None), "balance": (F.expr("nullif(c_acctbal, 0)"), off <= 1000, off)}
    return benchmarks.by_field(t.customer, fields).withColumn("mae", F.round("mae", 6))


CASES = "SELECT l_orderkey AS id, avg(l_discount) AS rate, avg((l_returnflag <> 'R')::INT) AS accuracy FROM lineitem GROUP BY 1"


@query(f"""WITH c AS ({CASES}) SELECT 'perfect_in_spite' AS "case", (SELECT id FROM c WHERE accuracy >= 1 ORDER BY round(rate, 9) DESC, id LIMIT 1) AS id
    UNION ALL SELECT 'wrong_in_spite', (SELECT id FROM c WHERE round(rate, 9) <= (SELECT median(round(rate, 9)) FROM c) ORDER BY accuracy, id LIMIT 1)""")
def contrast_cases(t: Tables) -> DataFrame:
    cases = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.avg("l_discount"), 9).alias("rate"), F.avg((F.col("l_returnflag") != "R").cast("int")).alias("accuracy"))
    return benchmarks.contrasts(cases, "id", "rate", "accuracy")


@query("""SELECT event_type, n, row_number() OVER (ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type)::INT AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""")
def given_order(t: Tables) -> DataFrame:
    return benchmarks.in_given_order(t.events.groupBy("event_type").agg(F.count("*").alias("n")), {"event_type": ["purchase", "click"]}, ["event_type"])


@query("SELECT l_returnflag, l_linestatus FROM lineitem GROUP BY ALL ORDER BY sum(l_linenumber) / sum(l_quantity), l_returnflag, l_linestatus LIMIT 1")
def best_configuration(t: Tables) -> DataFrame:
    rates = benchmarks.corpus_rate(t.lineitem, ["l_returnflag", "l_linestatus"], "l_linenumber", "l_quantity")
    return rates.orderBy("rate", "l_returnflag", "l_linestatus").limit(1).select("l_returnflag", "l_linestatus")


LOSSES = "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS step, round(value, 2) AS loss FROM events"


@query(f"""WITH l AS ({LOSSES}), b AS (SELECT *, min(loss) OVER (PARTITION BY user_id ORDER BY step) AS best FROM l), a AS (SELECT *, (SELECT min(x.step) FROM l x WHERE x.user_id = b.user_id AND x.loss = b.best) AS best_step FROM b),
    e AS (SELECT user_id, min(step) AS stop FROM a WHERE step - best_step >= 3 GROUP BY 1)
    SELECT a.user_id, arg_max(best_step, step) AS kept, min(loss) AS loss FROM a LEFT JOIN e ON e.user_id = a.user_id WHERE stop IS NULL OR step <= stop GROUP BY 1""")
def early_stopping(t: Tables) -> DataFrame:
    steps = t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("step"), F.round("value", 2).alias("loss"))
    return benchmarks.stopped_early(steps, "user_id", "step", "loss", 3)


OUTCOMES = "SELECT *, CASE WHEN inside AND answered AND hit THEN 'right_answer' WHEN inside AND answered THEN 'wrong_answer' WHEN inside THEN 'undue_abstention' WHEN answered THEN 'undue_answer' ELSE 'right_abstention' END AS outcome FROM (SELECT event_type, event_id % 4 <> 0 AS inside, value >= 30 AS answered, user_id % 3 = 0 AS hit, value FROM events)"


def _outcomes(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("event_id") % 4 != 0).alias("inside"), (F.col("value") >= 30).alias("answered"), (F.col("user_id") % 3 == 0).alias("hit"), "value")
    return rows.withColumn("outcome", benchmarks.outcome(F.col("answered"), F.col("inside"), F.col("hit")))


@query(f"SELECT outcome, count(*) AS n FROM ({OUTCOMES}) GROUP BY 1")
def outcome_classes(t: Tables) -> DataFrame:
    return _outcomes(t).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) FILTER (inside AND answered) AS answered_inside, count(*) FILTER (inside AND NOT answered) AS abstained_inside, count(*) FILTER (NOT inside AND answered) AS answered_outside, count(*) FILTER (NOT inside AND NOT answered) AS abstained_outside,
    avg(answered::INT) FILTER (inside) AS coverage, avg((NOT answered)::INT) FILTER (NOT inside) AS rejection FROM ({OUTCOMES})""")
def abstention_confusion(t: Tables) -> DataFrame:
    i, a = F.col("inside"), F.col("answered")
    return _outcomes(t).agg(
        F.count_if(i & a).alias("answered_inside"), F.count_if(i & ~a).alias("abstained_inside"), F.count_if(~i & a).alias("answered_outside"), F.count_if(~i & ~a).alias("abstained_outside"),
        F.avg(F.when(i, a.cast("int"))).alias("coverage"), F.avg(F.when(~i, (~a).cast("int"))).alias("rejection"))


@query(f"SELECT event_type, count(*) AS calls, count(*) FILTER (outcome = 'right_answer') AS right, round(sum(value), 4) AS cost, round(sum(value) / nullif(count(*) FILTER (answered), 0), 6) AS mean_cost, count(*) FILTER (NOT answered) AS from_cache FROM ({OUTCOMES}) GROUP BY 1")
def end_to_end_summary(t: Tables) -> DataFrame:
    answered = F.count_if("answered")
    return _outcomes(t).groupBy("event_type").agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome") == "right_answer").alias("right"), F.round(F.sum("value"), 4).alias("cost"),
        F.round(F.sum("value") / F.nullif(answered, F.lit(0)), 6).alias("mean_cost"), F.count_if(~F.col("answered")).alias("from_cache"))


@query("""SELECT count(*) FILTER (v = 1) AS up, count(*) FILTER (v = -1) AS down, count(*) FILTER (v = 1)::DOUBLE / nullif(count(*) FILTER (v <> 0), 0) AS share_up FROM (SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS v FROM events)""")
def feedback_summary(t: Tables) -> DataFrame:
    v = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    out = t.events.agg(F.count_if(v == 1).alias("up"), F.count_if(v == -1).alias("down"))
    return out.withColumn("share_up", F.col("up") / F.nullif(F.col("up") + F.col("down"), F.lit(0)))


@query("SELECT p_brand, p_size, count(*) AS pages, round(avg(p_retailprice), 6) AS mean FROM part WHERE p_type NOT LIKE '%TIN%' GROUP BY ALL")
def variant_means(t: Tables) -> DataFrame:
    return t.part.where(~F.col("p_type").like("%TIN%")).groupBy("p_brand", "p_size").agg(F.count("*").alias("pages"), F.round(F.avg("p_retailprice"), 6).alias("mean"))


@query("""SELECT c_mktsegment, count(*) AS n, avg((c_acctbal >= 9000)::INT) AS at_cap, count(DISTINCT c_nationkey) AS nations, max(k) AS most_common FROM customer
    JOIN (SELECT c_mktsegment AS s, max(n) AS k FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1) ON s = c_mktsegment GROUP BY 1""")
def sampling_report(t: Tables) -> DataFrame:
    """Share at or above a cap, and the distribution of exact values, by group."""
    cells = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") >= 9000).alias("capped"))
    return cells.groupBy("c_mktsegment").agg(F.sum("n").alias("n"), (F.sum("capped") / F.sum("n")).alias("at_cap"), F.count("*").alias("nations"), F.max("n").alias("most_common"))


@query("""SELECT t / 100.0::DOUBLE AS threshold, avg((l_discount < t / 100.0)::INT) AS dropped, coalesce(avg((l_returnflag = 'A')::INT) FILTER (l_discount < t / 100.0), 0) AS dropped_but_right, round(avg(l_tax) FILTER (l_discount >= t / 100.0), 9) AS mean_error
    FROM lineitem CROSS JOIN (VALUES (1), (3), (5)) v(t) GROUP BY t""")
def threshold_study(t: Tables) -> DataFrame:
    """What a confidence threshold drops: rows are counted once by confidence, then meet the thresholds."""
    counts = t.lineitem.groupBy("l_discount").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("right"), F.sum("l_tax").alias("error"))
    grid = t.spark.createDataFrame([(1,), (3,), (5,)], "t int").withColumn("threshold", F.col("t") / 100.0)
    low = F.col("l_discount") < F.col("threshold")
    out = grid.join(counts, F.lit(True)).groupBy("threshold").agg(
        (F.sum(F.when(low, F.col("n")).otherwise(0)) / F.sum("n")).alias("dropped"),
        F.coalesce(F.sum(F.when(low, F.col("right"))) / F.sum(F.when(low, F.col("n"))), F.lit(0.0)).alias("dropped_but_right"),
        F.round(F.sum(F.when(~low, F.col("error"))) / F.sum(F.when(~low, F.col("n"))), 9).alias("mean_error"))
    return out


@query("SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, o_custkey % 2 AS half, sum((o_totalprice > 150000)::INT) AS changed, count(*) AS n FROM orders GROUP BY ALL")
def changed_by_four_keys(t: Tables) -> DataFrame:
    keys = ["o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("long").alias("y"), (F.col("o_custkey") % 2).alias("half")]
    return t.orders.groupBy(*keys).agg(F.sum((F.col("o_totalprice") > 150000).cast("int")).alias("changed"), F.count("*").alias("n"))


@query("SELECT l_returnflag, round(avg(l_extendedprice * (1 - l_discount)) - avg(l_extendedprice * (1 + l_tax)), 4) AS total, round(avg(l_extendedprice) - avg(l_extendedprice * (1 + l_tax)), 4) AS first_step, round(avg(l_extendedprice * (1 - l_discount)) - avg(l_extendedprice), 4) AS second_step FROM lineitem GROUP BY 1")
def gap_decomposition(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("c"))
    out = benchmarks.decomposition(rows, ["l_returnflag"], "a", "b", "c")
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("total", "first_step", "second_step")])


@query("SELECT p_size % 4 AS jobs, p_partkey % 3 AS gaps, count(*) AS n, round(avg(abs(p_retailprice - 1200)), 6) AS mean_error FROM part GROUP BY ALL")
def errors_by_two_groups(t: Tables) -> DataFrame:
    return t.part.groupBy((F.col("p_size") % 4).cast("long").alias("jobs"), (F.col("p_partkey") % 3).alias("gaps")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("p_retailprice") - 1200)), 6).alias("mean_error"))


@query("SELECT p_partkey, p_retailprice - 1200 AS error FROM part ORDER BY abs(p_retailprice - 1200) DESC, p_partkey LIMIT 10")
def largest_errors(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (F.col("p_retailprice") - 1200).alias("error")).orderBy(F.desc(F.abs("error")), "p_partkey").limit(10)


@query("SELECT p_partkey, p_retailprice - 1200 AS error FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice BETWEEN 950 AND 1500 AND p_partkey % 100 BETWEEN 10 AND 60 ORDER BY abs(p_retailprice - 1200) DESC, p_partkey")
def range_filter(t: Tables) -> DataFrame:
    keep = F.col("p_size").between(5, 30) & F.col("p_retailprice").between(950, 1500) & (F.col("p_partkey") % 100).between(10, 60)
    return t.part.where(keep).select("p_partkey", (F.col("p_retailprice") - 1200).alias("error")).orderBy(F.desc(F.abs("error")), "p_partkey")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount IS NULL THEN 'unknown' WHEN l_shipdate < DATE '1993-01-01' THEN 'early' WHEN l_quantity > 40 AND l_tax > 0.05 THEN 'large' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'other' END AS cause FROM lineitem""")
def error_cause(t: Tables) -> DataFrame:
    rules = [("unknown", F.col("l_discount").isNull()), ("early", F.col("l_shipdate") < F.lit("1993-01-01").cast("timestamp")), ("large", (F.col("l_quantity") > 40) & (F.col("l_tax") > 0.05)), ("returned", F.col("l_returnflag") == "R")]
    return t.lineitem.select("l_orderkey", "l_linenumber", benchmarks.cause(rules).alias("cause"))


@query("SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'click') > count(*) FILTER (event_type = 'view') AS clicks_win FROM events GROUP BY ALL HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'view') = 0")
def wins_where_other_fails(t: Tables) -> DataFrame:
    clicks, views = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "view")
    days = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day"))
    return days.agg(clicks.alias("c"), views.alias("v")).where("c > 0 and v = 0").select("user_id", "day", (F.col("c") > F.col("v")).alias("clicks_win"))


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) = ['F', 'O'] AS both_only FROM orders GROUP BY 1")
def set_equality(t: Tables) -> DataFrame:
    held = F.array_sort(F.collect_set("o_orderstatus"))
    return t.orders.groupBy("o_custkey").agg((held == F.array(F.lit("F"), F.lit("O"))).alias("both_only"))


@query("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 300000 UNION SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.1")
def bad_keys(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("k")).union(t.lineitem.where("l_discount >= 0.1").select("l_orderkey")).distinct()


@query("SELECT p_name, count(DISTINCT p_brand) AS ids FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def names_with_several_ids(t: Tables) -> DataFrame:
    return t.part.groupBy("p_name").agg(F.count_distinct("p_brand").alias("ids")).where("ids > 1")


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'no_value' WHEN value > 90 THEN 'rate_limit' WHEN value < 10 THEN 'auth' WHEN user_id % 5 = 0 THEN 'timeout' ELSE 'ok' END AS status FROM events")
def provider_status(t: Tables) -> DataFrame:
    rules = [("no_value", F.col("value").isNull()), ("rate_limit", F.col("value") > 90), ("auth", F.col("value") < 10), ("timeout", F.col("user_id") % 5 == 0)]
    return t.events.select("event_id", benchmarks.cause(rules, "ok").alias("status"))


@query("SELECT count(*) AS total, count(*) FILTER (value >= 20) AS ok, count(*) FILTER (value < 20) AS failed FROM (SELECT * FROM events ORDER BY event_id LIMIT 500)")
def run_summary(t: Tables) -> DataFrame:
    """Counts over a run's first 500 rows; the limit is the run's."""
    first = t.events.orderBy("event_id").limit(500)
    return first.agg(F.count("*").alias("total"), F.count_if(F.col("value") >= 20).alias("ok"), F.count_if(F.col("value") < 20).alias("failed"))


@query("""SELECT n_nationkey AS id, coalesce(n, 0) AS processed, n IS NULL AS missing, mean, middle FROM nation
    LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 6) AS mean, median(c_acctbal) AS middle FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) ON k = n_nationkey""")
def progress_report(t: Tables) -> DataFrame:
    """Processed, missing, mean and median of every expected id."""
    rows = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("id"), "c_acctbal")
    done = rows.groupBy("id").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))
    done = quantiles.with_quantiles(done, rows, ["id"], "c_acctbal", {"middle": 0.5})
    return t.nation.select(F.col("n_nationkey").alias("id")).join(done, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("processed"), F.col("n").isNull().alias("missing"), "mean", "middle")


@query("""WITH r AS (SELECT c_custkey AS id, c_acctbal AS y, median(c_acctbal) OVER () AS m, avg(c_acctbal) OVER (PARTITION BY c_mktsegment) AS g FROM customer)
    SELECT predictor, round(avg(abs(y - p)), 6) AS mae, count(*) AS n FROM (SELECT 'group_mean' AS predictor, y, g AS p FROM r UNION ALL SELECT 'median', y, m FROM r) GROUP BY 1""")
def predictor_comparison(t: Tables) -> DataFrame:
    """The median as a predictor against a group's mean, on the same rows."""
    y = t.customer.select("c_mktsegment", F.col("c_acctbal").alias("y"))
    figures = y.groupBy("c_mktsegment").agg(F.avg("y").alias("group_mean")).join(quantiles.quantiles(y, [], "y", {"median": 0.5}), F.lit(True))
    each = y.join(figures, "c_mktsegment").unpivot(["y"], ["group_mean", "median"], "predictor", "p")
    return each.groupBy("predictor").agg(F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 6).alias("mae"), F.count("*").alias("n"))


@query("""WITH x AS (SELECT o_custkey, datediff('day', DATE '1992-01-01', o_orderdate::DATE) AS s, datediff('day', DATE '1992-01-01', o_orderdate::DATE) + 60 AS e FROM orders),
    o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM x),
    i AS (SELECT *, sum(n) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o), u AS (SELECT o_custkey, min(s) AS s, max(e) AS e FROM i GROUP BY o_custkey, island),
    a AS (SELECT o_custkey, sum(e - s) AS total, max(e) - min(s) AS span FROM x GROUP BY 1), c AS (SELECT o_custkey, sum(e - s) AS cover FROM u GROUP BY 1),
    p AS (SELECT o_custkey, unnest(['sum', 'span', 'union']) AS mode, unnest([total, span, cover]) AS v FROM a JOIN c USING (o_custkey)), m AS (SELECT mode, round(avg(abs(v - 600)), 6) AS mae FROM p GROUP BY 1)
    SELECT mode, mae, mae = (SELECT min(mae) FROM m) AS best FROM m""")
def date_rule_predictor(t: Tables) -> DataFrame:
    """A career's length as the sum, the span or the union of its ranges, and which errs least."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    spans = t.orders.select("o_custkey", day.alias("s"), (day + 60).alias("e"))
    plain = spans.groupBy("o_custkey").agg(F.sum(F.col("e") - F.col("s")).alias("sum"), (F.max("e") - F.min("s")).cast("long").alias("span"))
    union = evaluation.interval_union(spans, "o_custkey", "s", "e").groupBy("o_custkey").agg(F.sum(F.col("e") - F.col("s")).alias("union"))
    modes = relational.unpivoted(plain.join(union, "o_custkey"), ["o_custkey"], ["sum", "span", "union"], "mode", "v")
    out = modes.groupBy("mode").agg(F.round(F.avg(F.abs(F.col("v") - 600)), 6).alias("mae"))
    return out.join(out.agg(F.min("mae").alias("least")), F.lit(True)).select("mode", "mae", (F.col("mae") == F.col("least")).alias("best"))
