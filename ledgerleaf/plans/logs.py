"""Queries over logs and events: replay, gaps, sequences, budgets, caches, estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, dedup, layout, measure, quality
from .registry import query, table


@query("""
SELECT user_id, event_id, event_type, value, first_seen FROM (
  SELECT *, min(event_id) OVER (PARTITION BY user_id) AS first_seen, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'error') DESC, event_id DESC) AS p FROM events) WHERE p = 1
""")
def log_replay_last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").withColumn("ok", F.col("event_type") != "error")
    return audit.replay(log, "user_id", "ok", "event_id").select("user_id", "event_id", "event_type", "value", "first_seen")


@query("""
SELECT user_id, count(*) AS n_gaps, round(avg(gap), 6) AS mean_gap FROM (
  SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS gap FROM events) WHERE gap > 0 AND gap < 36000 GROUP BY user_id
""")
def log_gap_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", 36_000.0).groupBy("user_id").agg(F.count("*").alias("n_gaps"), F.round(F.avg("gap"), 6).alias("mean_gap"))


@query("""
WITH p AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) % 100 AS VARCHAR) END AS label FROM events),
k AS (SELECT *, CASE WHEN label <> '' THEN CAST(label AS INT) END AS n FROM p),
b AS (SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM k)
SELECT user_id, event_id, label, CASE WHEN n IS NULL THEN 'unreadable' WHEN n = l THEN 'repeated' ELSE 'decreasing' END AS alert FROM b WHERE n IS NULL OR n <= l
""")
def sequence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "error", "").otherwise((F.floor("value") % 100).cast("string"))
    pages = table(spark, sf_dir, "events").select("user_id", "event_id", label.alias("label"))
    return quality.page_sequence(pages, ["user_id"], order="event_id")


@query("""
SELECT conv_id, segment, count(*) AS turns, min(turn) AS first_turn, sum(length(text)) AS chars FROM (
  SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INT) AS segment FROM conversations) GROUP BY conv_id, segment
""")
def block_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = layout.segments(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("role") == "user", ["turn", "role", "text"])
    return cut.groupBy("conv_id", "segment").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.sum(F.length("text")).alias("chars"))


@query("""
SELECT user_id, line, count(*) AS n, min(value) AS lo, max(value) AS hi FROM (
  SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY value, event_id) AS INT) AS line FROM (
    SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id)) > 2.0 THEN 1 ELSE 0 END AS n FROM events)) GROUP BY user_id, line
""")
def line_grouping_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.lines_by_gap(table(spark, sf_dir, "events"), ["user_id"], "value", 2.0, "event_id").groupBy("user_id", "line").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, value, i, value AS a, 0 AS line FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.value, o.i, CASE WHEN abs(o.value - f.a) > 2.0 THEN o.value ELSE f.a END, CASE WHEN abs(o.value - f.a) > 2.0 THEN f.line + 1 ELSE f.line END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, CAST(line AS INT) AS line, count(*) AS n, min(value) AS lo, max(value) AS hi FROM f GROUP BY user_id, line
""")
def line_grouping_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return layout.lines_by_anchor(some, ["user_id"], "value", 2.0, "event_id").groupBy("user_id", "line").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, value, i, value AS a, 0 AS line FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.value, o.i, CASE WHEN abs(o.value - f.a) > 2.0 THEN o.value ELSE (f.a + o.value) / 2 END, CASE WHEN abs(o.value - f.a) > 2.0 THEN f.line + 1 ELSE f.line END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT user_id, CAST(line AS INT) AS line, count(*) AS n, min(value) AS lo, max(value) AS hi FROM f GROUP BY user_id, line
""")
def line_grouping_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return layout.lines_by_mean(some, ["user_id"], "value", 2.0, "event_id").groupBy("user_id", "line").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""
SELECT c_custkey, o_orderkey, o_totalprice, round(spent_before, 4) AS spent_before FROM (
  SELECT o_custkey AS c_custkey, o_orderkey, o_totalprice, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent_before FROM orders) WHERE spent_before < 1000000
""")
def budget_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return measure.under_budget(some, ["c_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 1_000_000.0).select("c_custkey", "o_orderkey", "o_totalprice", F.round("spent_before", 4).alias("spent_before"))


@query("""
WITH c AS (SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-09-01') AS age, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders)
SELECT o_orderkey, age, size, held FROM (SELECT *, CAST(sum(size) OVER (ORDER BY age, o_orderkey) AS BIGINT) AS held FROM c WHERE age <= 900) WHERE held <= 500000000
""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of a cache: none older than 900 days, then the newest while their sizes fit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.lit("2001-09-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("age"), F.round("o_totalprice").cast("long").alias("size"))
    return audit.evict(o, "age", "size", 900, 500_000_000, "o_orderkey")


@query("""
SELECT user_id, count(*) AS pages, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS to_read, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) * 6300 AS input_tokens,
  sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) * 350 AS output_tokens, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) * 8.0::DOUBLE AS seconds FROM events GROUP BY user_id
""")
def estimate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.estimate(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click"])


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS "error" FROM events GROUP BY user_id
""")
def nature_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.natures(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "error"])


@query("""
SELECT o_orderpriority, o_orderstatus, count(*) AS passes, round(avg(o_totalprice), 4) AS mean_value, round(max(o_totalprice) - min(o_totalprice), 4) AS spread, round(sum(o_totalprice), 2) AS sum_value, round(avg(o_custkey), 4) AS mean_cost, grouping(o_orderpriority) = 1 AS is_total
FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), ())
""")
def campaign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = measure.campaign(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", "o_custkey")
    return got.select("o_orderpriority", "o_orderstatus", "passes", F.round("mean_value", 4).alias("mean_value"), F.round("spread", 4).alias("spread"), F.round("sum_value", 2).alias("sum_value"), F.round("mean_cost", 4).alias("mean_cost"), "is_total")


@query("""
WITH price AS (SELECT * FROM (VALUES ('A', 5.0::DOUBLE, 25.0::DOUBLE, 0.05::DOUBLE), ('N', 3.0, 15.0, NULL), ('R', 1.0, 5.0, NULL)) t(l_returnflag, price_in, price_out, cache_read_share))
SELECT l_returnflag, count(*) AS n, round(sum(((l_quantity + l_suppkey * 1.25 + l_partkey * coalesce(cache_read_share, 0.10)) * price_in + l_linenumber * price_out) / 1e6 * 0.5), 6) AS cost FROM lineitem JOIN price USING (l_returnflag) GROUP BY l_returnflag
""")
def cost_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("A", 5.0, 25.0, 0.05), ("N", 3.0, 15.0, None), ("R", 1.0, 5.0, None)], "l_returnflag string, price_in double, price_out double, cache_read_share double")
    usage = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("input"), F.col("l_linenumber").alias("output"), F.col("l_partkey").alias("cache_read"), F.col("l_suppkey").alias("cache_write"))
    return measure.cost(usage, prices, "l_returnflag", batch=True).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


@query("""
WITH m AS (SELECT l_suppkey, l_linenumber, median(l_extendedprice) AS m FROM lineitem GROUP BY ALL HAVING count(*) >= 3)
SELECT a.l_suppkey, round(median((b.m - a.m) / (b.l_linenumber - a.l_linenumber)), 4) AS slope FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_suppkey
""")
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.theil_sen(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", "l_extendedprice").select("l_suppkey", F.round("slope", 4).alias("slope"))


@query("""
WITH s AS (SELECT user_id, p AS period, round(sqrt(power(sum(cos(2 * pi() * value / p)), 2) + power(sum(sin(2 * pi() * value / p)), 2)), 6) AS length FROM events, (VALUES (3.0::DOUBLE), (4.5), (6.0), (7.5)) t(p) GROUP BY user_id, p)
SELECT user_id, period, round(length, 3) AS length FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY length DESC, period) AS i FROM s) WHERE i = 1
""")
def periodicity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.best_period(table(spark, sf_dir, "events"), ["user_id"], "value", [3.0, 4.5, 6.0, 7.5]).withColumn("length", F.round("length", 3))


@query("""
SELECT user_id, round(stddev_pop(g) / avg(g), 6) AS variation, count(*) AS gaps FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS g FROM events) WHERE g IS NOT NULL GROUP BY user_id
""")
def dash_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.variation(table(spark, sf_dir, "events"), ["user_id"], "value").withColumn("variation", F.round("variation", 6))


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber - lag(l_linenumber) OVER w AS gap, row_number() OVER w AS i FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
c AS (SELECT l_orderkey, gap, count(*) AS n, min(i) AS f FROM g WHERE gap IS NOT NULL GROUP BY ALL)
SELECT l_orderkey, gap, n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f) AS p FROM c) WHERE p = 1
""")
def pitch_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.common_gap(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query("""
SELECT threshold, sum(CASE WHEN value >= threshold AND event_type = 'error' THEN 1 ELSE 0 END) AS true_alerts, sum(CASE WHEN value >= threshold AND event_type <> 'error' THEN 1 ELSE 0 END) AS false_alerts, sum(CASE WHEN value < threshold AND event_type = 'error' THEN 1 ELSE 0 END) AS missed
FROM events, (VALUES (0.0::DOUBLE), (10.0), (60.0), (95.0)) t(threshold) GROUP BY threshold
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "events").select("value", (F.col("event_type") == "error").alias("truth"))
    return measure.sweep(some, "value", "truth", [0.0, 10.0, 60.0, 95.0])


@query("""
WITH o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT user_id, event_id, value FROM o WHERE i > (SELECT max(i) FROM o p WHERE p.user_id = o.user_id) - 3
""")
def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.logs import last_lines as last

    return last(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", 3)


@query("""
WITH l AS (SELECT user_id, event_id, event_type <> 'error' AS success, CASE WHEN value > 5 THEN 'non-listing' ELSE 'broken' END AS error, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'signup')
SELECT user_id, count(*) AS entries, CAST(sum(coalesce(k, 0)) AS BIGINT) AS input_tokens, CAST(sum(event_id) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_read_input_tokens, CAST(count(*) AS BIGINT) AS cache_creation_input_tokens, string_agg(DISTINCT CAST(event_id AS VARCHAR), ',' ORDER BY CAST(event_id AS VARCHAR)) AS ids, count(*) FILTER (NOT success AND error <> 'non-listing') AS errors FROM l GROUP BY user_id
""")
def log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log entries of their user: signups have no image, errors are failures of two kinds."""
    from ..sources import logs

    e = table(spark, sf_dir, "events")
    usage = F.struct(F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), F.col("event_id").alias("output_tokens"), F.lit(None).cast("long").alias("cache_read_input_tokens"), F.lit(1).cast("long").alias("cache_creation_input_tokens"))
    log = e.select("user_id", F.when(F.col("event_type") != "signup", F.col("event_type")).alias("image"), F.col("event_id").cast("string").alias("id"), (F.col("event_type") != "error").alias("success"), F.when(F.col("value") > 5, "non-listing").otherwise("broken").alias("error"), usage.alias("usage"))
    return logs.log_totals(log, ["user_id"]).withColumn("ids", F.array_join("ids", ","))


@query("""
SELECT user_id, min(ts) FILTER (event_type = 'purchase') AS first_purchase FROM events GROUP BY user_id
""")
def first_milestone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return audit.first_time(e, ["user_id"], F.col("event_type") == "purchase", "ts").withColumnRenamed("first", "first_purchase")


@query("""
SELECT l_orderkey, l_partkey, count(*) AS n, CAST(false AS BOOLEAN) AS earlier FROM lineitem GROUP BY ALL HAVING count(*) > 1
""")
def reused_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "lineitem").withColumn("id", F.struct("l_orderkey", "l_partkey"))
    return audit.reused_ids(log, log.where("false"), "id").select("id.*", "n", "earlier")


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT o_custkey, o_orderkey, size, i, size AS held, 0 AS batch FROM o WHERE i = 1
  UNION ALL SELECT o.o_custkey, o.o_orderkey, o.size, o.i, CASE WHEN f.held + o.size > 600000 THEN o.size ELSE f.held + o.size END, CASE WHEN f.held + o.size > 600000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1)
SELECT o_custkey, o_orderkey, CAST(batch AS INT) AS batch FROM f
""")
def batch_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as the pages of a document, packed in order."""
    some = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("size"))
    return dedup.pack_in_order(some, ["o_custkey"], "o_orderkey", "size", 600_000.0).drop("size")


@query("""
SELECT user_id, count(*) AS pieces FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) WHERE b IS NULL OR epoch_us(ts) - epoch_us(b) > 36000000000 GROUP BY user_id
""")
def work_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.session_window("ts", "36000 seconds")
    return table(spark, sf_dir, "events").groupBy("user_id", w).agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("pieces"))
