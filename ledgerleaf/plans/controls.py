"""Queries over controls of pages: conservation, votes, corrections, glyphs, nearness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit, controls
from .registry import query, table


def word_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as words of a page (their order): some without an answer, some misread."""
    li = table(spark, sf_dir, "lineitem")
    k = F.col("l_partkey") % 13
    word = F.col("l_partkey").cast("string")
    return li.select("l_suppkey", "l_orderkey", word.alias("word"), F.when(k == 0, None).when(k == 1, F.concat(word, F.lit("x"))).otherwise(word).alias("read"), (F.col("l_quantity") * 2).cast("int").alias("conf"))


MATCHES = """
WITH m AS (SELECT l_suppkey, l_orderkey, CAST(l_partkey AS VARCHAR) AS word, CASE l_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN l_partkey || 'x' ELSE CAST(l_partkey AS VARCHAR) END AS read, CAST(l_quantity * 2 AS INT) AS conf FROM lineitem),
p AS (SELECT l_suppkey, l_orderkey, count(read) AS matched, count(*) FILTER (read IS NOT NULL AND upper(read) <> word) AS wrong, count(*) FILTER (read IS NULL AND conf >= 60) AS omitted, min(conf) AS least_conf FROM m GROUP BY ALL),
d AS (SELECT *, coalesce(wrong / nullif(matched, 0), 0.0) AS divergence FROM p)
"""


@query(MATCHES + "SELECT l_suppkey, l_orderkey, matched, wrong, omitted, least_conf, round(divergence, 9) AS divergence, divergence > 0.10 AS degraded FROM d")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.conservation(word_matches(spark, sf_dir), ["l_suppkey", "l_orderkey"]).withColumn("divergence", F.round("divergence", 9))


@query(MATCHES + """, s AS (SELECT *, avg(CASE WHEN divergence > 0.10 THEN 1.0 ELSE 0 END) OVER (PARTITION BY l_suppkey) AS share FROM d)
SELECT l_suppkey, round(divergence, 9) AS lowest, round(divergence, 9) AS highest, CAST(l_orderkey AS VARCHAR) AS pages FROM s WHERE divergence > 0.10 AND share <= 0.5
UNION ALL SELECT l_suppkey, round(min(divergence), 9), round(max(divergence), 9), string_agg(l_orderkey, ',' ORDER BY l_orderkey) FROM s WHERE divergence > 0.10 AND share > 0.5 GROUP BY l_suppkey""")
def degraded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = controls.conservation(word_matches(spark, sf_dir), ["l_suppkey", "l_orderkey"])
    got = controls.degraded_summary(pages, ["l_suppkey"], "l_orderkey")
    return got.select("l_suppkey", F.round("lowest", 9).alias("lowest"), F.round("highest", 9).alias("highest"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS value, CAST(l_quantity AS INT) AS confidence, regexp_full_match(CAST(l_suppkey AS VARCHAR), '[0-9]{1,2}') AS fits FROM lineitem)
SELECT l_orderkey, l_linenumber, b.value AS value, b.confidence AS confidence, b.fits AS fits FROM (SELECT l_orderkey, l_linenumber, max(struct_pack(fits := fits, confidence := confidence, value := value)) AS b FROM r GROUP BY ALL)
""")
def cell_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated line numbers of an order as readings of one cell."""
    some = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("s").alias("col_name"), F.col("l_suppkey").cast("string").alias("value"), F.col("l_quantity").cast("int").alias("confidence"))
    patterns = spark.createDataFrame([("s", "[0-9]{1,2}")], "col_name string, pattern string")
    return controls.vote(some, ["l_orderkey", "l_linenumber"], patterns)


@query("""
WITH v AS (SELECT user_id, event_id, regexp_replace(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '[0-9]', '9', 'g') AS s FROM events),
a AS (SELECT *, list(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l FROM v)
SELECT user_id, event_id, round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: x = s)) / len(l) ELSE 0 END, 9) AS coherence FROM a
""")
def coherence_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").cast("string").alias("v"))
    return e.select("user_id", "event_id", F.round(controls.coherence_with_above(e, ["user_id"], "event_id", "v"), 9).alias("coherence"))


@query("SELECT p_partkey, CASE WHEN p_size < 100 AND p_partkey % 2 = 0 THEN p_type || ' 0' || p_size ELSE p_type || ' x O' || p_size END AS value, p_partkey % 2 = 0 AS corrected FROM part")
def letter_o_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" O"), "p_size")).otherwise(F.concat("p_type", F.lit(" x O"), "p_size")).alias("v"))
    value, hit = controls.letter_o(F.col("v"))
    return raw.select("p_partkey", value.alias("value"), hit.alias("corrected"))


@query("""
WITH c AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS missing FROM orders ANTI JOIN c USING (o_custkey, o_orderpriority) GROUP BY o_custkey
""")
def revisions_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("index"), "o_orderstatus")
    return controls.revisions_listed(o, o.where("o_orderstatus = 'F'"), ["o_custkey"]).withColumn("missing", F.array_join("missing", ","))


@query("""
WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_linestatus, l_partkey % 97 AS shape, chr(CAST(CASE WHEN l_partkey % 97 % 5 = 0 THEN 65 + l_suppkey % 3 ELSE 65 + l_partkey % 97 % 26 END AS INT)) AS letter FROM lineitem),
k AS (SELECT shape, min(letter) AS letter FROM (SELECT * FROM g WHERE l_linestatus = 'F') GROUP BY shape HAVING count(DISTINCT letter) = 1)
SELECT l_orderkey, string_agg(coalesce(k.letter, chr(65533)), '' ORDER BY l_linenumber, l_extendedprice) AS text, bool_or(k.letter IS NULL) AS unread FROM g LEFT JOIN k USING (shape) GROUP BY l_orderkey
""")
def glyph_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys as shapes: the letters of all finished items, as readable text, decode every item; a fifth of the shapes stands for several letters."""
    shape = F.col("l_partkey") % 97
    letter = F.char(F.when(shape % 5 == 0, 65 + F.col("l_suppkey") % 3).otherwise(65 + shape % 26))
    g = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", F.struct("l_linenumber", "l_extendedprice").alias("o"), shape.alias("shape"), letter.alias("letter"))
    known = controls.glyph_table(g.where("l_linestatus = 'F'").select("shape", "letter"))
    return controls.decode(g.select("l_orderkey", "o", "shape"), known, ["l_orderkey"], "o")


@query("""
WITH d AS (SELECT o_orderkey, o_custkey AS hash, o_totalprice AS name FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT o_custkey AS hash, o_totalprice AS name FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01')
SELECT o_orderkey, CASE WHEN d.hash IN (SELECT hash FROM r) THEN 'hash' WHEN d.name IN (SELECT name FROM r) THEN 'name' END AS "by" FROM d
""")
def log_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("hash"), F.col("o_totalprice").alias("name"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderstatus")
    return controls.reconcile(o.where("o_orderstatus = 'O'").select("o_orderkey", "hash", "name"), o.where("o_orderstatus = 'F'"), F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", "by")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber * 1000 + l_suppkey % 1000 AS id, l_extendedprice / 1000 AS x0, l_extendedprice / 1000 + l_quantity AS x1, 10.0 AS h FROM lineitem)
SELECT a.l_orderkey, a.id AS a, b.id AS b, round(least(a.x1, b.x1) - greatest(a.x0, b.x0), 6) AS overlap FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.id < b.id WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.5 * a.h
""")
def text_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    boxes = li.select("l_orderkey", (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000).alias("id"), (F.col("l_extendedprice") / 1000).alias("x0"), (F.col("l_extendedprice") / 1000 + F.col("l_quantity")).alias("x1"), F.lit(10.0).alias("h"))
    return controls.overlaps(boxes, ["l_orderkey"]).withColumn("overlap", F.round("overlap", 6))


@query("""
WITH p AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)
SELECT a.label, a.id AS a, b.id AS b FROM p a JOIN p b ON a.label = b.label AND a.id < b.id AND abs(a.x - b.x) <= 0.02 AND abs(a.y - b.y) <= 0.02
""")
def near_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return controls.near_pairs(p, ["label"], 0.02)


@query("""
WITH l AS (SELECT user_id, event_id, value, CASE WHEN event_type IN ('view', 'click') THEN CAST(value AS INT) END AS m FROM events),
w AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(m IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM l)
SELECT event_id, b AS "before", a AS "after" FROM w WHERE m IS NULL AND CAST(floor(value) AS INT) * 3 >= 60 AND a IS NOT NULL AND b IS NOT NULL
""")
def missing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.floor("value").cast("int") * 3).alias("conf"), F.when(F.col("event_type").isin("view", "click"), F.bround("value").cast("int")).alias("matched_rank"))
    return controls.missing_lines(e, ["user_id"], "event_id").select("event_id", "before", "after")


@query("""
WITH o AS (SELECT event_id, user_id, CAST(k AS INT) AS col_idx, k = user_id % 3 AS current, (CAST(value * 100 AS BIGINT) * (k + 1)) % 100 / 100.0 AS score, k = 2 AND user_id % 7 = 0 AS split, 0.05 AS edge FROM events, (VALUES (0), (1), (2)) t(k)),
h AS (SELECT event_id, max(score) FILTER (current) AS hs, max(col_idx) FILTER (current) AS hc, max(struct_pack(s := score, o := -col_idx)) FILTER (NOT current AND NOT split) AS b FROM o GROUP BY event_id)
SELECT event_id, CASE WHEN round(b.s - hs, 6) > 0.25 THEN -b.o ELSE hc END AS col_idx, round(b.s - hs, 6) > 0.05 AND round(b.s - hs, 6) <= 0.25 AS flagged FROM h
""")
def word_rebalancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    score = (F.bround(F.col("value") * 100).cast("long") * (F.col("k") + 1)) % 100 / 100.0
    options = e.select("event_id", F.col("k").alias("col_idx"), (F.col("k") == F.col("user_id") % 3).alias("current"), score.alias("score"), ((F.col("k") == 2) & (F.col("user_id") % 7 == 0)).alias("split"), F.lit(0.05).alias("edge_share"))
    got = controls.rebalance(options.withColumn("score", F.round("score", 6)), ["event_id"])
    gain = F.round("gain", 6)
    return got.select("event_id", "col_idx", ((gain > controls.FLAG) & (gain <= controls.MOVE)).alias("flagged"))


@query()
def word_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns placed by their twins in the next turn of the conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("rank", "word"))
    seen = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "rank", "word", (F.col("rank") * 7.0).alias("x"))
    return controls.place_words(c, seen, ["conv_id", "turn"])


@query("""
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events),
w AS (SELECT user_id, rank, event_type AS expected, row_number() OVER (PARTITION BY user_id, event_type ORDER BY rank) AS k FROM e WHERE rank <= 3),
m AS (SELECT user_id, event_type AS expected, 'an ' || event_type || ' came' AS message, row_number() OVER (PARTITION BY user_id, event_type ORDER BY rank) AS k FROM e WHERE rank > 3)
SELECT user_id, expected, message FROM w LEFT JOIN m USING (user_id, expected, k)
""")
def alerts_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a user's first events, sought among the messages of the later ones."""
    e = table(spark, sf_dir, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    expected = e.where("rank <= 3").select("user_id", "rank", F.col("event_type").alias("expected"))
    emitted = e.where("rank > 3").select("user_id", "rank", F.concat(F.lit("an "), F.col("event_type"), F.lit(" came")).alias("message"))
    return controls.alerts_met(expected, emitted, ["user_id"])


@query()
def dictionary_closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread part names and the dictionary value most like each."""
    p = table(spark, sf_dir, "part").select(F.lit("name").alias("col_name"), F.upper("p_name").alias("value")).distinct()
    wrong = p.select("col_name", F.concat(F.substring("value", 1, 4), F.lit("X"), F.expr("substring(value, 6)")).alias("value")).distinct()
    return controls.closest_values(wrong, p).withColumn("ratio", F.round("ratio", 9))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) % 40 AS VARCHAR) || CASE WHEN o_orderkey % 4 = 0 THEN 'a' ELSE '' END AS label FROM orders)
SELECT o_custkey, string_agg(label, ',' ORDER BY CAST(regexp_extract(label, '\\d+') AS INT), regexp_extract(label, '[a-z]?$'), o_orderkey) AS labels FROM p GROUP BY o_custkey
""")
def natural_page_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat((F.floor("o_totalprice") % 40).cast("string"), F.when(F.col("o_orderkey") % 4 == 0, "a").otherwise(""))
    p = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", label.alias("label"))
    some = p.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(controls.page_order(F.col("label")).alias("k"), "o_orderkey", "label"))).alias("l"))
    return some.select("o_custkey", F.array_join(F.transform("l", lambda x: x["label"]), ",").alias("labels"))


@query("""
WITH c AS (SELECT l_suppkey, upper(l_returnflag) AS majority, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY ALL),
m AS (SELECT l_suppkey, majority FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f, majority) AS p FROM c) WHERE p = 1)
SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, majority FROM lineitem JOIN m USING (l_suppkey) WHERE upper(l_returnflag) <> majority
""")
def minority_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag")
    return audit.minority(li, ["l_suppkey"], "l_returnflag", "l_orderkey").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "majority")
