"""Queries over cells: rules, audits, joins, sets, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import align, audit, dedup, diff, geometry, layout, measure, quality
from ..sources import pipe
from .registry import query, table


def part_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of part names: the second has signs a scanner confuses, lost and spaced cells, by the key's last digit."""
    p = table(spark, sf_dir, "part")
    d = F.col("p_partkey") % 10
    name = F.col("p_name")
    conv = F.when(d == 1, F.translate(F.upper(name), "OIL", "011")).when(d == 2, F.concat(name, F.lit(" x"))).when(d == 3, F.lit("")).when(d == 4, F.regexp_replace(name, " ", "")).when(d == 5, F.reverse(name)).otherwise(name)
    ref = F.when(d == 6, F.lit("")).otherwise(name)
    return p.select("p_partkey", "p_brand", ref.alias("ref"), conv.alias("conv"), (F.col("p_size") * 2).alias("conf"))


READINGS = """
WITH r AS (SELECT p_partkey, p_brand, p_size * 2 AS conf, CASE WHEN p_partkey % 10 = 6 THEN '' ELSE p_name END AS ref,
  CASE p_partkey % 10 WHEN 1 THEN translate(upper(p_name), 'OIL', '011') WHEN 2 THEN p_name || ' x' WHEN 3 THEN '' WHEN 4 THEN replace(p_name, ' ', '') WHEN 5 THEN reverse(p_name) ELSE p_name END AS conv FROM part),
n AS (SELECT *, regexp_replace(upper(ref), '\\s', '', 'g') AS nr, regexp_replace(upper(conv), '\\s', '', 'g') AS nc FROM r),
f AS (SELECT *, translate(nr, 'OILS7BZ,', '0115T82.') AS fr, translate(nc, 'OILS7BZ,', '0115T82.') AS fc FROM n),
c AS (SELECT *, CASE WHEN ref = conv THEN 'identical' WHEN nr = nc OR fr = fc OR trim(ref) = '' OR conf < 60 THEN 'benign' WHEN conf < 90 AND levenshtein(fr, fc) <= 2 THEN 'benign' ELSE 'check' END AS class,
  CASE WHEN ref = conv THEN '' WHEN nr = nc THEN 'format' WHEN fr = fc THEN 'confusion' WHEN trim(ref) = '' THEN 'reference_blank' WHEN conf < 60 THEN 'low_confidence' WHEN conf < 90 AND levenshtein(fr, fc) <= 2 THEN 'small' WHEN trim(conv) = '' THEN 'content_lost' ELSE 'divergence' END AS reason FROM f)
"""


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = part_readings(spark, sf_dir)
    kind, why = diff.classify(F.col("ref"), F.col("conv"), F.col("conf"), F.lit(False), F.lit(False))
    return some.withColumn("class", kind).withColumn("reason", why)


@query(READINGS + "SELECT p_partkey, class, reason FROM c")
def cell_class_benign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed(spark, sf_dir).select("p_partkey", "class", "reason")


@query(READINGS + "SELECT p_brand, CAST(count(*) FILTER (class = 'identical') AS BIGINT) AS identical, count(*) FILTER (class = 'benign') AS benign, count(*) FILTER (class = 'check') AS to_check, count(*) AS cells, round(count(*) FILTER (class <> 'check') / count(*), 9) AS concordance, count(*) FILTER (class <> 'check') / count(*) >= 0.98 AS faithful FROM c GROUP BY p_brand")
def discrepancy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summary(classed(spark, sf_dir).withColumn("n_cells", F.lit(1)), "p_brand").withColumn("concordance", F.round("concordance", 9))


@query()
def cell_class_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by difflib edit blocks; its plain cases are decided in Spark."""
    from ..functions.similarity import cell_class

    some = part_readings(spark, sf_dir)
    return some.select("p_partkey", cell_class(F.col("ref"), F.col("conv")).alias("class"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n, array_to_string(list(l_linenumber ORDER BY l_linenumber), ',') AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys_in_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = audit.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", "l_linenumber")
    return got.withColumn("rows", F.array_join(F.col("rows").cast("array<string>"), ","))


@query("SELECT l_shipdate::DATE::VARCHAR AS page, array_to_string(list(DISTINCT l_orderkey ORDER BY l_orderkey), ',') AS blocks FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def page_number_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates as page numbers, orders as blocks."""
    some = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("page"), F.col("l_orderkey").alias("block"))
    return audit.pages_in_blocks(some, "page", "block").where("alert = 'several'").select("page", F.array_join(F.col("blocks").cast("array<string>"), ",").alias("blocks"))


@query("""
WITH c AS (SELECT p_partkey AS doc_id, 'p_brand' AS col_name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_name', p_name FROM part),
p AS (SELECT * FROM (VALUES ('p_brand', 'Brand#[1-9]'), ('p_type', '[A-Z]+')) t(col_name, pattern))
SELECT c.doc_id, c.col_name || ': ' || c.value AS message FROM c JOIN p USING (col_name) WHERE trim(value) <> '' AND NOT regexp_full_match(trim(value), pattern)
""")
def blank_and_format_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = part_cells(spark, sf_dir)
    patterns = spark.createDataFrame([("p_brand", "Brand#[1-9]"), ("p_type", "[A-Z]+")], "col_name string, pattern string")
    return quality.off_format(cells, patterns, ["doc_id"]).select("doc_id", "message")


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of part: three columns in long form; the brand is the document."""
    p = table(spark, sf_dir, "part")
    cols = F.array(*[F.struct(F.lit(k).alias("col_idx"), F.lit(c).alias("col_name"), F.col(c).alias("value")) for k, c in enumerate(("p_brand", "p_type", "p_name"))])
    return p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("p_partkey").cast("int").alias("row_idx"), F.lit("data").alias("row_type"), F.explode(cols).alias("c")).select("doc_id", "page_idx", "row_idx", "row_type", "c.*")


@query("""
WITH a AS (SELECT source, doc_id, n_chars < 300 AS bad FROM documents),
t AS (SELECT source, count(*) AS total, count(*) FILTER (bad) AS n FROM a GROUP BY source)
SELECT source, CAST(doc_id AS INT) AS row_idx, 'short' AS message FROM a JOIN t USING (source) WHERE bad AND n <= 0.2 * total
UNION ALL SELECT source, NULL, n || ' of ' || total FROM t WHERE n > 0.2 * total
""")
def guard_rail_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    bad = docs.where("n_chars < 300").select("source", F.lit(None).cast("int").alias("page_idx"), F.col("doc_id").cast("int").alias("row_idx"), F.lit(None).cast("int").alias("col_idx"), F.lit("short").alias("rule"), F.lit("short").alias("message"), F.lit(None).cast("string").alias("proposal"), F.lit(None).cast("string").alias("pair"))
    totals = docs.groupBy("source").agg(F.count("*").alias("total"))
    return quality.guard_rail(bad, totals, ["source"]).select("source", "row_idx", "message")


@query("WITH c AS (SELECT l_suppkey, upper(l_returnflag) AS majority, count(*) AS n, min(l_orderkey) AS f FROM lineitem GROUP BY ALL) SELECT l_suppkey, majority, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, f, majority) AS p FROM c) WHERE p = 1")
def majority_minority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.majority(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "l_orderkey")


@query("""
WITH r AS (SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey % 4 = 1 THEN '' WHEN n_nationkey = 8 THEN 'OTHER' ELSE r_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT *, count(DISTINCT nullif(label, '')) OVER (PARTITION BY n_regionkey) AS kinds, first_value(nullif(label, '') IGNORE NULLS) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f,
  count(nullif(label, '')) OVER (PARTITION BY n_regionkey) AS n, count(*) OVER (PARTITION BY n_regionkey, label) AS mine FROM r)
SELECT n_nationkey, CASE WHEN label = '' AND kinds = 1 THEN f ELSE label END AS label, label = '' AND kinds = 1 AS filled, label <> '' AND kinds = 2 AND mine = 1 AND n > 2 AS outlier FROM g
""")
def unanimous_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions in any data
    k = F.col("n_nationkey")
    rows = both.select("n_nationkey", "n_regionkey", F.when(k % 4 == 1, "").when(k == 8, "OTHER").otherwise(F.col("r_name")).alias("label"))
    return audit.fill_unanimous(rows, ["n_regionkey"], "label", "n_nationkey").select("n_nationkey", "label", "filled", "outlier")


@query("""
SELECT c_custkey, CASE WHEN max(CASE WHEN c_nationkey % 2 = 0 THEN 1 END) OVER w IS NULL THEN CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS VARCHAR) ELSE c_mktsegment END AS label FROM customer WINDOW w AS (PARTITION BY c_nationkey)
""")
def number_if_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("label"))
    return audit.number_if_none(rows, ["c_nationkey"], "label", "c_custkey").select("c_custkey", "label")


def order_readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("value"))
    first = rows.where("(l_orderkey + l_linenumber) % 3 <> 0").withColumn("value", F.when(F.col("l_linenumber") == 2, "").otherwise(F.col("value")))
    second = rows.where("(l_orderkey + l_linenumber) % 5 <> 0").withColumn("value", F.concat(F.lit("s"), F.col("value")))
    one = lambda df: df.groupBy("l_orderkey", "l_linenumber").agg(F.max("value").alias("value"))
    return one(first), one(second)


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linenumber = 2 THEN '' ELSE CAST(l_partkey AS VARCHAR) END) AS v FROM lineitem WHERE (l_orderkey + l_linenumber) % 3 <> 0 GROUP BY ALL),
b AS (SELECT l_orderkey, l_linenumber, max('s' || l_partkey) AS v FROM lineitem WHERE (l_orderkey + l_linenumber) % 5 <> 0 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(a.v, '') = '' THEN coalesce(b.v, '') ELSE a.v END AS value, CASE WHEN coalesce(a.v, '') <> '' THEN 'first' WHEN b.v IS NOT NULL THEN 'second' ELSE 'none' END AS source FROM a FULL JOIN b USING (l_orderkey, l_linenumber)
""")
def coalesce_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = order_readings(spark, sf_dir)
    return align.merge_readings(a, b, ["l_orderkey", "l_linenumber"])


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, max('s' || l_partkey) AS value FROM lineitem WHERE (l_orderkey + l_linenumber) % 5 <> 0 AND l_orderkey % 2 = 0 GROUP BY ALL),
a AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN l_linenumber = 2 THEN '' ELSE CAST(l_partkey AS VARCHAR) END) AS value FROM lineitem WHERE (l_orderkey + l_linenumber) % 3 <> 0 GROUP BY ALL)
SELECT * FROM a ANTI JOIN r USING (l_orderkey) UNION ALL SELECT * FROM r
""")
def positional_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = order_readings(spark, sf_dir)
    return align.replace_pages(a, b.where("l_orderkey % 2 = 0"), ["l_orderkey"])


@query("""
WITH x AS (SELECT l_suppkey, CAST(l_quantity AS INT) AS content, l_orderkey AS row_idx, row_number() OVER (PARTITION BY l_suppkey, CAST(l_quantity AS INT) ORDER BY l_orderkey) AS t FROM (SELECT DISTINCT l_suppkey, l_quantity, l_orderkey FROM lineitem WHERE l_returnflag = 'A')),
y AS (SELECT l_suppkey, CAST(l_quantity AS INT) AS content, l_orderkey AS row_idx, row_number() OVER (PARTITION BY l_suppkey, CAST(l_quantity AS INT) ORDER BY l_orderkey) AS t FROM (SELECT DISTINCT l_suppkey, l_quantity, l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT l_suppkey, content, x.row_idx AS ref_idx, y.row_idx AS conv_idx FROM x JOIN y USING (l_suppkey, content, t)
""")
def moved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("content"), F.col("l_orderkey").alias("row_idx"), "l_returnflag").distinct()
    side = lambda f: rows.where(F.col("l_returnflag") == f).drop("l_returnflag")
    return align.moved_rows(side("A"), side("R"), ["l_suppkey"])


@query("SELECT p_partkey, p_name || ' | ' || p_brand || ' | ' || p_type || ' | ' || p_size AS line, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_name END AS c0, p_brand AS c1, CASE WHEN p_size % 3 = 0 THEN p_type || ' ' || p_size ELSE p_type END AS c2, CASE WHEN p_size % 3 = 0 THEN 'end' ELSE CAST(p_size AS VARCHAR) END AS c3 FROM part")
def pipe_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipe lines of part rows, written and parsed back; every third has a segment too many, which joins the last cell but one."""
    p = table(spark, sf_dir, "part")
    cells = F.array("p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    line = pipe.join_cells(cells)
    raw = p.select("p_partkey", line.alias("line"), F.when(F.col("p_size") % 3 == 0, F.concat(line, F.lit(" | end"))).otherwise(line).alias("raw"))
    rows = pipe.parse_rows(pipe.lines_of(raw, ["p_partkey", "line"]), ["p_partkey", "line"], 4)
    return rows.select("p_partkey", "line", *[F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(4)])


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY p_brand")
def lines_off_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    line = F.concat_ws("|", "p_name", "p_brand", "p_type", F.col("p_size").cast("string"))
    raw = p.select("p_brand", "p_partkey", F.when(F.col("p_size") % 3 == 0, F.concat(line, F.lit("|end"))).otherwise(line).alias("raw"))
    return pipe.off_columns(pipe.lines_of(raw, ["p_brand"]), ["p_brand"], 4).select("p_brand", "n")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS kind, CAST(floor(value) AS BIGINT) AS amount FROM events")
def footer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled text built from events, read back as a map."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("TYPE: x KEY: "), F.get_json_object("props", "$.k"), F.lit(" TYPE: "), F.col("event_type"), F.lit(" AMOUNT: "), F.floor("value").cast("string"))
    m = pipe.footer_pairs(line, ["TYPE", "KEY", "AMOUNT"])
    return e.select("event_id", m.alias("m")).select("event_id", F.col("m")["KEY"].cast("long").alias("k"), F.col("m")["TYPE"].alias("kind"), F.col("m")["AMOUNT"].cast("long").alias("amount"))


@query("""
WITH a AS (SELECT doc_id, 'quality' AS rule, 'low' AS message FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'toxic', 'toxic' FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'short', 'short' FROM documents WHERE n_chars < 300)
SELECT doc_id, string_agg(message, '; ' ORDER BY rule) AS messages, count(*) AS n_alerts FROM a GROUP BY doc_id
""")
def alert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    one = lambda df, rule, message: df.select("doc_id", F.lit(rule).alias("rule"), F.lit(message).alias("message"), F.lit(None).cast("string").alias("proposal"))
    alerts = one(lab.where("quality = 0"), "quality", "low").unionByName(one(lab.where("toxic = 1"), "toxic", "toxic")).unionByName(one(docs.where("n_chars < 300"), "short", "short"))
    return quality.merge_alerts(alerts, ["doc_id"]).select("doc_id", "messages", F.col("n_alerts").cast("long").alias("n_alerts"))


@query("SELECT source, count(*) AS n, sum(quality) AS good, row_number() OVER (ORDER BY count(*) DESC, sum(quality) DESC, source) AS place FROM labels JOIN documents USING (doc_id) GROUP BY source")
def validation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("good"), "source")))


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'only_document' WHEN d.doc_id IS NULL THEN 'only_label' ELSE 'both' END AS side FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def orphans_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("b"))
    return d.join(lab, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("doc_id"), F.when(F.col("b").isNull(), "only_document").when(F.col("a").isNull(), "only_label").otherwise("both").alias("side"))


@query("""
WITH b AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 10.0::DOUBLE), (1, 10.0, 25.0), (2, 25.0, 60.0)) t(col_idx, lo, hi))
SELECT event_type, CAST(col_idx AS INT) AS col_idx, count(*) AS n FROM (SELECT event_type, coalesce((SELECT col_idx FROM b WHERE value >= lo AND value < hi), 2) AS col_idx FROM events) GROUP BY ALL
""")
def range_join_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of events as pages with bounds of their own."""
    words = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("x0"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("col_idx"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, lo, hi in ((0, 0.0, 10.0), (1, 10.0, 25.0), (2, 25.0, 60.0))])).alias("b")
    bounds = words.select("event_type").distinct().select("event_type", each).select("event_type", "b.*")
    return layout.into_columns(words, bounds, ["event_type"]).groupBy("event_type", "col_idx").agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT *, greatest(10.0, 0.75 * median(l_quantity) OVER (PARTITION BY l_orderkey)) AS gap, max(l_extendedprice + l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_extendedprice + l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lineitem),
c AS (SELECT l_orderkey, sum(CASE WHEN l_extendedprice > b + gap THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_extendedprice + l_quantity) AS cell FROM w)
SELECT l_orderkey, count(DISTINCT cell) AS cells FROM c GROUP BY l_orderkey
""")
def merge_words_in_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("l"), (F.col("l_extendedprice") + F.col("l_quantity")).alias("r"))
    return layout.islands(words, ["l_orderkey"], "l", "r").groupBy("l_orderkey").agg(F.countDistinct("cell").alias("cells"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem),
h AS (SELECT l_orderkey, CAST(ceil((1 + count(*) + 2) / 59.0) * 59 AS BIGINT) AS height FROM l GROUP BY l_orderkey),
s AS (SELECT l_orderkey, coalesce(sum(height) OVER (ORDER BY l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h)
SELECT l_orderkey, min(start + 1 + i)::BIGINT AS first_row, max(start + 1 + i)::BIGINT AS last_row FROM l JOIN s USING (l_orderkey) GROUP BY l_orderkey
""")
def sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("o"))
    return layout.sheet_rows(rows, ["l_orderkey"], "o").groupBy("l_orderkey").agg(F.min("sheet_row").cast("long").alias("first_row"), F.max("sheet_row").cast("long").alias("last_row"))


@query("SELECT c_nationkey, c_custkey, round(coalesce(sum(c_acctbal + 10) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS x_offset FROM customer")
def pages_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.side_by_side(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey", "c_acctbal", 10.0).select("c_nationkey", "c_custkey", F.round("x_offset", 4).alias("x_offset"))


@query("SELECT p_brand, round(avg(CASE WHEN trim(value) <> '' THEN 1.0 ELSE 0 END), 9) AS fill_rate, count(*) AS cells FROM (SELECT p_brand, p_name AS value FROM part UNION ALL SELECT p_brand, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_type END FROM part) GROUP BY p_brand")
def engine_fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cells = p.select("p_brand", F.explode(F.array("p_name", F.when(F.col("p_size") % 7 == 0, " ").otherwise(F.col("p_type")))).alias("value"))
    return measure.fill_rate(cells, ["p_brand"]).withColumn("fill_rate", F.round("fill_rate", 9))


@query("SELECT p_type AS layer, count(*) AS n FROM part GROUP BY ROLLUP (p_type)")
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.per_layer(table(spark, sf_dir, "part").select(F.col("p_type").alias("layer")))


@query("SELECT p_partkey FROM part WHERE upper(p_name) IN (SELECT upper(p_name) FROM part GROUP BY ALL HAVING count(*) > 1) AND p_partkey NOT IN (SELECT min(p_partkey) FROM part GROUP BY upper(p_name))")
def stable_distinct_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a stable distinct by name leaves out."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("name"))
    first = dedup.first_of_each(p.withColumn("keep", F.col("p_partkey")), ["name"], "p_partkey").select(F.col("keep").alias("p_partkey"))
    return p.join(first, "p_partkey", "left_anti").select("p_partkey")


@query("""
WITH known AS (SELECT DISTINCT p_type AS value FROM part WHERE p_size < 3), new AS (SELECT DISTINCT p_type AS value FROM part WHERE p_size > 40)
SELECT value, 'added' AS state FROM new WHERE value NOT IN (SELECT value FROM known) UNION ALL SELECT value, 'known' FROM known
""")
def dictionary_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = lambda where: table(spark, sf_dir, "part").where(where).select(F.col("p_type").alias("value")).distinct()
    known, new = values("p_size < 3"), values("p_size > 40")
    now = dedup.add_values(known, new, ["value"])
    added = dedup.remove_values(now, known, ["value"])
    return added.withColumn("state", F.lit("added")).unionByName(dedup.remove_values(now, added, ["value"]).withColumn("state", F.lit("known")))


@query("SELECT s_suppkey, sha256(s_name || chr(31) || CAST(s_nationkey AS VARCHAR)) AS key FROM supplier WHERE s_suppkey % 3 <> 0")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = text.content_key(F.col("s_name"), F.col("s_nationkey").cast("string"))
    cache = s.where("s_suppkey % 3 = 0").select(key.alias("key"))
    return dedup.unseen(s, cache, key).select("s_suppkey", "key")


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS BIGINT) % 5 AS visible, CAST(o_custkey AS BIGINT) % 3 AS read, o_orderstatus = 'F' AS exact FROM orders),
r AS (SELECT *, avg(CASE WHEN visible <> read THEN 1.0 ELSE 0 END) OVER (PARTITION BY o_custkey, exact) AS rate FROM p)
SELECT o_orderkey, CASE WHEN visible = read THEN 'ok' WHEN exact THEN 'alert' WHEN visible > 0 AND read = 0 THEN 'lost' WHEN rate > 0.2 THEN 'not_judged' WHEN abs(visible - read) <= 2 THEN 'alert' ELSE 'uncertain' END AS decision FROM r
""")
def line_count_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.bround("o_totalprice").cast("long") % 5).alias("visible"), (F.col("o_custkey") % 3).alias("read"), (F.col("o_orderstatus") == "F").alias("exact"))
    return quality.line_count_decisions(p, ["o_custkey"]).select("o_orderkey", "decision")


@query("SELECT CASE WHEN n_chars >= 2000 AND n_chars < 8000 THEN 'vector' WHEN n_chars % 50 >= 20 THEN 'hidden_ocr' WHEN n_chars >= 1000 THEN 'scan' ELSE 'empty' END AS nature, count(*) AS n FROM documents GROUP BY 1")
def page_nature(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    p = table(spark, sf_dir, "documents").select((n / 100).alias("visible_signs"), (n % 50).alias("hidden_signs"), (n / 10_000).alias("image_share"))
    return layout.text_pages(p).groupBy("nature").agg(F.count("*").alias("n"))


@query()
def rdp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a polyline (number, price in thousands), simplified."""
    some = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y")))).alias("points"))
    return some.select("l_orderkey", F.size("points").alias("before"), F.size(geometry.simplified(F.col("points"), 5.0)).alias("after"), F.round(geometry.path_length(F.col("points")), 6).alias("length"))


@query()
def chain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between consecutive values of a user, joined into chains per user."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct(F.col("event_id").cast("double").alias("x"), F.col("value").alias("y")).alias("p")).withColumn("q", F.lead("p").over(w)).where("q IS NOT NULL")
    return geometry.merge_chains(e.select("user_id", "event_id", F.array("p", "q").alias("points")), ["user_id"], "event_id", 0.5).select("user_id", "chain", F.size("points").alias("n"))


@query("""
WITH RECURSIVE o AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_extendedprice / 1000 AS x, l_quantity AS y, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_extendedprice) AS i FROM lineitem),
f AS (SELECT *, true AS stays, [struct_pack(x := x, y := y)] AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.*, len(list_filter(f.kept, lambda k: abs(k.x - o.x) <= 20 AND abs(k.y - o.y) <= 20)) = 0, CASE WHEN len(list_filter(f.kept, lambda k: abs(k.x - o.x) <= 20 AND abs(k.y - o.y) <= 20)) = 0 THEN list_append(f.kept, struct_pack(x := o.x, y := o.y)) ELSE f.kept END
    FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.l_returnflag = f.l_returnflag AND o.i = f.i + 1)
SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM f WHERE stays
""")
def tolerance_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages and return flags as texts: items that lie within a tolerance (price in thousands, quantity) of one kept before go."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("o"))
    placed = li.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("o"))).drop("o")
    return dedup.within_tolerance(placed, ["l_orderkey", "l_returnflag"], "i", "x", "y", 20.0).select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_type, CAST(event_id AS INT) AS row_idx, CAST(floor(value) AS INT) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
f AS (SELECT *, n AS sure, CAST(NULL AS INT) AS doubt, CAST(NULL AS VARCHAR) AS message FROM o WHERE i = 1
  UNION ALL SELECT o.*, CASE WHEN ok THEN o.n ELSE g.sure END, CASE WHEN ok THEN NULL ELSE o.n END, CASE WHEN ok THEN NULL ELSE g.sure || ' then ' || o.n END
    FROM (SELECT f.user_id, f.event_type, f.i, f.sure, f.doubt, p.n, p.n BETWEEN f.sure AND f.sure + 20 OR coalesce(p.n BETWEEN f.doubt AND f.doubt + 20, false) AS ok FROM f JOIN o p ON p.user_id = f.user_id AND p.event_type = f.event_type AND p.i = f.i + 1) g
    JOIN o ON o.user_id = g.user_id AND o.event_type = g.event_type AND o.i = g.i + 1)
SELECT user_id AS doc_id, row_idx, message FROM f WHERE message IS NOT NULL
""")
def continuity_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a user's events per type, as a sequence that must not fall or jump."""
    e = table(spark, sf_dir, "events")
    cells = e.select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page_idx"), F.col("event_id").cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("data").alias("row_type"), F.lit("n").alias("col_name"), F.concat(F.col("event_type"), F.lit(" "), F.floor("value").cast("string")).alias("value"))
    return quality.continuity(cells, "n", ["doc_id"]).select("doc_id", "row_idx", "message")
