"""Queries over footers, files, texts of pages, dictionaries and layers of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import align, controls, dedup, diff, layout, quality
from ..sources import footer, logs, office, pipe
from ..streaming import events as feed
from .registry import query, table


@query("""
SELECT page_id, CASE lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'jsonl' THEN 'log' WHEN 'docx' THEN 'word' WHEN 'xlsx' THEN 'workbook' WHEN 'png' THEN 'image' WHEN '' THEN 'folder' ELSE 'unknown' END AS reader FROM pages
""")
def file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", logs.route(F.col("url")).alias("reader"))


@query("""
WITH l AS (SELECT p_partkey, p_name, p_type, p_size, p_brand FROM part)
SELECT p_partkey, 'K' || p_size AS kind, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) END AS cable, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS VARCHAR) END AS page, CAST(p_partkey AS VARCHAR) AS plan,
  CASE WHEN p_size % 4 = 0 THEN '12' END AS pet, CASE WHEN p_size % 4 = 0 THEN 'RACK ' || p_size END AS placed,
  concat_ws(' ', p_type, 'left', CASE WHEN p_size % 2 = 0 THEN nullif(array_to_string(string_split(p_name, ' ')[2:], ' '), '') END, CASE WHEN p_size % 4 = 0 THEN '8/10' END) AS rest, CASE WHEN p_size % 5 = 0 THEN 'N O R D A' END AS logo FROM l
""")
def open_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers written from parts and read back: one-word labels, counters without a colon, diameters, texts set apart, spaced logos, frames."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_size")
    lines = F.array(
        F.lit("|------|"),
        F.concat(F.when(k % 5 == 0, "| N O R D A | ").otherwise(F.lit("| ")), "p_type", F.lit(" TYPE : K"), k, F.lit(" left |")),
        F.when(k % 2 == 0, F.concat(F.lit("CABLE: "), "p_name")),
        F.when(k % 4 == 0, F.concat(F.lit("P.E.T. : 12 8/10    RACK "), k)),
        F.concat(F.lit("N° PLAN : "), "p_partkey", F.when(k % 3 == 0, F.concat(F.lit(" PAGE "), k)).otherwise("")),
        F.when(k % 2 == 0, F.lit("CABLE : later")).otherwise(F.lit("| | |")),
    )
    m = p.select("p_partkey", k, footer.footer_map(lines).alias("m"))
    of = lambda name: F.try_element_at("m", F.lit(name))
    rest = F.regexp_replace(of("COMPLEMENT"), r" ?\blater\b", "")
    return m.select("p_partkey", of("TYPE").alias("kind"), of("CABLE").alias("cable"), of("PAGE").alias("page"), of("NO_PLAN").alias("plan"), of("PET").alias("pet"), of("EMPLACEMENT_BORNIER").alias("placed"), rest.alias("rest"), of("LOGO").alias("logo"))


@query("""
WITH a AS (SELECT user_id, event_id, upper(event_type[1:1]) || CASE WHEN event_type = 'click' THEN '1' ELSE '' END AS code FROM events WHERE event_type <> 'error')
SELECT user_id, string_agg(code, ',' ORDER BY f) AS codes FROM (SELECT user_id, code, min(event_id) AS f FROM a GROUP BY ALL) GROUP BY user_id
""")
def revision_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as revision lines of a document, of which errors begin with a long word."""
    e = table(spark, sf_dir, "events")
    code = F.concat(F.upper(F.substring("event_type", 1, 1)), F.when(F.col("event_type") == "click", "1").otherwise(""))
    line = F.when(F.col("event_type") == "error", "ERR none").otherwise(F.concat(F.lit("REVISIONS: "), code, F.lit(" of "), "event_type"))
    raw = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("raw"))
    return pipe.revision_codes(pipe.lines_of(raw, ["user_id"]), ["user_id"]).withColumn("codes", F.array_join("codes", ","))


@query("""
SELECT p_partkey, 'p. ' || p_size || ' of ' || p_brand || ' ().' AS footer, CAST(regexp_extract(p_name || ' ' || p_size || 'b', '(\\d+)b$', 1) AS INT) AS number, 'b' AS suffix,
  CASE WHEN p_partkey >= 3600 THEN (p_partkey // 3600) || ':' || lpad(CAST(p_partkey // 60 % 60 AS VARCHAR), 2, '0') ELSE CAST(p_partkey // 60 AS VARCHAR) END || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') AS duration,
  p_size AS page, CASE WHEN p_size > 0 THEN round(p_partkey / p_size * (p_size + 5 - p_size), 6) END AS remaining FROM part
""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates, page labels, durations and progress messages of parts."""
    p = table(spark, sf_dir, "part")
    fields = F.create_map(F.lit("PAGE"), F.col("p_size").cast("string"), F.lit("ALL"), F.col("p_brand"))
    key = text.page_key(F.concat_ws(" ", "p_name", F.concat(F.col("p_size"), F.lit(" b"))))
    told = text.progress(F.concat(F.lit("reading Page "), "p_size", F.lit("/"), F.col("p_size") + 5))
    return p.select(
        "p_partkey",
        text.template("p. {PAGE} of {ALL} ({NONE}).", fields).alias("footer"),
        key["number"].alias("number"),
        key["suffix"].alias("suffix"),
        text.duration(F.col("p_partkey")).alias("duration"),
        told["page"].alias("page"),
        F.round(text.remaining(F.col("p_partkey").cast("double"), told["page"], told["total"]), 6).alias("remaining"),
    )


@query("""
WITH n AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS f FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN f = 0 THEN 'high' WHEN f = 1 THEN 'medium' ELSE 'low' END AS certainty FROM n
""")
def line_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_returnflag") == "A").cast("int")).alias("f"))
    return n.select("l_orderkey", controls.certainty(F.col("f")).alias("certainty"))


@query("""
SELECT p_partkey, p_name || ' ' || p_type AS c0, '' AS c1, CAST(p_size AS VARCHAR) AS c2 FROM part
""")
def mapped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a pipe row put into columns by a given mapping, one of which names no segment and one a segment that is not there."""
    p = table(spark, sf_dir, "part")
    parts = pipe.split_cells(pipe.join_cells(F.array("p_name", F.col("p_size").cast("string"), "p_type")))
    row = controls.mapped_row(parts, [[0, 2], [], [1, 9]])
    return p.select("p_partkey", *[F.get(row, F.lit(k)).alias(f"c{k}") for k in range(3)])


@query("""
WITH RECURSIVE r AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS col, CAST(event_id AS VARCHAR) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, i, event_id AS first, [CASE WHEN col = 0 THEN v ELSE '' END, CASE WHEN col = 1 THEN v ELSE '' END, CASE WHEN col = 2 THEN v ELSE '' END, CASE WHEN col = 3 THEN v ELSE '' END] AS cells FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, CASE WHEN f.cells[r.col + 1] = '' THEN f.first ELSE r.event_id END,
    CASE WHEN f.cells[r.col + 1] = '' THEN list_transform(f.cells, lambda c, k: CASE WHEN k = r.col + 1 THEN r.v ELSE c END) ELSE list_transform(f.cells, lambda c, k: CASE WHEN k = r.col + 1 THEN r.v ELSE '' END) END FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
SELECT user_id, CAST(first AS INT) AS row_idx, array_to_string(arg_max(cells, i), '|') AS cells FROM f GROUP BY user_id, first
""")
def partial_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as rows with one cell each, by type: those that fill different columns are one row."""
    e = table(spark, sf_dir, "events")
    col = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3)
    cells = F.array(*[F.when(col == k, F.col("event_id").cast("string")).otherwise("") for k in range(4)])
    rows = e.select("user_id", F.col("event_id").cast("int").alias("row_idx"), F.lit("data").alias("row_type"), cells.alias("cells"))
    return layout.merge_partial(rows, ["user_id"]).select("user_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query("""
WITH w AS (SELECT l_orderkey, CASE WHEN l_extendedprice < 20000 THEN 0 WHEN l_extendedprice < 60000 THEN 1 ELSE 2 END AS col_idx, l_extendedprice AS x, CAST(l_partkey AS VARCHAR) AS t, CAST(l_quantity AS INT) AS conf FROM lineitem)
SELECT l_orderkey, CAST(col_idx AS INT) AS col_idx, string_agg(t, ' ' ORDER BY x, t) AS value, CAST(trunc(avg(conf)) AS INT) AS confidence FROM w GROUP BY ALL
""")
def cells_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order as words of a line, put into the columns of a page by their place."""
    li = table(spark, sf_dir, "lineitem")
    words = li.select("l_orderkey", F.col("l_extendedprice").alias("x0"), F.col("l_partkey").cast("string").alias("text"), F.col("l_quantity").cast("int").alias("conf"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("col_idx"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for k, lo, hi in ((0, 0.0, 20_000.0), (1, 20_000.0, 60_000.0), (2, 60_000.0, 1e9))])).alias("b")
    bounds = words.select("l_orderkey").distinct().select("l_orderkey", each).select("l_orderkey", "b.*")
    return layout.cells_from_words(layout.into_columns(words, bounds, ["l_orderkey"]), ["l_orderkey"])


@query("""
WITH s AS (SELECT s_suppkey % 40 AS name, 'shipped' AS body FROM supplier WHERE s_suppkey % 3 = 0), c AS (SELECT s_suppkey % 40 AS name, 'coded' AS body FROM supplier WHERE s_suppkey % 3 = 1), u AS (SELECT s_suppkey % 40 AS name, 'user' AS body FROM supplier),
e AS (SELECT DISTINCT name, body, CASE body WHEN 'shipped' THEN CASE WHEN name IN (4, 7) THEN 9 ELSE 0 END WHEN 'coded' THEN 1 ELSE 5 END AS r FROM (SELECT * FROM s UNION ALL SELECT * FROM c UNION ALL SELECT * FROM u))
SELECT name, arg_min(body, r) AS body FROM e GROUP BY name
""")
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as settings of three layers; two names stay as coded."""
    s = table(spark, sf_dir, "supplier").withColumn("name", F.col("s_suppkey") % 40)
    layer = lambda where, body: s.where(where).select("name", F.lit(body).alias("body")).distinct()
    return logs.layered(layer("s_suppkey % 3 = 0", "shipped"), layer("s_suppkey % 3 = 1", "coded"), layer("true", "user"), "name", (4, 7))


@query("""
WITH p AS (SELECT DISTINCT p_type AS value FROM part WHERE p_size % 2 = 0), k AS (SELECT DISTINCT p_type AS value FROM part WHERE p_size < 5), c AS (SELECT DISTINCT p_type AS value FROM part WHERE p_size % 10 = 4),
m AS (SELECT value FROM p WHERE value IN (SELECT value FROM c))
SELECT value, 'known' AS state FROM (SELECT value FROM k UNION SELECT value FROM m) UNION ALL SELECT value, 'pending' FROM p WHERE value NOT IN (SELECT value FROM m) UNION ALL SELECT value, 'new' FROM m WHERE value NOT IN (SELECT value FROM k)
""")
def accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that wait for review, of which some are accepted: what is known, what still waits, and what is newly known."""
    p = table(spark, sf_dir, "part")
    values = lambda where: p.where(where).select(F.col("p_type").alias("value")).distinct()
    known, pending, new = dedup.accept_values(values("p_size % 2 = 0"), values("p_size < 5"), values("p_size % 10 = 4"), ["value"])
    named = [f.withColumn("state", F.lit(s)) for f, s in ((known, "known"), (pending, "pending"), (new, "new"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer UNION ALL SELECT -c_custkey, 'new' FROM customer WHERE c_custkey % 400 = 0
""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entries of a cache, a part of which is written anew, with some that were not there."""
    c = table(spark, sf_dir, "customer")
    rows = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("value")).unionByName(c.where("c_custkey % 400 = 0").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("new").alias("value")))
    return dedup.upsert(c.select("c_custkey", F.col("c_mktsegment").alias("value")), rows, ["c_custkey"])


@query("""
WITH c AS (SELECT p_partkey, p_brand, p_type AS value FROM part), k AS (SELECT DISTINCT upper(p_type) AS v FROM part WHERE p_size < 3)
SELECT p_partkey AS doc_id, 'dictionary' AS rule, value AS message FROM c WHERE upper(value) NOT IN (SELECT v FROM k)
UNION ALL SELECT p_brand_id, 'empty_column', 'p_blank' FROM (SELECT p_partkey AS p_brand_id FROM part WHERE p_size % 10 = 0)
""")
def controlled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that the dictionary of small parts lacks, and a mandatory column that is blank on every tenth page: two of the rules, one of them off by default."""
    p = table(spark, sf_dir, "part")
    some = F.array(F.struct(F.lit(0).alias("col_idx"), F.lit("p_type").alias("col_name"), F.col("p_type").alias("value")), F.struct(F.lit(1).alias("col_idx"), F.lit("p_blank").alias("col_name"), F.when(F.col("p_size") % 10 == 0, " ").otherwise("x").alias("value")))
    cells = p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_idx"), F.lit(0).alias("row_idx"), F.lit("data").alias("row_type"), F.explode(some).alias("c")).select("doc_id", "page_idx", "row_idx", "row_type", "c.*")
    known = p.where("p_size < 3").select(F.lit("p_type").alias("col_name"), F.col("p_type").alias("value"))
    rules = {"dictionary": lambda: quality.off_dictionary(cells, known, ["doc_id"]), "empty_column": lambda: quality.empty_columns(cells, ["p_blank"], ["doc_id"]), "continuity": lambda: cells.where("1 / 0 > 0")}
    return quality.control(rules, {"dictionary": True}).select("doc_id", "rule", "message")


@query("""
WITH a AS (SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'A  ' || n_name WHEN 1 THEN 'A' || n_name WHEN 2 THEN '' ELSE 'A ' || n_name END AS conv, 'A ' || n_name AS ref, n_nationkey % 5 AS k, n_nationkey % 2 = 0 AS strict FROM nation)
SELECT n_nationkey, CASE WHEN strict THEN 'PLAN' ELSE 'TYPE' END AS label, CASE k WHEN 1 THEN 'spacing' ELSE 'missing' END AS class FROM a WHERE k = 2 OR k = 1 AND strict
UNION ALL SELECT n_nationkey, 'MORE', 'added' FROM a WHERE k = 4
""")
def footer_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as pages with a footer of one field or two, read twice; spacing counts for one label only."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 5
    label = F.when(F.col("n_nationkey") % 2 == 0, "PLAN").otherwise("TYPE")
    ref = n.select("n_nationkey", label.alias("label"), F.concat(F.lit("A "), "n_name").alias("value"))
    conv = n.select("n_nationkey", label.alias("label"), F.when(k == 0, F.concat(F.lit("A  "), "n_name")).when(k == 1, F.concat(F.lit("A"), "n_name")).when(k == 2, "").otherwise(F.concat(F.lit("A "), "n_name")).alias("value"))
    conv = conv.unionByName(n.where(k == 4).select("n_nationkey", F.lit("MORE").alias("label"), F.lit("x").alias("value")))
    return diff.footer_gaps(ref, conv, ["n_nationkey"], ["PLAN"]).select("n_nationkey", "label", "class")


@query("""
WITH p AS (SELECT c_custkey, c_nationkey, c_mktsegment AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' ' WHEN c_custkey % 3 = 1 THEN upper(c_mktsegment) || 'x' END AS b FROM customer)
SELECT c_custkey, 'TYPE' AS label, b AS meta_value, a AS value FROM p WHERE b IS NOT NULL AND upper(replace(a, ' ', '')) <> upper(replace(b, ' ', ''))
""")
def footer_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's copied footer and its record say of one label."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    meta = F.when(k == 0, F.create_map(F.lit("TYPE"), F.concat("c_mktsegment", F.lit(" ")))).when(k == 1, F.create_map(F.lit("TYPE"), F.concat(F.upper("c_mktsegment"), F.lit("x")))).otherwise(F.create_map(F.lit("OTHER"), F.lit("y")))
    pages = c.select("c_custkey", F.create_map(F.lit("TYPE"), F.col("c_mktsegment")).alias("copied"), meta.alias("meta"))
    return pipe.footer_conflicts(pages, ["c_custkey"], "copied", "meta").select("c_custkey", "label", "meta_value", "value")


@query("""
WITH a AS (SELECT o_custkey, o_orderkey % 7 AS row_idx, o_orderkey % 3 AS col_idx, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P')
SELECT o_orderkey, chr(CAST(65 + col_idx AS INT)) || (o_custkey % 50 * 10 + row_idx) AS sheet_cell, CASE WHEN row_idx <> 3 THEN row_idx * 10 + col_idx END AS box FROM a
""")
def review_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders as alerts on the pages of customers; one row of every page has no zone."""
    o = table(spark, sf_dir, "orders")
    alerts = o.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 7).cast("int").alias("row_idx"), (F.col("o_orderkey") % 3).cast("int").alias("col_idx"), F.lit("r").alias("rule"), F.col("o_orderpriority").alias("message"), F.lit(None).cast("string").alias("proposal"))
    keys = o.select("o_custkey").distinct()
    zones = keys.select("o_custkey", F.explode(F.array(*[F.struct(F.lit(r).alias("row_idx"), F.lit(c).alias("col_idx"), F.lit(10 * r + c).cast("long").alias("box")) for r in range(7) for c in range(3) if r != 3])).alias("z")).select("o_custkey", "z.*")
    starts = keys.select("o_custkey", (F.col("o_custkey") % 50 * 10).alias("start"))
    return controls.review_points(alerts, zones, starts, ["o_custkey"]).select("o_orderkey", "sheet_cell", "box")


@query("""
SELECT p_partkey, 0 AS o0, length(p_name) AS o1, length(p_name) + length(p_type) AS o2, CASE WHEN p_size / 7.0 < 1 THEN 1 WHEN round_even(p_size / 7.0, 0) > 12 THEN 12 ELSE CAST(round_even(p_size / 7.0, 0) AS INT) END AS blanks FROM part
""")
def offsets_and_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the texts of a row start in their concatenation, and how many blanks a gap stands for."""
    p = table(spark, sf_dir, "part")
    at = controls.word_offsets(F.array("p_name", "p_type", "p_brand"))
    return p.select("p_partkey", *[F.get(at, F.lit(k)).alias(f"o{k}") for k in range(3)], layout.spacing(F.col("p_size"), F.lit(7.0)).alias("blanks"))


@query("""
SELECT p_brand, least(1.0, sum(p_size * 10.0) / max(10000.0)) AS image_share FROM part GROUP BY p_brand
""")
def image_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("w"), F.lit(10.0).alias("h"), F.lit(10_000.0).alias("page_area"))
    return layout.image_share(images, ["p_brand"])


@query("""
WITH p AS (SELECT doc_id, lang <> 'de' AS success, n_chars > 500 AS header_found, n_chars % 3 AS n_rows, n_chars AS n_cells, n_chars // 2 + n_chars % 7 * 50 AS n_readable FROM documents)
SELECT doc_id, CASE WHEN NOT success THEN 'failed' WHEN NOT header_found AND n_rows < 1 THEN 'no_table' WHEN n_rows > 0 AND coalesce(n_readable / nullif(n_cells, 0), 1.0) < 0.6 THEN 'unreadable' END AS reason FROM p
""")
def pages_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    p = table(spark, sf_dir, "documents").select("doc_id", (F.col("lang") != "de").alias("success"), (n > 500).alias("header_found"), (n % 3).alias("n_rows"), n.alias("n_cells"), (F.floor(n / 2) + n % 7 * 50).alias("n_readable"))
    return layout.kept_pages(p, 1, 0.6).select("doc_id", "reason")


@query("""
SELECT user_id, count(*) FILTER (event_type = 'view') AS done, CAST(max(event_id) AS BIGINT) AS total, round(max(value) - min(value), 6) AS elapsed FROM events GROUP BY user_id
""")
def feed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feed of pages read."""
    log = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "view", "page_read").otherwise("other").alias("type"), F.col("event_id").alias("total"), F.col("value").alias("ts"))
    return feed.progress(log, ["user_id"]).withColumn("elapsed", F.round("elapsed", 6))


@query("""
WITH r AS (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS i, p_name, p_size FROM part)
SELECT p_brand, CAST(2 * i + 1 AS INT) AS row_idx, CAST(i // 3 + 1 AS INT) AS page_idx, CASE WHEN p_size % 5 = 0 THEN 'section' WHEN p_size % 5 = 1 THEN 'footer' ELSE 'data' END AS row_type FROM r
UNION ALL SELECT p_brand, CAST(2 * i AS INT), CAST(i // 3 + 1 AS INT), CASE WHEN i % 3 = 0 THEN 'header' ELSE 'blank' END FROM r
""")
def sheet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as sheets: a header before every third row, blank rows before the others, sections and footers among the data."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").withColumn("i", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    own = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("North side"), F.lit(""))).when(F.col("p_size") % 5 == 1, F.array(F.lit("PAGE: 3"), F.lit(" "))).otherwise(F.array("p_name", "p_type"))
    before = F.when(F.col("i") % 3 == 0, F.array(F.lit(" no"), F.lit("From"))).otherwise(F.array(F.lit(""), F.lit(" ")))
    rows = p.select(F.col("p_brand").alias("file"), F.lit("s").alias("sheet"), F.explode(F.array(F.struct((2 * F.col("i")).cast("int").alias("row_idx"), before.alias("cells")), F.struct((2 * F.col("i") + 1).cast("int").alias("row_idx"), own.alias("cells")))).alias("r")).select("file", "sheet", "r.*")
    return office.pages_from_sheet(rows, ["NO", "FROM"]).select(F.col("file").alias("p_brand"), "row_idx", "page_idx", "row_type")


@query("""
WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS side, length(text) % 5 AS content FROM conversations)
SELECT conv_id, content, x.turn AS ref_idx, y.turn AS conv_idx FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, content ORDER BY turn) AS t FROM a WHERE side = 'a') x JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id, content ORDER BY turn) AS t FROM a WHERE side = 'b') y USING (conv_id, content, t)
""")
def moved_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("row_idx"), (F.length("text") % 5).cast("long").alias("content"))
    return align.moved_rows(c.where("row_idx % 2 = 0"), c.where("row_idx % 2 = 1"), ["conv_id"])
