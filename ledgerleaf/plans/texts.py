"""Queries over texts: words, lexicons, similarity, alignment, page and document matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import align, dedup, quality
from .registry import query, table


def ascii_words(c: F.Column) -> F.Column:
    """Words of letters a to z after lower-casing A to Z."""
    return F.regexp_extract_all(F.translate(text.filled(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z]+"), F.lit(0))


SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')"


@query(f"""
WITH b AS (SELECT DISTINCT unnest({SQL_WORDS}) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({SQL_WORDS}) AS w FROM documents)
SELECT doc_id, count(*) AS unknown FROM d ANTI JOIN b USING (w) GROUP BY doc_id
""")
def lexicon_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda t, *k: table(spark, sf_dir, t).select(*k, F.explode(F.array_distinct(ascii_words(F.col("text")))).alias("w"))
    return words("documents", "doc_id").join(words("benchmark").distinct(), "w", "left_anti").groupBy("doc_id").agg(F.count("*").alias("unknown"))


@query("""
WITH c AS (SELECT 'p_brand' AS col_name, upper(p_brand) AS v FROM part UNION ALL SELECT 'p_type', upper(p_type) FROM part UNION ALL SELECT 'p_name', upper(p_name) FROM part),
f AS (SELECT col_name, unnest(list_distinct(list_filter(list_concat([v], string_split(v, ' ')), lambda x: length(x) >= 4))) AS form FROM c)
SELECT col_name, form, count(*) AS n FROM f GROUP BY ALL
""")
def form_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cells import part_cells

    return quality.cell_forms(part_cells(spark, sf_dir), ["col_name"]).groupBy("col_name", "form").agg(F.count("*").alias("n"))


@query("""
WITH c AS (SELECT p_partkey, upper(CASE WHEN p_partkey % 50 = 7 THEN translate(p_brand, 'B', '8') ELSE p_brand END) AS v FROM part),
f AS (SELECT p_partkey, unnest(list_distinct(list_filter(list_concat([v], string_split(v, ' ')), lambda x: length(x) >= 4))) AS form FROM c),
n AS (SELECT form, count(*) AS n FROM f GROUP BY form),
s AS (SELECT form, n, unnest(range(1, length(form) + 1)) AS i FROM n),
v AS (SELECT form, n, p.x || p.y AS pair, form[:i - 1] || p.y || form[i + 1:] AS variant FROM s JOIN (VALUES ('O','C'),('C','O'),('O','0'),('0','O'),('I','1'),('1','I'),('S','5'),('5','S'),('B','8'),('8','B')) p(x, y) ON form[i] = p.x),
b AS (SELECT v.form, max(struct_pack(m := m.n, variant := v.variant, pair := v.pair)) AS best FROM v JOIN n m ON m.form = v.variant WHERE m.n >= 2 AND m.n >= 1.5 * v.n GROUP BY v.form)
SELECT CAST(p_partkey AS INT) AS row_idx, form || ' -> ' || best.variant AS message, best.variant AS proposal, best.pair AS pair FROM (SELECT p_partkey, form, best, row_number() OVER (PARTITION BY p_partkey ORDER BY length(form) DESC, form) AS p FROM f JOIN b USING (form)) WHERE p = 1
""")
def coherence_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cells = p.select(F.lit(0).alias("page_idx"), F.col("p_partkey").cast("int").alias("row_idx"), F.lit(0).alias("col_idx"), F.when(F.col("p_partkey") % 50 == 7, F.translate("p_brand", "B", "8")).otherwise(F.col("p_brand")).alias("value"))
    return quality.coherence(cells, []).select("row_idx", "message", "proposal", "pair")


@query(f"""
WITH w AS (SELECT conv_id, turn AS rank, list_distinct({SQL_WORDS}) AS ws FROM conversations),
a AS (SELECT conv_id, rank, unnest(ws) AS word, len(ws) AS n FROM w WHERE rank % 2 = 0), b AS (SELECT conv_id, rank, unnest(ws) AS word, len(ws) AS n FROM w WHERE rank % 2 = 1),
j AS (SELECT a.conv_id, a.rank AS a, b.rank AS b, count(*) / (a.n + b.n - count(*)) AS jaccard FROM a JOIN b USING (conv_id, word) GROUP BY a.conv_id, a.rank, b.rank, a.n, b.n)
SELECT conv_id, a, b, round(jaccard, 9) AS jaccard, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, a ORDER BY jaccard DESC, abs(a - b), b) AS INT) AS place FROM j) WHERE place <= 3
""")
def jaccard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as pages of two readings: for each even turn the three odd turns most like it."""
    a, b = turn_pages(spark, sf_dir)
    return align.candidates(a, b, ["conv_id"]).withColumn("jaccard", F.round("jaccard", 9))


def turn_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("rank"), F.array_distinct(ascii_words(F.col("text"))).alias("words"))
    return pages.where("rank % 2 = 0"), pages.where("rank % 2 = 1")


@query()
def page_match_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as pages of two readings, the second in another order and with misread rows."""
    a, b = order_pages(spark, sf_dir)
    return align.match_pages(a, b.withColumn("rank", -F.col("rank")), ["o_custkey"]).withColumn("similarity", F.round("similarity", 9))


@query()
def page_match_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of two hundred rows on ten pages; the second reading misses pages and misreads names."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 200).alias("doc"), (F.col("p_size") % 10).alias("rank"), "p_partkey", "p_name")

    def pages(name: F.Column) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("p_partkey", name.alias("line"))))
        return p.groupBy("doc", "rank").agg(F.transform(rows, lambda r: r["line"]).alias("lines"))

    misread = F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", "lo", "10")).otherwise(F.col("p_name"))
    return align.match_pages_ordered(pages(F.col("p_name")), pages(misread).where("(doc + rank) % 5 <> 0"), ["doc"])


@query()
def row_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order paired between unique equal keys; the second reading lost and misread some."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("row_idx")).agg(F.max(F.col("l_partkey").cast("string")).alias("row_key"))
    other = li.where("(l_orderkey + row_idx) % 7 <> 0").withColumn("row_key", F.when(F.col("row_idx") % 3 == 0, F.translate("row_key", "17", "71")).otherwise(F.col("row_key")))
    return align.anchored_rows(li, other, ["l_orderkey"])


def order_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    misread = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_partkey") + 1).otherwise(F.col("l_partkey"))

    def pages(part: F.Column, rank: F.Column) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat_ws(" ", part, "l_suppkey").alias("line"))))
        return li.groupBy("o_custkey", rank.alias("rank")).agg(F.collect_set(part.cast("string")).alias("words"), F.transform(rows, lambda r: r["line"]).alias("lines"))

    return pages(F.col("l_partkey"), F.col("l_orderkey")), pages(misread, F.col("l_orderkey"))


def paired_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as rows of cells, and a second reading that lost, gained and misread some."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(text.filled(F.col("text")), "\n")).alias("row_idx", "line"))
    ref = d.select("doc_id", "row_idx", text.words(F.col("line")).alias("cells"))
    conv = ref.where("(doc_id + row_idx) % 11 <> 0").withColumn("cells", F.when(F.col("row_idx") % 5 == 1, F.transform("cells", lambda c: F.translate(c, "OI", "01"))).otherwise(F.col("cells")))
    return ref, conv


@query()
def row_alignment_optimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every document aligned with its second reading."""
    ref, conv = paired_rows(spark, sf_dir)
    got = align.compare_rows(ref, conv, ["doc_id"])
    return got.groupBy("doc_id").agg(F.sum((F.col("class").isNull()).cast("int")).alias("lone"), F.sum((F.col("class") == "identical").cast("int")).alias("identical"), F.sum((F.col("class") == "confusion").cast("int")).alias("confusion"), F.count("*").alias("cells"))


@query(f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents), e AS (SELECT a.doc_id, a.w AS x, b.w AS y FROM d a JOIN d b ON b.doc_id = a.doc_id + 1),
x AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(x) AS w FROM e) GROUP BY ALL), y AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(y) AS w FROM e) GROUP BY ALL)
SELECT doc_id, CAST(sum(greatest(x.n - coalesce(y.n, 0), 0)) AS BIGINT) AS lost FROM x LEFT JOIN y USING (doc_id, w) GROUP BY doc_id
""")
def multiset_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a document beyond their count in the next one: bags as counts, joined by word."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(ascii_words(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"))
    left = words.join(ids, "doc_id", "left_semi").alias("a")
    right = words.select((F.col("doc_id") - 1).alias("doc_id"), "w", F.col("n").alias("m"))
    return left.join(right, ["doc_id", "w"], "left").groupBy("doc_id").agg(F.sum(F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))).alias("lost"))


@query(f"""
WITH t AS (SELECT lang AS type, w, count(*) AS n FROM (SELECT lang, unnest(list_distinct({SQL_WORDS})) AS w FROM documents) GROUP BY ALL),
k AS (SELECT type, w FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, w) AS p FROM t) WHERE p <= 20),
d AS (SELECT DISTINCT doc_id, unnest({SQL_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, type, count(*) AS score FROM d JOIN k USING (w) GROUP BY ALL)
SELECT doc_id, type, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type) AS p FROM s) WHERE p = 1
""")
def type_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored against a token dimension: the twenty commonest words of each type."""
    d = table(spark, sf_dir, "documents")
    words = d.select("doc_id", F.col("lang").alias("type"), F.explode(F.array_distinct(ascii_words(F.col("text")))).alias("w"))
    counts = words.groupBy("type", "w").agg(F.count("*").alias("n"))
    known = counts.withColumn("p", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "w"))).where("p <= 20").select("type", "w")
    scores = words.select("doc_id", "w").join(F.broadcast(known), "w").groupBy("doc_id", "type").agg(F.count("*").alias("score"))  # twenty words a type
    return scores.withColumn("p", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "type"))).where("p = 1").drop("p")


@query("SELECT p_partkey, upper(regexp_replace(p_name, '\\s', '', 'g')) AS compact, translate(upper(regexp_replace(p_name, '\\s', '', 'g')), 'OILS7BZ,', '0115T82.') AS folded, levenshtein(p_name, p_type) AS distance, p_size AS number FROM part")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.compact(F.col("p_name")).alias("compact"), text.fold(F.col("p_name")).alias("folded"), F.levenshtein("p_name", "p_type").cast("long").alias("distance"), text.numbered(F.concat(F.col("p_name"), F.lit(" "), F.col("p_size")))["number"].alias("number"))


@query("""
WITH w AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, w[1] || repeat(' ', greatest(p_size - length(w[1]), 1)) || w[2] AS placed, 0 AS start0, greatest(p_size, length(w[1]) + 1) AS start1 FROM w
""")
def placed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words placed at character columns, and their starts read back."""
    p = table(spark, sf_dir, "part")
    placed = p.select("p_partkey", text.placed(F.col("p_name"), F.array(F.lit(0), F.col("p_size"))).alias("placed"))
    at = text.starts(F.col("placed"))
    return placed.select("p_partkey", "placed", F.get(at, F.lit(0)).alias("start0"), F.get(at, F.lit(1)).alias("start1"))


@query("""
WITH s AS (SELECT source, array_to_string(list_sort(list_distinct(list(lang))), '|') AS s FROM documents GROUP BY source)
SELECT source AS name, min(source) OVER (PARTITION BY s) AS first, CAST(count(*) OVER (PARTITION BY s) AS BIGINT) AS n FROM s QUALIFY count(*) OVER (PARTITION BY s) > 1
""")
def same_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return dedup.same_signature(types, "source", "langs")


@query("SELECT CASE WHEN url LIKE '%.pdf' THEN 'pdf' ELSE 'other' END AS kind, regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL HAVING count(*) > 1")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.when(F.endswith("url", F.lit(".pdf")), "pdf").otherwise("other").alias("kind"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n")).where("n > 1")
