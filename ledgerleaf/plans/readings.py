"""Queries over readings of cells, character grids, lexicons, legends and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, evaluation, grid, legend, lexicon, reading
from .registry import query, table

COLOURS = ("LAVENDER", "METALLIC", "ROSE", "LACE", "PEACH", "PUFF", "LIME", "NAVY")


@query(r"""
WITH r AS (SELECT p_partkey, '| ' || p_name || ' [O' || p_size || 'K ' || p_size || 'O7 x€ 1l' || p_size || ' ' || CASE WHEN p_size % 9 = 0 THEN '-----' ELSE '' END || ']' AS v FROM part),
a AS (SELECT p_partkey, trim(trim(trim(trim(trim(v), '|'), '['), ']')) AS v FROM r),
b AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(replace(v, '€', 'E'), '([0-9])l([0-9])', '\11\2', 'g'), '([0-9])l\b', '\11', 'g'), '\bl([0-9])', '1\1', 'g') AS v FROM a),
w AS (SELECT p_partkey, v, list_filter(string_split(v, ' '), lambda x: x <> '') AS ws FROM b)
SELECT p_partkey, CASE WHEN contains(v, '-----') THEN '' ELSE array_to_string(list_transform(ws, lambda x: CASE WHEN length(x) <= 12 AND regexp_matches(x, '[0-9]') THEN regexp_replace(regexp_replace(x, '^[Oo]([0-9])', '0\1'), '([0-9])[Oo]([0-9])', '\10\2', 'g') ELSE x END), ' ') END AS cleaned FROM w
""")
def clean_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names framed and misread as a scanner would."""
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("| "), "p_name", F.lit(" [O"), "p_size", F.lit("K "), "p_size", F.lit("O7 x€ 1l"), "p_size", F.lit(" "), F.when(F.col("p_size") % 9 == 0, "-----").otherwise(""), F.lit("]"))
    return p.select("p_partkey", reading.clean_cell(raw).alias("cleaned"))


@query("""
WITH v AS (SELECT p_partkey, replace(string_split(p_name, ' ')[1], 'O', '0') AS v FROM (SELECT p_partkey, upper(p_name) AS p_name FROM part)),
k AS (SELECT * FROM (VALUES (0, 'LAVENDER'), (1, 'METALLIC'), (2, 'ROSE'), (3, 'LACE'), (4, 'PEACH'), (5, 'PUFF'), (6, 'LIME'), (7, 'NAVY')) t(i, w)),
d AS (SELECT p_partkey, v, w, levenshtein(replace(v, '0', 'O'), w) AS d, i FROM v, k)
SELECT p_partkey, CASE WHEN arg_min(d, d * 100 + i) <= 2 THEN arg_min(w, d * 100 + i) ELSE any_value(v) END AS colour FROM d GROUP BY p_partkey
""")
def colour_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of part names, their O read as zero, set to the nearest of a format's few words."""
    p = table(spark, sf_dir, "part")
    word = F.replace(F.get(F.split(F.upper("p_name"), " "), F.lit(0)), F.lit("O"), F.lit("0"))
    return p.select("p_partkey", reading.nearest_word(word, COLOURS).alias("colour"))


CELLS = "SELECT p_partkey, 'BORNE' AS col_name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'SIGNAL', CASE WHEN p_size % 5 = 0 THEN '##' || p_type || '!?' ELSE p_name END FROM part UNION ALL SELECT p_partkey, 'COULEUR', CASE WHEN p_size % 7 = 0 THEN 'NO PLAN ' || p_type WHEN p_size % 7 = 1 THEN 'n/a' ELSE p_type END FROM part UNION ALL SELECT p_partkey, 'X', CAST(p_size AS VARCHAR) FROM part"


@query(rf"""
WITH c AS ({CELLS}), n AS (SELECT *, upper(trim(value)) AS u, trim(value) AS v, length(regexp_replace(trim(value), '[\p{{L}}\p{{N}} .\-_/:+()''"]', '', 'g')) AS noise FROM c)
SELECT p_partkey, col_name, u NOT IN ('', 'NONE', 'NONE NONE', 'N/A', 'NA', '-', '--', '0', 'O', '.')
  AND NOT regexp_matches(u, 'NOM DU CABLE|NO PLAN|P\.E\.T|M  T  I|BORNE|COULEUR|SIGNAL|JARRETIERES|INDICE|PAGE :|EPEULE|METROPOLE') AND noise <= greatest(1.0, 0.3 * length(v))
  AND CASE col_name WHEN 'BORNE' THEN regexp_full_match(v, '[A-Z0-9][A-Z0-9 \-]{{0,14}}') WHEN 'COULEUR' THEN regexp_full_match(v, '[A-Z0-9][A-Z0-9 /+\-]{{0,17}}') WHEN 'SIGNAL' THEN regexp_full_match(v, '[A-Za-z0-9 .+\-/()''"/:_*#]{{2,80}}') ELSE length(v) >= 2 END AS may FROM n
""")
def dictionary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    cells = F.array(
        F.struct(F.lit("BORNE").alias("col_name"), F.col("p_brand").alias("value")),
        F.struct(F.lit("SIGNAL").alias("col_name"), F.when(size % 5 == 0, F.concat(F.lit("##"), "p_type", F.lit("!?"))).otherwise(F.col("p_name")).alias("value")),
        F.struct(F.lit("COULEUR").alias("col_name"), F.when(size % 7 == 0, F.concat(F.lit("NO PLAN "), "p_type")).when(size % 7 == 1, "n/a").otherwise(F.col("p_type")).alias("value")),
        F.struct(F.lit("X").alias("col_name"), size.cast("string").alias("value")),
    )
    each = p.select("p_partkey", F.explode(cells).alias("c")).select("p_partkey", "c.*")
    return each.select("p_partkey", "col_name", reading.may_be_known(F.col("col_name"), F.col("value")).alias("may"))


@query("""
SELECT p_partkey, 0 AS line, rtrim(rpad(p_name, p_size + 60, ' ') || p_type) AS text FROM part UNION ALL SELECT p_partkey, 1, '  ' || p_brand || ' x' FROM part
""")
def character_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a page of signs: name and type on one line, the type a little lower, the brand below, two columns in."""
    p = table(spark, sf_dir, "part")

    def span(number: int, text: F.Column, column: F.Column, y: float) -> F.Column:
        return F.struct(F.lit(number).alias("span"), text.alias("text"), column.cast("int").alias("column"), F.lit(y).alias("y"))

    spans = p.select("p_partkey", F.explode(F.array(span(0, F.col("p_name"), F.lit(0), 10.0), span(1, F.col("p_type"), F.col("p_size") + 60, 11.5), span(2, F.concat("p_brand", F.lit(" x")), F.lit(2), 30.0))).alias("s")).select("p_partkey", "s.*")
    signs = spans.select("p_partkey", "span", "y", "column", F.posexplode(F.split("text", "")).alias("seq", "sign")).where("sign <> ''")
    return grid.grid_lines(signs.select("p_partkey", "span", "seq", ((F.col("column") + F.col("seq")) * 5.25 + 40).alias("x"), "y", "sign"), ["p_partkey"])


@query("""
SELECT p_brand, CAST(p_partkey + 1 AS INT) AS line, 'data' AS row_type, CASE WHEN p_size % 7 = 0 THEN p_name || ' ' || p_type || ' ' || p_size || ' more' ELSE p_name END AS c0, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type END AS c1, CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS c2, p_size % 7 = 0 AS unsplit FROM part
""")
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as framed pages; every seventh line has a cell too many."""
    p = table(spark, sf_dir, "part")
    more = F.when(F.col("p_size") % 7 == 0, "| more |").otherwise("|")
    line = p.select("p_brand", (F.col("p_partkey") + 1).cast("int").alias("line"), F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_type", F.lit(" | "), "p_size", F.lit(" "), more).alias("text"))
    head = p.select("p_brand").distinct().select("p_brand", F.lit(-2).alias("line"), F.lit("| NAME | KIND | SIZE |").alias("text"))
    rule = head.select("p_brand", F.lit(-1).alias("line"), F.lit("|------|------|------|").alias("text"))
    end = head.select("p_brand", F.lit(1 << 30).alias("line"), F.lit("| PAGE: 1 |").alias("text"))
    rows = grid.rows_of_grid(line.unionByName(head).unionByName(rule).unionByName(end), ["p_brand"], ["NAME", "KIND", "SIZE"], F.lit(False), F.contains("text", F.lit("PAGE:")))
    return rows.select("p_brand", "line", "row_type", *[F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(3)], "unsplit")


@query("""
WITH c AS (SELECT event_id, k AS rank, CASE WHEN k = 0 AND event_type IN ('error', 'click') THEN [0.0, value] WHEN k = 1 AND event_type = 'click' THEN [0.0, 90.0, value] ELSE [0.0, 50.0, 100.0 + k] END AS b, CASE WHEN k = 0 THEN value / 100 ELSE 1.0 END AS score FROM events, (VALUES (0), (1), (2)) t(k))
SELECT event_id, 'm' || min(rank) AS method, CAST(arg_min(b[3], rank) AS DOUBLE) AS last FROM c WHERE len(b) = 3 AND b[2] < b[3] AND b[1] < b[2] AND score >= 0.1 GROUP BY event_id
""")
def bounds_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three detectors for each event's columns: some find too few, some find falling ones, some are unsure."""
    e = table(spark, sf_dir, "events").withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k, v = F.col("rank"), F.col("value").cast("double")
    bounds = F.when((k == 0) & F.col("event_type").isin("error", "click"), F.array(F.lit(0.0), v)).when((k == 1) & (F.col("event_type") == "click"), F.array(F.lit(0.0), F.lit(90.0), v)).otherwise(F.array(F.lit(0.0), F.lit(50.0), 100.0 + k))
    c = e.select("event_id", "rank", F.concat(F.lit("m"), k).alias("method"), bounds.alias("bounds"), F.when(k == 0, v / 100).otherwise(1.0).alias("score"))
    return grid.first_bounds(c, ["event_id"], 2, 0.1).select("event_id", "method", F.element_at("bounds", -1).alias("last"))


@query("""
WITH d AS (SELECT p_partkey, replace(p_name, ' ', '') AS a, CASE WHEN p_size % 4 = 0 THEN p_name || ' x' WHEN p_size % 4 = 1 THEN '  ' ELSE replace(p_name, ' ', '   ') || '  ' END AS b FROM part)
SELECT p_partkey, CASE WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN rtrim(b) ELSE a END AS value, replace(a, ' ', '') = replace(b, ' ', '') AS moved FROM d
""")
def spacing_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names delivered without blanks, and a reading that has them."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_size") % 4
    spaced = F.when(k == 0, F.concat("p_name", F.lit(" x"))).when(k == 1, "  ").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit("  ")))
    return align.transfer_spacing(p.select("p_partkey", F.replace("p_name", F.lit(" ")).alias("value")), p.select("p_partkey", spaced.alias("value")), ["p_partkey"])


@query("""
WITH n AS (SELECT DISTINCT 'BORNE' AS "column", p_type AS value FROM part WHERE p_size % 6 <> 0 UNION SELECT DISTINCT 'SIGNAL', p_name FROM part WHERE p_size % 6 <> 0),
k AS (SELECT 'SIGNAL' AS "column", p_name AS value FROM part WHERE p_size < 10)
SELECT "column", count(*) AS n FROM n ANTI JOIN k USING ("column", value) GROUP BY "column"
""")
def sheet_new_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as sheets with a header; every sixth row is a special one; names of small parts wait already."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_brand", F.col("p_partkey").cast("int").alias("row_idx"), F.array(F.when(F.col("p_size") % 6 == 0, "NO PLAN").otherwise(F.lit("")), "p_name", "p_type").alias("cells"))
    head = p.select("p_brand").distinct().select("p_brand", F.lit(-1).alias("row_idx"), F.array(F.lit("N"), F.lit("Signal"), F.lit("BORNE")).alias("cells"))
    pending = p.where("p_size < 10").select(F.lit("signal").alias("column"), F.col("p_name").alias("value"))
    return lexicon.counts_per_column(lexicon.new_values(rows.unionByName(head), ["p_brand"], pending))


@query("""
WITH l AS (SELECT DISTINCT o_orderpriority AS source, o_custkey AS form FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'), i AS (SELECT DISTINCT o_orderpriority AS source, o_custkey AS form FROM orders WHERE o_orderstatus <> 'F')
SELECT source, CASE WHEN source IN (SELECT source FROM l) THEN 'replaced' ELSE 'added' END AS state, count(*) AS forms, count(*) FILTER (NOT EXISTS (SELECT 1 FROM l WHERE l.form = i.form AND l.source <> i.source)) AS added FROM i GROUP BY source
""")
def lexicon_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as reference workbooks, customers as their forms."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("form"))
    return lexicon.added_sources(o.where("o_orderstatus = 'F' AND source <> '5-LOW'"), o.where("o_orderstatus <> 'F'"), replace=True)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS source, sha256(coalesce(text, '')) AS fingerprint, array_to_string(list_sort(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[A-Z0-9]{4,}'))), ' ') AS forms FROM documents
""")
def lexicon_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    forms = F.regexp_extract_all(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("[A-Z0-9]{4,}"), F.lit(0))
    return lexicon.compiled(d, forms, F.col("text")).withColumn("forms", F.array_join("forms", " "))


@query("""
WITH s AS (SELECT o_custkey AS batch, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'sent' ELSE 'open' END AS state, o_orderkey AS "at" FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY (state = 'done') DESC, "at" DESC) AS p FROM s)
SELECT batch, state, "at" FROM r WHERE p = 1
""")
def batch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as states of their customer's batch, written in two parts: what is done stays done."""
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "sent").otherwise("open")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), state.alias("state"), F.col("o_orderkey").alias("at"))
    return lexicon.record_states(o.where("at % 2 = 0"), o.where("at % 2 = 1"))


@query("""
WITH t AS (SELECT s_suppkey AS name, s_nationkey AS body, s_nationkey < 5 AS shipped FROM supplier), n AS (SELECT s_suppkey AS name, s_nationkey + 100 AS body FROM supplier WHERE s_suppkey % 3 = 0)
SELECT name, coalesce(n.body, t.body) AS body FROM t LEFT JOIN n USING (name) WHERE NOT shipped AND name % 4 <> 0
""")
def templates_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as templates: every third is put anew, every fourth deleted, shipped ones cannot be and are not saved."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_nationkey").alias("body"), (F.col("s_nationkey") < 5).alias("shipped"))
    put = lexicon.put_named(t, t.where("name % 3 = 0").select("name", (F.col("body") + 100).alias("body")))
    return lexicon.saved(lexicon.without_named(put, t.where("name % 4 = 0"))).select("name", "body")


@query("""
WITH r AS (SELECT p_brand, p_partkey * 20 AS y, p_type AS code, p_name AS label, 'size ' || p_size || ' — ' || CAST(p_partkey AS VARCHAR) AS description FROM part)
SELECT p_brand, code, label, description FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, code ORDER BY y) AS p FROM r) WHERE p = 1
""")
def legend_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as drawings with a legend of four columns under a heading."""
    p = table(spark, sf_dir, "part")
    cell = lambda x, text: F.struct(F.lit(x).alias("x"), text.cast("string").alias("text"))
    cells = F.array(cell(10.0, F.col("p_type")), cell(120.0, F.col("p_name")), cell(300.0, F.concat(F.lit(" size  "), "p_size")), cell(420.0, F.col("p_partkey")))
    words = p.select("p_brand", (F.col("p_partkey") * 20).cast("double").alias("y"), F.explode(cells).alias("c")).select("p_brand", "y", "c.*")
    head = p.select("p_brand").distinct().select("p_brand", F.lit(-100.0).alias("y"), F.explode(F.array(cell(10.0, F.lit("Code")), cell(120.0, F.lit("Name")))).alias("c")).select("p_brand", "y", "c.*")
    every = words.unionByName(head)
    pages = legend.table_pages(every, ["p_brand"], 1, 2).select("p_brand")
    return legend.legend_rows(every.join(pages, "p_brand", "left_semi"), ["p_brand"]).select("p_brand", "code", "label", "description")


ALERTS = """
WITH c AS (SELECT l_orderkey AS doc, l_suppkey % 4 AS page, l_linenumber AS "row", l_partkey % 3 AS col, l_quantity AS q, l_returnflag AS flag FROM lineitem),
a AS (SELECT DISTINCT doc, CASE WHEN q > 45 THEN NULL ELSE page END AS page, CASE WHEN q > 30 THEN NULL ELSE "row" END AS "row", col, flag AS rule FROM c WHERE q > 10),
w AS (SELECT DISTINCT doc, page, "row", col FROM c WHERE flag <> 'N' AND q < 25), u AS (SELECT DISTINCT doc, page, col FROM c WHERE q > 38)
"""


def known_errors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items as cells: alerts of some, what is wrong, and columns that are."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 4).alias("page"), F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 3).alias("col"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("rule"))
    alerts = c.where("q > 10").select("doc", F.when(F.col("q") <= 45, F.col("page")).alias("page"), F.when(F.col("q") <= 30, F.col("row")).alias("row"), "col", "rule").distinct()
    return alerts, c.where("rule <> 'N' AND q < 25").select("doc", "page", "row", "col").distinct(), c.where("q > 38").select("doc", "page", "col").distinct()


@query(ALERTS + """
SELECT doc, rule, CAST(sum(CASE WHEN r THEN 1 ELSE 0 END) AS BIGINT) AS "right", CAST(sum(CASE WHEN r THEN 0 ELSE 1 END) AS BIGINT) AS "false" FROM (
  SELECT a.*, CASE WHEN a.page IS NULL THEN false WHEN a."row" IS NULL THEN EXISTS (SELECT 1 FROM u WHERE u.doc = a.doc AND u.page = a.page AND u.col = a.col) ELSE EXISTS (SELECT 1 FROM w WHERE w.doc = a.doc AND w.page = a.page AND w."row" = a."row" AND w.col = a.col) END AS r FROM a) GROUP BY doc, rule
""")
def alert_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.alert_quality(*known_errors(spark, sf_dir), ["doc"])


@query(ALERTS + """SELECT doc, page, "row", col FROM w WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = w.doc AND a.page = w.page AND a."row" = w."row" AND a.col = w.col)""")
def missed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts, wrong, _ = known_errors(spark, sf_dir)
    return evaluation.missed_errors(wrong, alerts, ["doc"])


@query("""
WITH p AS (SELECT o_custkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(round(o_totalprice) AS BIGINT) % 5 END AS counted, o_orderkey % 5 AS read, o_orderstatus = 'P' AS scanned FROM orders)
SELECT o_custkey, count(*) AS pages, count(*) FILTER (counted <> read) AS false_alerts, count(*) FILTER (counted IS NULL) AS impossible, count(*) FILTER (counted IS NULL AND scanned) AS impossible_scans, count(*) FILTER (counted <> read - 1) AS losses_found FROM p GROUP BY o_custkey
""")
def counter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = o.select("o_custkey", F.when(F.col("o_orderkey") % 6 != 0, F.round("o_totalprice").cast("long") % 5).alias("counted"), (F.col("o_orderkey") % 5).alias("read"), (F.col("o_orderstatus") == "P").alias("scanned"))
    return evaluation.counter_audit(p, ["o_custkey"])


@query(r"""
WITH c AS (SELECT p_type, p_partkey, upper(CASE WHEN p_partkey % 40 = 7 THEN translate(p_brand, 'B', '8') WHEN p_partkey % 40 = 9 THEN replace(p_brand, 'and', 'aand') ELSE p_brand END) AS v FROM part),
f AS (SELECT p_type, p_partkey, unnest(regexp_extract_all(v, '[A-Z0-9][A-Z0-9''"_/.-]{2,}')) AS form FROM c),
n AS (SELECT p_type, form, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT p_type, form, n, unnest(range(1, length(form) + 1)) AS i FROM n),
q AS (SELECT x, y FROM (VALUES ('1','I'),('1','L'),('I','L'),('0','O'),('0','D'),('O','D'),('5','S'),('8','B'),('2','Z'),('6','G'),('P','F'),('R','K'),('E','F'),('C','G'),('H','K'),('U','V'),('V','Y'),('7','T'),('M','N')) t(x, y) UNION ALL SELECT y, x FROM (VALUES ('1','I'),('1','L'),('I','L'),('0','O'),('0','D'),('O','D'),('5','S'),('8','B'),('2','Z'),('6','G'),('P','F'),('R','K'),('E','F'),('C','G'),('H','K'),('U','V'),('V','Y'),('7','T'),('M','N')) t(x, y)),
v AS (SELECT p_type, form, n, form[:i - 1] || y || form[i + 1:] AS better FROM s JOIN q ON form[i] = x UNION ALL SELECT p_type, form, n, form[:i - 1] || form[i + 1:] FROM s),
b AS (SELECT v.p_type, v.form, max(struct_pack(m := m.n, better := v.better)) AS b FROM v JOIN n m ON m.p_type = v.p_type AND m.form = v.better WHERE m.n >= 2 AND m.n >= 1.5 * v.n AND v.better <> v.form GROUP BY v.p_type, v.form)
SELECT DISTINCT p_type, p_partkey, form, b.better AS better FROM f JOIN b USING (p_type, form)
""")
def suspect_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 40
    cells = p.select("p_type", "p_partkey", F.when(k == 7, F.translate("p_brand", "B", "8")).when(k == 9, F.replace("p_brand", F.lit("and"), F.lit("aand"))).otherwise(F.col("p_brand")).alias("value"))
    return evaluation.suspect_codes(cells, ["p_type"], "p_partkey")


@query("""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE turn % 2 = 0),
m AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations WHERE turn % 2 = 1),
x AS (SELECT conv_id, turn, t, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM l WHERE trim(t) <> '' WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
y AS (SELECT conv_id, turn - 1 AS turn, i, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM m)
SELECT conv_id, turn, i - 1 AS image, t AS text FROM x JOIN y USING (conv_id, turn, k, n)
""")
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of even turns with the lines of the next turn as their images, where there are as many."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("rank", "text"))
    images = c.where("turn % 2 = 1").select("conv_id", (F.col("turn") - 1).alias("turn"), "rank", F.col("rank").cast("long").alias("image"))
    return evaluation.training_pairs(c.where("turn % 2 = 0").withColumnRenamed("rank", "line"), images, ["conv_id", "turn"])
