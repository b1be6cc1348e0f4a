import json

from pyspark.sql import functions as F

from ledgerleaf.sources import logs, office, pipe
from ledgerleaf.streaming import events


def test_logs(spark, tmp_path):
    good = [{"image": "a.png", "id": "1", "success": True, "usage": {"input_tokens": 5, "output_tokens": 2}}, {"image": "b.png", "id": "2", "success": False, "error": "non-listing"}, {"id": "3", "success": False, "error": "x"}]
    (tmp_path / "x_log.jsonl").write_text("\n".join([json.dumps(good[0]), "", "{broken", json.dumps(good[1]), json.dumps(good[2])]))
    log = logs.read_log(spark, str(tmp_path))
    assert log.count() == 3
    total = logs.log_totals(log.withColumn("g", F.lit(1)), ["g"]).first()
    assert (total.entries, total.input_tokens, total.ids, total.errors) == (2, 5, ["1", "2"], 0)
    logs.append_history(log.select("id"), str(tmp_path / "h"))
    logs.append_history(log.select("id", F.lit(1).alias("extra")), str(tmp_path / "h"))
    assert logs.read_history(spark, str(tmp_path / "h")).columns == ["id", "extra"]
    df = spark.createDataFrame([("a.PDF",), ("dir",), ("x.jsonl",)], "p string")
    assert [r.v for r in df.select(logs.route(F.col("p")).alias("v")).collect()] == ["pdf", "folder", "log"]


RAW = """TYPE_PAGE: listing
SECTION: North side
a | b | c | d
a | b | x | y | z
short
e | f
META: noise {"PAGE": "7", "TYPE": "K2 left part"} more
N° PLAN: 7 | INDICE: B | |
 | | |
REVISIONS: A first"""


def test_pipe(spark):
    df = spark.createDataFrame([(1, RAW), (2, None), (3, "META: {broken")], "k int, raw string")
    lines = pipe.lines_of(df, ["k"])
    rows = pipe.parse_rows(lines, ["k"], 4).orderBy("line_idx").collect()
    assert [(r.row_type, r.cells) for r in rows] == [("section", []), ("data", ["a", "b", "c", "d"]), ("data", ["a", "b", "x y", "z"]), ("data", ["e", "f", "", ""])]
    meta = {r.k: r.meta for r in pipe.parse_meta(lines, ["k"]).collect()}
    assert meta == {1: {"PAGE": "7", "TYPE": "K2 left part"}, 3: {}}
    assert pipe.off_columns(lines, ["k"], 4).first().n == 4
    assert pipe.ambiguous(lines, ["k"], 4).first().body == "a | b | x | y | z"
    assert pipe.revision_codes(lines, ["k"]).first().codes == ["A"]
    state, cells = pipe.repair(F.col("b"), 3)
    got = spark.createDataFrame([("a|b|c",), ("a|b|c|d",), ("a|b",), ("a",)], "b string").select(state.alias("s"), cells.alias("c")).collect()
    assert [(r.s, r.c) for r in got] == [("accepted", ["a", "b", "c"]), ("repaired", ["a", "b", "c d"]), ("repaired", ["a", "b", "[INCOMPLETE]"]), ("rejected", ["a", "[INCOMPLETE]", "[INCOMPLETE]"])]


def test_footers(spark):
    df = spark.createDataFrame([("TYPE: K2 left CABLE : x y TYPE: K3 right",)], "t string")
    m = df.select(pipe.footer_pairs(F.col("t"), ["TYPE", "CABLE"]).alias("last"), pipe.footer_pairs(F.col("t"), ["TYPE", "CABLE"], last_wins=False).alias("first")).first()
    assert (m.last, m["first"]) == ({"CABLE": "x y", "TYPE": "K3 right"}, {"TYPE": "K2 left", "CABLE": "x y"})
    both = spark.createDataFrame([(1, {"TYPE": "K2 left"}, {"TYPE": "K2  LEFT", "PAGE": "1"}), (2, {"PAGE": "1"}, {"PAGE": "2"})], "k int, copied map<string,string>, meta map<string,string>")
    assert [(r.k, r.label) for r in pipe.footer_conflicts(both, ["k"], "copied", "meta").collect()] == [(2, "PAGE")]
    r = both.where("k = 1").select(pipe.split_type(F.col("copied")).alias("s"), pipe.merge_footer(F.col("copied"), F.col("meta")).alias("m")).first()
    assert (r.s, r.m) == ({"TYPE": "K2", "COMPLEMENT": "left"}, {"TYPE": "K2 left", "PAGE": "1"})


def test_workbooks(spark, tmp_path):
    rows = [["NO", "FROM"], ["1", "é & <x>"], ["North"], ["PAGE: 7"], ["NO", "FROM"], ["2", ""]]
    df = spark.createDataFrame([("d", "S1", k, r) for k, r in enumerate(rows)], "doc string, sheet string, row_idx int, cells array<string>")
    content = office.workbooks(df, "doc", "sheet", "row_idx").first().content
    (tmp_path / "d.xlsx").write_bytes(content)
    got = office.pages_from_sheet(office.read_workbooks(spark, str(tmp_path)), ["NO", "FROM"]).orderBy("row_idx").collect()
    assert [(r.page_idx, r.row_type) for r in got] == [(1, "header"), (1, "data"), (1, "section"), (1, "footer"), (2, "header"), (2, "section")]
    assert got[1].cells == ["1", "é & <x>"]


def test_word_tables():
    import io
    import zipfile

    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('c')}{cell('')}</w:tr></w:tbl></w:body></w:document>")
        z.writestr("word/media/i.png", b"png")
    assert list(office.word_tables(out.getvalue())) == [(0, 0, ["a", "b"]), (0, 1, ["c", ""])]
    assert list(office.word_images(out.getvalue())) == [("i.png", b"png")]


def test_streams(spark, tmp_path):
    src, ck, out = (str(tmp_path / x) for x in ("src", "ck", "out"))
    row = lambda i, ok, ts: {"id": i, "image": i[0], "success": ok, "raw": i, "ts": ts}
    schema = "id string, image string, success boolean, raw string, ts double"
    write = lambda name, rows: (tmp_path / "src").mkdir(exist_ok=True) or (tmp_path / "src" / name).write_text("\n".join(map(json.dumps, rows)))
    write("1.json", [row("a1", True, 1.0), row("a1", True, 1.0), row("b1", False, 2.0)])
    keep = lambda df, n: df.write.mode("append").parquet(out)
    feed = events.once_per_id(events.read_events(spark, src, schema), "id")
    events.run_available(feed, ck, keep)
    write("2.json", [row("a1", True, 3.0), row("c1", True, 4.0)])
    events.run_available(feed, ck, keep)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a1", "b1", "c1"]
    best = []
    events.run_available(events.last_success(events.read_events(spark, src, schema), "image"), str(tmp_path / "ck2"), lambda df, n: best.extend(df.collect()), "update")
    assert {(r.key, r.raw) for r in best} >= {("b", "b1"), ("c", "c1")}
    done = events.progress(spark.createDataFrame([("d", "page_read", 2, 1.0), ("d", "page_read", 2, 4.0)], "doc string, type string, total int, ts double"), ["doc"]).first()
    assert (done.done, done.total, done.elapsed) == (2, 2, 3.0)


def test_open_footers(spark):
    from ledgerleaf.sources import footer

    lines = ["|-----|", "| N O R D A | CABLE : ACC/PH01 12 8/10 | TYPE : K2 left |", "N° PLAN : 223 INDICE: B PAGE 32", "CABLE : other"]
    clean, logo = footer.split_logo(lines)
    assert logo == "N O R D A" and clean[0].startswith("CABLE")
    got = footer.read_footer(clean)
    assert got == {"CABLE": "ACC/PH01", "TYPE": "K2", "NO_PLAN": "223", "INDICE": "B", "PAGE": "32", "COMPLEMENT": "12 8/10 left"}
    assert footer.read_footer(["P.E.T. : 12 8/10   RACK 7"]) == {"PET": "12", "COMPLEMENT": "8/10", "EMPLACEMENT_BORNIER": "RACK 7"}
    df = spark.createDataFrame([(lines,), (None,), ([],)], "l array<string>")
    assert [r.m for r in df.select(footer.footer_map(F.col("l")).alias("m")).collect()] == [got | {"LOGO": "N O R D A"}, {}, {}]
