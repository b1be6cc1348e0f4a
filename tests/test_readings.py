"""Cells, character grids, lexicons, legends and evaluations on small cases."""

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import evaluation, grid, legend, lexicon, reading


@pytest.mark.parametrize("raw, want", [("| [O1K] |", "[O1K]"), ("|[O1K]|", "01K"), ("O1K", "01K"), ("1O2 O O3O", "102 O 03O"), ("1l2 l3 4l", "112 13 41"), ("3°5 °", "305 °"), ("€12£", "E12E"), ("-----", ""), ("aaaaab", ""), ("--", ""), (None, ""), ("Œ Ç", "0 C"), ("ABCDEFGHIJKLM1O1", "ABCDEFGHIJKLM1O1")])
def test_clean_cell(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string").select(reading.clean_cell(F.col("v")).alias("c"))
    assert df.first().c == want


def test_corrections(spark):
    df = spark.createDataFrame([("N0IR",), ("NOlR",), ("ROUGF",), ("XXXXXXXX",), ("",), (None,)], "v string")
    got = [r.c for r in df.select(reading.nearest_word(F.col("v"), ("NOIR", "ROUGE")).alias("c")).collect()]
    assert got == ["NOIR", "NOIR", "ROUGE", "XXXXXXXX", "", None]
    lead = reading.leading_sign(F.col("v"), ("ALIM", "ARR"))
    assert [r.c for r in spark.createDataFrame([("4LIM 4RR2 4X 42 4LX",)], "v string").select(lead.alias("c")).collect()] == ["ALIM ARR2 4X 42 4LX"]
    values = spark.createDataFrame([("BORNE", "A1"), ("BORNE", "a1"), ("X", "n/a"), ("X", "PAGE : 2"), ("X", "#!#!a"), ("X", "#!#aa"), ("X", "v")], "c string, v string")
    rows = [(r.k, r.p) for r in values.select(reading.may_be_known(F.col("c"), F.col("v")).alias("k"), reading.may_be_pending(F.col("v")).alias("p")).collect()]
    assert rows == [(True, True), (False, True), (False, False), (False, True), (False, False), (False, False), (False, True)]


def signs(spark, spans):
    """spans: (page, span, x, y, text); signs are 5 wide."""
    return spark.createDataFrame([(p, s, k, float(x + 5 * k), float(y), c) for p, s, x, y, t in spans for k, c in enumerate(t)], "p int, span int, seq int, x double, y double, sign string")


def lines(spark, spans):
    return [r.text for r in grid.grid_lines(signs(spark, spans), ["p"]).orderBy("line").collect()]


def test_grid_lines(spark):
    # a line put a little higher belongs to its line; a span's blank is kept; a rule of underlines is no word
    assert lines(spark, [(1, 0, 10, 100, "VERS PCC"), (1, 1, 70, 99.3, "END"), (1, 2, 10, 110, "____"), (1, 3, 20, 110, "x")]) == ["VERS PCC    END", "  x"]
    # spans that overlap are put after each other, with a blank where the gap is real or the span the same
    assert lines(spark, [(1, 0, 0, 0, "ABCD"), (1, 1, 12, 0, "EF"), (1, 2, 33, 0, "GH")]) == ["ABCDEF GH"]
    # what is printed twice at one place is read once
    assert lines(spark, [(1, 0, 0, 0, "AB CD"), (1, 1, 0, 0, "AB CD")]) == ["AB CD"]


def test_grid_lines_send_no_table_of_pages_through_the_driver(spark):
    spans = [(p, n, 7 * n, 20 * n, f"P{p} S{n}") for p in range(40) for n in range(3)]
    got = grid.grid_lines(signs(spark, spans), ["p"])
    assert {(r.p, r.line, r.text) for r in got.collect()} == {(p, n, " " * round(7 * n / 5) + f"P{p} S{n}") for p in range(40) for n in range(3)}
    plan = got._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "FlatMapGroupsInPandas" not in plan


def test_rows_of_grid(spark):
    text = [(1, "title"), (2, "NO      FROM      TO"), (3, "  1       A  b      C"), (4, "  22      D"), (5, "NORTH"), (6, "          E       F"), (7, "PAGE: 3"), (8, "9 9 9")]
    framed = [(1, "| NO | TO |"), (2, "|----|----|"), (3, "| 1 |  x |"), (4, "| a | b | c |"), (5, "|   |   |")]
    df = spark.createDataFrame([(1, k, t) for k, t in text], "p int, line int, text string")
    rows = grid.rows_of_grid(df, ["p"], ["NO", "FROM", "TO"], F.col("text") == "NORTH", F.startswith("text", F.lit("PAGE:"))).orderBy("line").collect()
    assert [(r.line, r.row_type, r.cells, r.unsplit) for r in rows] == [(3, "data", ["1", "A  b", "  C"], False), (4, "data", ["22", "D", ""], False), (5, "section", ["NORTH"], False), (6, "data", ["", "E", "F"], False)]
    df = spark.createDataFrame([(2, k, t) for k, t in framed], "p int, line int, text string")
    rows = grid.rows_of_grid(df, ["p"], ["NO", "TO"], F.lit(False), F.lit(False)).orderBy("line").collect()
    assert [(r.cells, r.unsplit) for r in rows] == [(["1", " x"], False), (["a b c", ""], True)]


def test_first_bounds(spark):
    df = spark.createDataFrame([(1, "a", 0, [0.0, 5.0], 1.0), (1, "b", 1, [0.0, 9.0, 5.0], 1.0), (1, "c", 2, [0.0, 5.0, 9.0], 0.2), (1, "d", 3, [0.0, 4.0, 9.0], 0.9)], "p int, method string, rank int, bounds array<double>, score double")
    assert grid.first_bounds(df, ["p"], 2, 0.5).first().method == "d" and grid.first_bounds(df, ["p"], 2).first().method == "c"


def test_lexicons(spark):
    rows = [("s", 0, ["x", "y"]), ("s", 1, ["Borne", "SIGNAL", "OTHER"]), ("s", 2, ["B1", "hello", "z"]), ("s", 3, ["INDICE", "B", ""]), ("s", 4, ["B1", "####", ""]), ("t", 0, ["lost", "", ""])]
    sheet = spark.createDataFrame(rows, "sheet string, row_idx int, cells array<string>")
    pending = spark.createDataFrame([("signal", " hello ")], "column string, value string")
    assert [(r.column, r.n) for r in lexicon.counts_per_column(lexicon.new_values(sheet, ["sheet"], pending)).collect()] == [("BORNE", 1)]
    templates = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("c", 3, False)], "name string, body int, shipped boolean")
    names = spark.createDataFrame([("a",), ("b",)], "name string")
    assert {r.name for r in lexicon.without_named(templates, names).collect()} == {"a", "c"}
    put = lexicon.put_named(templates, spark.createDataFrame([("a", 9), ("d", 4)], "name string, body int"))
    assert {tuple(r) for r in put.collect()} == {("a", 9, True), ("b", 2, False), ("c", 3, False), ("d", 4, False)}
    assert {r.name for r in lexicon.saved(put).collect()} == {"b", "c", "d"}
    have = spark.createDataFrame([("u", "f1"), ("v", "f2")], "source string, form string")
    new = spark.createDataFrame([("u", "f1"), ("u", "f2"), ("u", "f3"), ("w", "f1")], "source string, form string")
    assert {tuple(r) for r in lexicon.added_sources(have, new).collect()} == {("u", "refused", 3, 2), ("w", "added", 1, 0)}
    states = spark.createDataFrame([("x", "done", 1), ("y", "sent", 1)], "batch string, state string, at int")
    after = lexicon.record_states(states, spark.createDataFrame([("x", "sent", 5), ("y", "open", 7), ("z", "sent", 2)], "batch string, state string, at int"))
    assert {(r.batch, r.state) for r in after.collect()} == {("x", "done"), ("y", "open"), ("z", "sent")}
    assert {r.batch for r in lexicon.to_resume(after).collect()} == {"y", "z"}


def test_legends(spark):
    rows = [(1, 3.0, 8.0, "Code"), (1, 50.0, 8.0, "Nom"), (1, 2.0, 21.0, "K1"), (1, 51.0, 19.0, " a  b "), (1, 90.0, 20.0, "c"), (1, 120.0, 20.0, "d"), (1, 1.0, 42.0, "K1"), (1, 50.0, 41.0, "later"), (1, 2.0, 60.0, "alone"), (1, 2.0, 81.0, "K2"), (1, 49.0, 80.0, "e")]
    df = spark.createDataFrame(rows, "p int, x double, y double, text string")
    got = legend.legend_rows(df, ["p"]).orderBy("y").collect()
    assert [(r.code, r.label, r.description) for r in got] == [("K1", "a b", "c — d"), ("K2", "e", "")]
    assert legend.table_pages(df, ["p"]).first().columns == 2 and legend.table_pages(df, ["p"], 5).count() == 0


def test_evaluations(spark):
    cells = "doc int, page int, row int, col int"
    alerts = spark.createDataFrame([(1, 1, 1, 1, "r"), (1, 1, 1, 2, "r"), (1, 1, None, 3, "r"), (1, 2, None, 3, "r"), (1, None, None, 3, "r")], cells + ", rule string")
    wrong = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, 1), (1, 1, 1, None), (1, 3, 1, None)], cells)
    full = spark.createDataFrame([(1, 1, 3)], "doc int, page int, col int")
    assert [tuple(r) for r in evaluation.alert_quality(alerts, wrong, full, ["doc"]).collect()] == [(1, "r", 2, 3)]
    assert {(r.page, r.row, r.col) for r in evaluation.missed_errors(wrong, alerts, ["doc"]).collect()} == {(1, 2, 1), (3, 1, None)}
    df = spark.createDataFrame([("d", "AB12 x"), ("d", "AB12"), ("d", "A812"), ("d", "AAB12"), ("e", "A812")], "doc string, value string").withColumn("k", F.monotonically_increasing_id())
    got = {(r.doc, r.form, r.better) for r in evaluation.suspect_codes(df, ["doc"], "k").collect()}
    assert got == {("d", "A812", "AB12"), ("d", "AAB12", "AB12")}
