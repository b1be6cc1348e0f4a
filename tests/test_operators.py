import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerleaf import schema
from ledgerleaf.functions import similarity, text
from ledgerleaf.operators import align, audit, dedup, diff, geometry, layout, measure, quality
from ledgerleaf.operators.running import running_total


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [("  eP.stat / ts ", "EP.STAT/TS"), ("! RESERVE | CABLEE", "RESERVECABLEE"), (None, ""), ("éàü", "EAU")])
def test_normalise(spark, raw, want):
    assert one(spark, text.normalise(F.col("x")), x=raw) == want


def test_text_functions(spark):
    assert one(spark, text.fold(F.col("x")), x="BOIS 27") == one(spark, text.fold(F.col("x")), x="8O1S Z7")
    assert one(spark, text.squeeze(F.col("x")), x=" a   b\t") == "a b"
    assert tuple(one(spark, text.page_key(F.col("x")), x="PAGE 122 A")) == (122, "a")
    assert one(spark, text.page_key(F.col("x")), x="none") is None
    assert tuple(one(spark, text.numbered(F.col("x")), x="RM X 12B")) == ("RM X", 12)
    assert one(spark, text.duration(F.col("x")), x=3725) == "1:02:05" and one(spark, text.duration(F.col("x")), x=65) == "1:05"
    assert tuple(one(spark, text.progress(F.col("x")), x="reading Page 3/12 now")) == (3, 12)
    assert one(spark, text.template("p. {PAGE} of {NONE}.", F.create_map(F.lit("PAGE"), F.col("x"))), x="7") == "p. 7 of ."
    assert one(spark, text.placed(F.col("x"), F.array(F.lit(0), F.lit(5), F.lit(6))), x="ab cd ef") == "ab   cd ef"
    assert one(spark, text.starts(F.col("x")), x="ab   cd ef") == [0, 5, 8]
    assert one(spark, text.contrast(F.lit("000000"), F.lit("FFFFFF")), x="") == pytest.approx(21)
    assert one(spark, text.without_repeats(F.col("x")), x="a.......b--c") == "a.b--c"
    assert one(spark, text.noise_share(F.col("x")), x="ab##") == 0.5


@pytest.mark.parametrize("a, b, want", [("B0RNE", "BORNE", "confusion"), ("PHA 104", "PH A104", "spacing"), ("x QTEL2", "x QUEL2", "different"), ("", "word", "added"), ("word", "", "missing"), ("", "", "identical"), (None, "", "identical"), ("", "x", "confusion")])
def test_cell_classes(spark, a, b, want):
    assert one(spark, similarity.cell_class(F.col("a"), F.col("b")), a=a, b=b) == want


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_similarity_invariants(a, b):
    assert 0 <= similarity.ratio(a, b) <= 1 and similarity.ratio(a, a) == 1
    assert similarity.indel(a, b) >= abs(len(a) - len(b))


def plain_class(a, b):
    """The rule as the blueprint states it, over difflib's own blocks."""
    a, b = " ".join(a.split()), " ".join(b.split())
    if a.replace(" ", "") == b.replace(" ", ""):
        return "identical" if a == b else "spacing"
    known = {p for x, y in map(tuple, similarity.CONFUSED_PAIRS) for p in ((x, y), (y, x))}
    edits = [(a[i1:i2], b[j1:j2]) for op, i1, i2, j1, j2 in similarity.blocks(a, b) if op != "equal"]
    slips = [len(x) < 2 and len(y) < 2 and ("" in (x, y) or (x, y) in known) for x, y in edits]
    return "confusion" if len(edits) < 3 and all(slips) else "added" if not a else "missing" if not b else "different"


def plain_shift(ref, conv):
    from collections import Counter

    n = max(len(ref), len(conv))
    cells = [[Counter(row[k].split()) if k < len(row) else Counter() for k in range(n)] for row in (ref, conv)]
    out = [False] * n
    for x in range(n):
        for y in (x - 1, x + 1):
            if 0 <= y < n:
                gone, come = cells[0][x] - cells[1][x], cells[1][y] - cells[0][y]
                if gone and gone == come and not cells[1][x] - cells[0][x] and not cells[0][y] - cells[1][y]:
                    out[x] = out[y] = True
    return out


def test_cell_classes_and_shifts_against_the_rule(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("A1IO0BS8 ") for _ in range(rng.randrange(6)))
    pairs = [(a := word(), a[:k] + rng.choice(["", "O", "0", " ", "1I"]) + a[k + rng.randrange(2) :]) for _ in range(300) for k in [rng.randrange(1 + 5)]] + [(word(), word()) for _ in range(200)]
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    got = df.select("a", "b", similarity.cell_class(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r.c == plain_class(r.a, r.b) for r in got) and {r.c for r in got} >= {"identical", "spacing", "confusion", "different", "added", "missing"}
    rows = [([" ".join(rng.choice("abc") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 5))], [" ".join(rng.choice("abc") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 5))]) for _ in range(400)] + [(["a b", "c"], ["a", "b c"]), (["a b", "c"], ["a", "c"]), ([], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", similarity.shifted(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s[: max(len(r.a), len(r.b))] == plain_shift(r.a, r.b), r


def test_closest_value():
    assert similarity.closest("ROUGEE", ["ROUGE", "BLEU"]) == "ROUGE" and similarity.closest("x", ["ROUGE"]) is None


def best_total(a, b):
    """The greatest total of an alignment, by every way."""
    from functools import lru_cache

    @lru_cache(None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return align.GAP * (len(a) - i + len(b) - j)
        return max(go(i + 1, j + 1) + similarity.ratio(a[i], b[j]) - align.BONUS, go(i + 1, j) + align.GAP, go(i, j + 1) + align.GAP)

    return go(0, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", max_size=4), max_size=7), st.lists(st.text("abc", max_size=4), max_size=7))
def test_optimal_alignment_is_optimal(a, b):
    pairs = align.align_optimal(a, b)
    total = sum(align.GAP if None in p else similarity.ratio(a[p[0]], b[p[1]]) - align.BONUS for p in pairs)
    assert total == pytest.approx(best_total(a, b))
    assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))


def test_large_blocks_are_aligned_too():
    """600 by 601 rows: one row more at the front does not pair everything off by position."""
    rng = random.Random(3)
    a = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(600)]
    b = ["zzzzzzzz"] + [x[:7] + "#" for x in a]
    assert align.align_optimal(a, b) == [(None, 0)] + [(k, k + 1) for k in range(600)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["aa", "ab", "bb", "cd"]), max_size=7), st.lists(st.sampled_from(["aa", "ab", "bb", "cd"]), max_size=7), st.sampled_from(["optimal", "greedy"]))
def test_alignment_covers_every_row_once(a, b, how):
    pairs = align.align_rows(a, b, how)
    assert [i for i, _ in pairs if i is not None] == list(range(len(a)))
    assert [j for _, j in pairs if j is not None] == list(range(len(b)))
    for i, j in align.align_anchored(a, b):
        assert similarity.ratio(a[i], b[j]) >= align.ROW_LEAST


def test_alignment_and_matching():
    assert align.align_rows(["one", "two", "three"], ["one", "twO", "four words", "three"]) == [(0, 0), (1, 1), (None, 2), (2, 3)]
    assert align.greedy_pairs([(0.9, 0, 1), (0.9, 0, 0), (0.5, 1, 1)]) == [(0.9, 0, 0), (0.5, 1, 1)]
    assert align.ordered_pairs([[0.9, 0.2], [0.8, 0.1]]) == [(0, 0)]
    assert align.increasing([(0, 5), (1, 2), (2, 3), (3, 1)]) == [(1, 2), (2, 3)]
    assert align.match_pages_in_order([["a"], ["b"]], [["a"], ["x"], ["b"]]) == [(0, 0), (1, 2)]


def test_pages_without_words_meet(spark):
    page = lambda *r: spark.createDataFrame(list(r), "d int, rank int, words array<string>, lines array<string>")
    a, b = page((1, 0, [], [""]), (1, 1, ["x"], ["x"])), page((1, 5, [], [""]), (1, 6, ["x", "y"], ["x y"]))
    assert {(r.a, r.b, r.jaccard) for r in align.candidates(a, b, ["d"]).collect()} == {(0, 5, 1.0), (1, 6, 0.5)}
    assert (0, 5) in {(r.a, r.b) for r in align.match_pages(a, b, ["d"]).collect()}


def test_compare_rows_with_lone_pages(spark):
    ref = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c d", "e"]), (2, 0, ["only"])], "p int, row_idx int, cells array<string>")
    conv = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["c", "d e"]), (3, 0, ["new"])], "p int, row_idx int, cells array<string>")
    got = align.compare_rows(ref, conv, ["p"])
    assert {(r.p, r.ref_idx, r.col_idx, r["class"]) for r in got.collect()} == {(1, 0, 0, "identical"), (1, 0, 1, "identical"), (1, 1, 0, "shifted"), (1, 1, 1, "shifted"), (2, 0, 0, None), (3, None, 0, None)}
    assert diff.precision(got).first().precision == pytest.approx(4 / 6)


def test_classes_in_order(spark):
    rows = [("a", "a", 100, False, False, "identical"), ("a b", "A B", 100, False, False, "format"), ("B0", "BO", 100, False, False, "confusion"), ("", "x", 100, False, False, "reference_blank"), ("xyz", "qqqqqq", 50, False, False, "low_confidence"), ("xyz", "uvwabc", 80, False, True, "reference_unknown"), ("abc", "abd", 80, False, False, "small"), ("abc", "", 95, False, False, "content_lost"), ("abcdef", "uvwxyz", 95, True, False, "converted_unknown"), ("abcdef", "uvwxyz", 95, False, False, "divergence")]
    df = spark.createDataFrame(rows, "r string, c string, conf int, kr boolean, kc boolean, want string")
    kind, why = diff.classify(F.col("r"), F.col("c"), F.col("conf"), F.col("kr"), F.col("kc"))
    for r in df.withColumn("kind", kind).withColumn("why", why).collect():
        assert r.why == ("" if r.want == "identical" else r.want)


def test_zones():
    assert diff.row_zones(["AB", "CD"], ["ABC", "D"]) == []
    assert diff.row_zones(["AB", "X"], ["AC", "X"]) == [([0], "B", "C")]
    assert diff.zones("abcdefgh", "xbcdefgy") == [(0, 1, 0, 1), (7, 8, 7, 8)]
    assert diff.zones("abcd", "xbcy") == [(0, 4, 0, 4)]


def cells(spark, values, col="n"):
    return spark.createDataFrame([(0, k, v[0] if isinstance(v, tuple) else "data", 0, col, v[1] if isinstance(v, tuple) else v) for k, v in enumerate(values)], "page_idx int, row_idx int, row_type string, col_idx int, col_name string, value string")


def test_coherence(spark):
    got = quality.coherence(cells(spark, ["OC FS 14 50"] * 3 + ["CC FS 14 50"]), []).collect()
    assert [(r.row_idx, r.proposal) for r in got] == [(3, "OC FS 14 50")]
    assert quality.coherence(cells(spark, ["OC FS 14 50", "CC FS 14 50"]), []).count() == 0
    lexicon = spark.createDataFrame([("BOIS",)], "form string")
    assert [r.proposal for r in quality.coherence(cells(spark, ["8OIS", "BOIS"]), [], lexicon).collect()] == ["BOIS"]


def test_variants(spark):
    got = {r.v for r in spark.sql("SELECT 'OC1' AS x").select(F.explode(quality.variants(F.col("x"))).alias("e")).select(F.col("e.variant").alias("v")).collect()}
    assert got == {"CC1", "0C1", "OO1", "OCI"}


def test_page_sequence(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(["1", "", "3", "3", "2"])], "page_idx int, label string")
    got = quality.page_sequence(df.withColumn("d", F.lit(1)), ["d"])
    assert {(r.page_idx, r.alert) for r in got.collect()} == {(1, "unreadable"), (3, "repeated"), (4, "decreasing")}


@pytest.mark.parametrize("bad, collapsed", [(20, False), (21, True)])
def test_guard_rail(spark, bad, collapsed):
    df = cells(spark, ["x"] * bad + ["7"] * (100 - bad)).withColumn("d", F.lit(1))
    patterns = spark.createDataFrame([("n", "[0-9]+")], "col_name string, pattern string")
    alerts = quality.off_format(df, patterns, ["d"])
    got = quality.guard_rail(alerts, df.groupBy("d").agg(F.count("*").alias("total")), ["d"]).collect()
    assert len(got) == (1 if collapsed else bad) and (got[0].row_idx is None) == collapsed


def test_continuity_gives_one_alert_per_slip(spark):
    df = cells(spark, ["RA 1", "RA 2", "RA 90", "RA 3", ("section", "S"), "RA 50", "RB 1", "RA 51"]).withColumn("d", F.lit(1))
    assert [(r.row_idx, r.message) for r in quality.continuity(df, "n", ["d"]).collect()] == [(2, "2 then 90")]


def test_rules_are_gated(spark):
    df = cells(spark, ["x"]).withColumn("d", F.lit(1))
    make = lambda: quality.empty_columns(df, ["n"], ["d"])
    assert quality.control({"dictionary": make}) is None
    assert quality.control({"dictionary": make}, {"dictionary": True}).count() == 0
    assert quality.empty_columns(cells(spark, ["", " "]).withColumn("d", F.lit(1)), ["n"], ["d"]).count() == 1
    known = spark.createDataFrame([("n", "y")], "col_name string, value string")
    assert [r.message for r in quality.off_dictionary(df, known, ["d"]).collect()] == ["x"]


def test_replay_and_eviction(spark):
    log = spark.createDataFrame([(1, "a", True, "r1"), (2, "b", False, "r2"), (3, "a", True, "r3"), (4, "a", False, "r4"), (5, None, True, "r5"), (6, None, True, "r6")], "seq int, image string, ok boolean, raw string")
    assert [r.raw for r in audit.replay(log, "image", "ok", "seq").orderBy("first_seen").collect()] == ["r3", "r2", "r5", "r6"]
    cache = spark.createDataFrame([(1, 40.0, "x"), (2, 40.0, "y"), (3, 40.0, "z"), (99, 1.0, "old")], "age int, size double, name string")
    assert [r.name for r in audit.evict(cache, "age", "size", 90, 80.0, "name").orderBy("age").collect()] == ["x", "y"]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_running_total(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(12), k, rng.randrange(100)) for k in range(300)]
    got = running_total(spark.createDataFrame(rows, "o int, k int, v int"), "o", "v", "s", ("k",), parts).orderBy("o", "k").collect()
    total = 0
    for (o, k, v), r in zip(sorted(rows), got):
        total += v
        assert (r.o, r.k, r.s) == (o, k, total)


def test_first_bad_word(spark):
    assert one(spark, audit.first_bad_word(F.col("x"), r"\d{4,5}[A-Z]?"), x="1234 12 99999A x") == "12"


def test_layout(spark):
    rows = spark.createDataFrame([(1, 0, "data", ["05E", "", "CTB4-", ""]), (1, 1, "data", ["", "ROUGE", "", "x"]), (1, 2, "section", [""]), (1, 3, "data", ["a"])], "p int, row_idx int, row_type string, cells array<string>")
    assert [r.cells for r in layout.merge_partial(rows, ["p"]).orderBy("row_idx").collect()] == [["05E", "ROUGE", "CTB4-", "x"], [""], ["a"]]
    lines = spark.createDataFrame([(1, "AB   CD"), (1, "A     D")], "p int, text string")
    headers = spark.createDataFrame([(1, 0, 0), (1, 1, 5)], "p int, col_idx int, start int")
    assert layout.gutters(lines, ["p"], headers).first().cut == 5
    words = spark.createDataFrame([(1, float(y), k) for k, y in enumerate([0, 3, 6, 20])], "p int, y double, k int")
    assert [r.line for r in layout.lines_by_gap(words, ["p"], "y", 4.0, "k").orderBy("k").collect()] == [0, 0, 0, 1]
    assert [r.line for r in layout.lines_by_anchor(words, ["p"], "y", 4.0, "k").orderBy("k").collect()] == [0, 0, 1, 2]
    assert [r.line for r in layout.lines_by_mean(words, ["p"], "y", 4.0, "k").orderBy("k").collect()] == [0, 0, 1, 2]
    table = spark.createDataFrame([(1, 0, ["title"]), (1, 1, ["NO", "FROM", "TO"])], "p int, row_idx int, cells array<string>")
    assert layout.find_header(table, ["p"], ["NO", "FROM", "TO"]).first().row_idx == 1
    assert one(spark, layout.blank_rows(F.col("g"), F.col("h")), g=50.0, h=10.0) == 3


def test_measures(spark):
    assert measure.sample_indices(10, 4) == [0, 3, 6, 9] and measure.sample_indices(3, 9) == [0, 1, 2]
    df = spark.createDataFrame([(1, float(x)) for x in (0, 10, 20, 30, 41)], "g int, x double")
    assert measure.best_period(df, ["g"], "x", [7.0, 10.0]).first().period == 10.0
    assert measure.variation(df, ["g"], "x").first().variation == pytest.approx(math.sqrt(3 * 0.25**2 + 0.75**2) / 2 / 10.25)
    assert measure.common_gap(df, ["g"], "x").first().gap == 10.0


def test_sets(spark):
    bags = spark.sql("SELECT array('a','a','b') AS x, array('a','c') AS y")
    assert bags.select(dedup.bag_minus(F.col("x"), F.col("y")).alias("v")).first().v == ["a", "b"]
    values = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    known, pending, new = dedup.accept_values(values("p", "q"), values("k"), values("q", "z"), ["value"])
    assert ({r.value for r in known.collect()}, [r.value for r in pending.collect()], [r.value for r in new.collect()]) == ({"k", "q"}, ["p"], ["q"])
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {tuple(r) for r in dedup.upsert(table, spark.createDataFrame([(2, "c")], "k int, v string"), ["k"]).collect()} == {(1, "a"), (2, "c")}


def test_tolerance_dedup_is_greedy_and_idempotent(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(1, k, rng.random(), rng.random()) for k in range(200)], "g int, k int, x double, y double")
    kept = dedup.within_tolerance(df, ["g"], "k", "x", "y", 0.1)
    rows = kept.orderBy("k").collect()
    assert rows[0].k == 0 and not any(abs(a.x - b.x) <= 0.1 and abs(a.y - b.y) <= 0.1 for i, a in enumerate(rows) for b in rows[:i])
    assert dedup.within_tolerance(kept, ["g"], "k", "x", "y", 0.1).count() == len(rows)


def test_tolerance_dedup_of_many_groups_equals_plain_python(spark):
    rng = random.Random(3)
    odd = [None, math.nan, math.inf, -math.inf]
    rows = [(g, k, rng.choice(odd) if rng.random() < 0.1 else rng.uniform(-9, 9), rng.choice(odd) if rng.random() < 0.1 else rng.uniform(-9, 9)) for g in [None, *range(60)] for k in range(300 if g == 7 else rng.randrange(1, 6))]
    rng.shuffle(rows)
    got = dedup.within_tolerance(spark.createDataFrame(rows, "g int, k int, x double, y double"), ["g"], "k", "x", "y", 1.5)
    want, kept = set(), {}
    for g, k, x, y in sorted(rows, key=lambda r: r[1]):
        near = [(p, q) for p, q in kept.setdefault(g, []) if None not in (x, y, p, q) and abs(x - p) <= 1.5 and abs(y - q) <= 1.5]
        if not near:
            kept[g].append((x, y))
            want.add((g, k))
    assert len(kept[7]) > 2 * dedup.FEW and len(want) < len(rows)
    assert {(r.g, r.k) for r in got.collect()} == want
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()  # a call for each group took 267 s for 330,000 of them


def test_geometry(spark):
    assert geometry.simplify([(0, 0), (1, 0.01), (2, 0), (3, 5)], 0.1) == [(0, 0), (2, 0), (3, 5)]
    assert geometry.simplify([(0, 0), (10, 0), (5, 0)], 0.5) == [(0, 0), (10, 0), (5, 0)]  # beyond the segment's end
    cross = [[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 3)], [(5, 5), (6, 5), (5, 5)]]
    assert geometry.chains(cross) == [*cross[:3], cross[3]]
    assert geometry.chains([[(0, 0), (1, 0)], [(2, 0), (1, 0)], [(2, 0), (2, 5)]]) == [[(0, 0), (1, 0), (2, 0)], [(2, 0), (2, 5)]]
    assert geometry.snap_square([(0, 0), (10, 0.2)], 3) == [(0, 0.1), (10, 0.1)]
    assert geometry.collinear_groups([[(0, 0), (1, 0)], [(2, 0.01), (3, 0)], [(0, 5), (1, 5)]], 3, 0.1) == [[0, 1], [2]]
    (a, b) = geometry.fit_one([[(0, 0), (1, 0)], [(2, 0), (3, 0)]])
    assert a == pytest.approx((0, 0)) and b == pytest.approx((3, 0))
    df = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 3D, 'y', 4D)) AS p")
    r = df.select(geometry.path_length(F.col("p")).alias("n"), geometry.path_angle(F.col("p")).alias("a"), geometry.line_weight(F.lit(0.5)).alias("w")).first()
    assert (r.n, round(r.a, 3), r.w) == (5.0, 53.13, 0.18)


def test_cells_of_pages(spark):
    rows = [("d", 0, True, None, None, None, ["A", "B"], [("data", ["x"], [90], None, None, None), ("section", [], None, "S", None, None)], None, None, None)]
    got = schema.cells_of(spark.createDataFrame(rows, schema.PAGE)).where("row_type = 'data'").orderBy("col_idx").collect()
    assert [(r.col_name, r.value, r.confidence) for r in got] == [("A", "x", 90), ("B", "", None)]


def test_corners_and_dashes(spark):
    path = [(float(x), 0.0) for x in range(40)] + [(39.0, float(y)) for y in range(1, 40)]
    found = geometry.apart(geometry.corners(path), path)
    assert found[0] == 0 and found[-1] == len(path) - 1 and any(35 <= k <= 43 for k in found)
    soft = geometry.smooth(path)
    assert soft[0] == path[0] and soft[-1] == path[-1] and max(math.dist(a, b) for a, b in zip(path, soft)) < 2
    assert geometry.corners(path[:30]) == [0, 29] and geometry.smooth(path[:4]) == path[:4]
    dashes = [[(x, 0.0), (x + 4.0, 0.0)] for x in (0.0, 6.0, 12.0, 18.0)]
    assert geometry.dash_pattern(dashes) == {"dash": 4.0, "gap": 2.0, "scale": 0.31, "start": (0.0, 0.0), "end": (22.0, 0.0)}
    assert geometry.dash_pattern([[(0.0, 0.0), (4.0, 0.0)], [(5.0, 0.0), (9.0, 0.0)], [(30.0, 0.0), (34.0, 0.0)]]) is None
    df = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in path])], "k int, points array<struct<x:double,y:double>>")
    parts = geometry.split_at_corners(df, ["k"]).orderBy("stretch").collect()
    assert len(parts) == len(found) - 1 and parts[0].points[0].x == 0.0
