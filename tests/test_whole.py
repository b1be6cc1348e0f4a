"""Queries take their whole input: nothing is cut, filtered or missed on the way to the operator."""

from ledgerleaf.plans import catalog


def run(spark, folder, name, **tables):
    """A query over small tables of its own."""
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    return catalog.QUERIES[name](spark, str(folder))


def test_word_positions_of_whole_turns(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(40))
    some = spark.createDataFrame([(1, 0, long), (1, 1, "other " + long), (2, 0, None)], "conv_id bigint, turn int, text string")
    got = run(spark, tmp_path, "word_positions", conversations=some).collect()
    assert len(got) == 40 + 41 + 1
    first = {r["rank"]: r for r in got if (r["conv_id"], r["turn"]) == (1, 0)}
    assert sorted(first) == list(range(40))
    assert all(first[k]["x"] == (k + 1) * 7.0 and first[k]["source"] == "exact" for k in range(40))


def test_row_alignment_of_whole_lines(spark, tmp_path):
    # row 1 is misread in its sixth word only; row 0 of document 11 is lost in the second reading
    some = spark.createDataFrame([(1, "a b c d e f\na b c d e O7"), (11, "a b c d e f\na b c d e f g")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in run(spark, tmp_path, "row_alignment_optimal", documents=some).collect()}
    assert (got[1]["cells"], got[1]["identical"], got[1]["confusion"], got[1]["lone"]) == (12, 11, 1, 0)
    assert (got[11]["cells"], got[11]["identical"], got[11]["lone"]) == (13, 7, 6)


def test_page_number_duplicates_of_all_orders(spark, tmp_path):
    some = spark.createDataFrame([(1, "1995-01-01"), (5000, "1995-01-01"), (2000, "1996-01-01"), (7000, "1996-01-01"), (7000, "1997-01-01")], "l_orderkey bigint, day string")
    some = some.selectExpr("l_orderkey", "CAST(day AS timestamp) AS l_shipdate")
    got = run(spark, tmp_path, "page_number_duplicates", lineitem=some).collect()
    assert sorted(tuple(r) for r in got) == [("1995-01-01", "1,5000"), ("1996-01-01", "2000,7000")]


def test_text_overlaps_of_all_orders(spark, tmp_path):
    some = spark.createDataFrame([(k, n, n, 1000.0 * n, 30.0) for k in (1, 2, 3) for n in (1, 2)], "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_extendedprice double, l_quantity double")
    got = run(spark, tmp_path, "text_overlaps", lineitem=some).collect()
    assert sorted((r["l_orderkey"], r["a"], r["b"], r["overlap"]) for r in got) == [(k, 1001, 2002, 29.0) for k in (1, 2, 3)]


def test_closest_values_against_brute_force(spark):
    from ledgerleaf.functions.similarity import ratio
    from ledgerleaf.operators import controls

    known = ["LAVENDER METALLIC", "LAVENDER METAL", "ROSE LACE", "AB", "ABCDEFGHIJK", "XXYXXYXXYXXY", "PEACH PUFF", ""]
    wrong = ["1AVENDER METALLI0", "0OSE LAC3", "AB", "BA", "bcdefghij", "YXXYXXYXXYXX", "PE4CH PUF", "QXQXQXQXQ", "", "1EACH PUF1"]
    wrong += [k[:i] + "#" + k[i + 1 : j] + "#" + k[j + 1 :] for k in known for i, j in ((0, len(k) - 1), (1, len(k) - 2), (2, len(k) // 2)) if 0 <= i < j]
    frame = lambda l: spark.createDataFrame([("c", x) for x in dict.fromkeys(l)], "col_name string, value string")
    for cutoff in (0.82, 0.7, 0.5):
        want = {w: max((ratio(k, w.upper()), k) for k in known) for w in wrong}
        got = {r["value"]: (r["ratio"], r["known"]) for r in controls.closest_values(frame(wrong), frame(known), cutoff).collect()}
        assert got == {w: b for w, b in want.items() if b[0] >= cutoff}
