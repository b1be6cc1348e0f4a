import hashlib
import re
import tracemalloc

import pytest

from ledgerleaf.llm import decontamination as d


def brute(cases, items, window=10):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(str(i), w[k : k + window]) for i, t in items for w in [word(t)] for k in range(max(1, len(w) - window + 1) if w else 0)]
    out = []
    for i, t in cases:
        w, hit, found = word(t), set(), set()
        for name, q in windows:
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    hit |= set(range(k, k + len(q)))
                    found.add(name)
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(cases):
    passage = dict(cases)[7]
    return [(10, passage.upper()[7:150]), (9, "one"), (2, "ab ab"), (3, None), (4, " .. "), (10, passage.upper()[7:150]), (77, dict(cases)[10][5000:5200]), (5, "never to be found anywhere at all in any of these texts")]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")


def test_report_equals_brute_force(docs, cases, benchmark, items):
    some = [(i, t if t is None or len(t) < 100_000 else t[:100_000]) for i, t in cases]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in d.report(d.find_phrases(docs, benchmark)).collect() if r.doc_id != 10)
    assert got == [r for r in brute(some, items) if r[0] != "10"]
    ten = next(r for r in d.report(d.find_phrases(docs, benchmark)).collect() if r.doc_id == 10)
    assert ten.contaminated and ten.n_hit >= 20


def test_blocks_of_queries_give_the_same(docs, benchmark, monkeypatch):
    whole = sorted(map(str, d.report(d.find_phrases(docs, benchmark)).collect()))
    monkeypatch.setattr(d, "BLOCK_BYTES", 300)
    assert d.query_blocks(benchmark, 10, "item_id", "text").count() > 2
    assert sorted(map(str, d.report(d.find_phrases(docs, benchmark)).collect())) == whole


def test_expanding_in_steps_gives_the_same(monkeypatch):
    q = d.Queries([("a", "x y z " * 8), ("b", "y z x " * 5)])
    q.rank(__import__("numpy").ones(3))
    texts = ["x y z " * 30, "z " * 9, "q x y z x y z x y z x q"]
    whole = d.Shard(q, texts).match()
    monkeypatch.setattr(d, "EXPAND", 3)
    assert d.Shard(q, texts).match() == whole and whole[2][1] == [1, 11]


def test_a_passage_of_many_items_takes_little_memory():
    passage = " ".join(f"w{k}" for k in range(40))
    q = d.Queries([(f"i{k:03}", passage) for k in range(200)])
    q.rank(__import__("numpy").ones(40))
    shard = d.Shard(q, [(passage + " ") * 30] * 100)
    tracemalloc.start()
    got = shard.match()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(n, r, len(i)) for n, r, i in got] == [(1200, [0, 1200], 200)] * 100
    assert peak < 64 << 20


def test_shards_are_bounded_by_words(docs, benchmark, monkeypatch):
    want = {tuple(r) for r in d.report(d.find_phrases(docs, benchmark)).collect()}
    assert list(d._shards([])) == [] and list(d._shards([0, 0])) == [(0, 2)]
    monkeypatch.setattr(d, "SHARD_WORDS", 20)
    assert list(d._shards([15, 5, 1, 90, 3, 3])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert {tuple(r) for r in d.report(d.find_phrases(docs, benchmark)).collect()} == want


def test_near_matches():
    q = d.Queries([("a", "red green blue")])
    q.rank(__import__("numpy").ones(3))
    texts = ["blue then red and green", "red far far far far far green blue", "green red blue"]
    assert d.Shard(q, texts).near(2) == [(0, "a", 0, 5), (2, "a", 0, 3)]
    assert [x[0] for x in d.Shard(q, texts).near(0)] == [2]


def brute_near(texts, items, slop, window=10):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    everything = [w for _, t in texts for w in word(t)]
    out = set()
    for i, t in texts:
        w = word(t)
        for name, item in items:
            q = word(item)
            for k in range(max(1, len(q) - window + 1) if q else 0):
                own = q[k : k + window]
                ranks = sorted(range(len(own)), key=lambda j: (everything.count(own[j]), j))
                rare = own[ranks[0]]
                for p in (p for p, x in enumerate(w) if x == rare):
                    spans = [(e - s, s, e) for s in range(max(0, p - len(own) - slop + 1), p + 1) for e in range(p + 1, min(len(w), s + len(own) + slop) + 1) if set(own) <= set(w[s:e]) and w[s] in own]
                    if spans:
                        out.add((i, str(name), min(spans)[1], min(spans)[2]))
    return sorted(out, key=str)


def test_near_matches_equal_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30)))) for i in range(40)] + [(50, None), (51, "")]
    items = [(1, "a b c"), (2, "c h a d e"), (3, "z"), (4, None), (5, "b b g"), (6, "a b c d e f g h a b c d")]
    docs = spark.createDataFrame([(*r, "x") for r in texts] + [(3, texts[3][1], "y")], "doc_id long, text string, item string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for size in (4 << 20, 100):
        monkeypatch.setattr(d, "BLOCK_BYTES", size)
        got = sorted([(r.doc_id, r.item, r.start, r.end) for r in d.find_near(docs, benchmark, 2).collect()], key=str)
        want = brute_near([*texts, (3, texts[3][1])], items, 2)
        assert got == sorted(want + [r for r in want if r[0] == 3], key=str)


def test_postings_are_stored_and_read_back():
    import numpy as np

    texts = ["a b a", "", "b c", "é é"]
    p = d.Postings.of(texts)
    q = d.Postings.unpacked(*p.packed())
    assert all((x == y).all() for x, y in zip((p.first, p.terms, p.counts, p.places), (q.first, q.terms, q.counts, q.places)))
    lists = {k: v for k, v in zip("abcé", p.find(np.concatenate(d.terms_of([d.words_of("a b c é")]))).tolist())}
    held = {w: p.places[p.at[k] : p.at[k + 1]].tolist() for w, k in lists.items()}
    assert held == {"a": [0, 2], "b": [1, 5], "c": [6], "é": [8, 9]}


def test_one_pass_whatever_the_benchmark(docs, benchmark, monkeypatch, capsys):
    monkeypatch.setattr(d, "BLOCK_BYTES", 150)
    d.drop_contaminated(docs, benchmark).explain()
    assert "MapInArrow" not in capsys.readouterr().out  # rows are dropped by a join with stored keys, no text goes to Python again


def test_clean_rows_stay_whole(docs, benchmark, cases):
    kept = d.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    flags = {(r.doc_id, r.n_words): r.contaminated for r in d.report(d.find_phrases(docs, benchmark)).collect()}
    assert kept.count() == sum(not r.contaminated for r in d.report(d.find_phrases(docs, benchmark)).collect())
    assert flags


def test_empty_tables(docs, empty, benchmark):
    assert d.report(d.find_phrases(empty, benchmark)).count() == 0
    assert d.report(d.find_phrases(docs, benchmark.where("false"))).where("contaminated").count() == 0
    assert d.drop_contaminated(empty, benchmark).count() == 0
