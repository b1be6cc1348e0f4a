"""SimHash, substring and suffix deduplication, and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from ledgerleaf.llm import repeats, simhash, substring_dedup, suffix_dedup

SPACE = "[^\x20\x09-\x0d]+"


def slow_fingerprint(t):
    w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(cases):
    for _, t in cases:
        assert simhash.fingerprint(t or "") % (1 << 64) == slow_fingerprint(t if t is None or len(t) < 20_000 else t) if t is None or len(t) < 20_000 else True


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if bin((a ^ b) % (1 << 64)).count("1") <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {f: root(f) for f in fps}


@pytest.mark.parametrize("blocks", [4, 5])
@pytest.mark.parametrize("pairs", [1, 12, 1000])
def test_links_keep_components(spark, monkeypatch, pairs, blocks):
    """With crowded buckets, chains and far pairs, whatever the bucket's bound."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = random.Random(pairs)
    fps = {0, -1}
    for _ in range(12):
        at = rng.getrandbits(64) - (1 << 63)
        for _ in range(14):
            fps.add(at)
            for _ in range(rng.randrange(1, 4)):
                b = rng.randrange(64)
                at ^= (1 << b) if b < 63 else -(1 << 63)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(df, blocks)
    assert all(bin((r.a ^ r.b) % (1 << 64)).count("1") <= 2 for r in edges.collect())
    want = brute_components(fps)
    got = {f: f for f in fps} | {r.node: r.root for r in simhash.components(edges).collect()}
    same = lambda m: sorted(sorted(f for f in m if m[f] == r) for r in set(m.values()))
    assert same(got) == same(want)


def test_near_duplicates(docs, cases):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(cases)
    known = {t: slow_fingerprint(t) for _, t in cases if t is None or len(t) < 20_000}
    comp = brute_components({f - (1 << 64) if f >> 63 else f for f in known.values()} | {int(r.fingerprint, 16) - (1 << 64) if int(r.fingerprint, 16) >> 63 else int(r.fingerprint, 16) for r in got})
    lows = {}
    for r in got:
        f = int(r.fingerprint, 16)
        root = comp[f - (1 << 64) if f >> 63 else f]
        if r.doc_id is not None:
            lows[root] = min(lows.get(root, r.doc_id), r.doc_id)
    for r in got:
        f = int(r.fingerprint, 16)
        assert r.component_id == lows.get(comp[f - (1 << 64) if f >> 63 else f])
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 3)} == {"0" * 16}


def test_keep_one(docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(6) == 1 and 2 not in ids and ids.count(1) == 1 and ids.count(None) == 1
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_keep_one_of_repeated_ids(spark):
    """One row of each component, whatever ids its rows share with others; columns may bear any names."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(rng.choice("klmnop") + str(rng.randrange(999)) for _ in range(50)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (7, d), (None, d), (9, b)]
    df = spark.createDataFrame([(i, t, "x", "y", "z", "w", {"k": "v"}) for i, t in rows], "doc_id long, text string, _first string, _place string, _own_id string, root string, m map<string,string>")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b), (7, c), (7, d), (None, d)], key=str)


def test_tables_go_with_their_scratch(spark, docs):
    from ledgerleaf.llm import common

    with common.scratch():
        simhash.keep_one(docs).collect()
        made = [t._table for t in common._SCOPES[-1]]
        assert made
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_no_session_settings_change(spark, docs):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    simhash.near_duplicates(docs).collect()
    assert before == {k: spark.conf.get(k) for k in before}


def brute_removal(rows, size):
    """rows: (id, symbols). Removed places of each row."""
    low = {}
    for i, s in rows:
        if i is not None:
            for k in range(len(s) - size + 1):
                key = tuple(s[k : k + size])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, s in rows:
        gone = set()
        if i is not None:
            for k in range(len(s) - size + 1):
                if low[tuple(s[k : k + size])] < i:
                    gone |= set(range(k, k + size))
        out.append(gone)
    return out


def expected(cases, words):
    rows = [(i, (t or "").encode().split() if words else (t or "").encode()) for i, t in cases]
    out = []
    for (i, s), gone in zip(rows, brute_removal(rows, 13 if words else 50)):
        left = [x for k, x in enumerate(s) if k not in gone]
        out.append((str(i), len(s), len(gone), hashlib.sha256(b" ".join(left) if words else bytes(left)).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def small(cases):
    rng = random.Random(9)
    short = [(i, t if t is None or len(t) < 20_000 else t[:9000]) for i, t in cases]
    base = " ".join(rng.choice("ab") + str(rng.randrange(9)) for _ in range(300))
    for k in range(60):
        a = rng.randrange(len(base) - 400)
        short.append((100 + k // 2, base[a : a + rng.randrange(30, 400)] + rng.choice(["", " end", " é" * 20]) + base[: rng.randrange(200)]))
    return short


@pytest.mark.parametrize("hot", [1, 3, 512])
@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_removal_against_brute_force(spark, small, module, hot, monkeypatch):
    """Also with many buckets and groups, small chunks, and every anchor treated as a hot one."""
    if hot < 512:
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 4000)
        monkeypatch.setattr(repeats, "GROUP_BYTES", 3000)
        monkeypatch.setattr(repeats, "SAMPLE_LEAST", 1)
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in small], "doc_id long, text string, bucket string, kept string").repartition(5)
    words = module is substring_dedup
    f = module.remove_repeated if words else module.remove_covered
    got = module.report(f(df, hot=hot))
    n = "n_words" if words else "n_bytes"
    assert sorted((str(r.doc_id), r[n], r.n_removed, r.kept_sha256) for r in got.collect()) == expected(small, words)
    assert module.report(f(df.where("false"))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=400), min_size=1, max_size=5), st.sampled_from([64, 1 << 17]))
def test_stretches_cover_each_window_once(texts, chunk):
    kind, old = suffix_dedup.KIND, repeats.CHUNK
    repeats.CHUNK = chunk
    try:
        seen = {}
        for part in repeats.stretches(kind, [t.encode() for t in texts]):
            for d, s, e, a, key in zip(*[c.tolist() for c in part]):
                for w in range(s, e + 1):
                    assert w <= a <= w + kind.window - kind.gram
                    content = texts[d][w : w + kind.window]
                    assert seen.setdefault(content, (a - w, key)) == (a - w, key)  # equal windows have equal anchors at equal places
                    seen[d, w] = seen.get((d, w), 0) + 1
        assert all(seen[d, w] == 1 for d, t in enumerate(texts) for w in range(len(t) - kind.window + 1))
    finally:
        repeats.CHUNK = old


def test_disk_queue_orders_across_runs():
    rng = np.random.default_rng(1)
    kind = np.dtype([("key", "S5"), ("number", np.int64)])
    q = suffix_dedup.DiskQueue(kind, "key", run_bytes=2000, block=7)
    some = np.empty(900, kind)
    some["key"] = rng.integers(97, 100, (900, 5)).astype(np.uint8).view("S5").ravel()
    some["number"] = np.arange(900)
    for at in range(0, 900, 50):
        q.put(some[at : at + 50])
    assert len(q.runs) > 3
    got = np.concatenate(list(q.take()))
    flat = some["key"].tolist()
    assert got["key"].tolist() == sorted(flat) and sorted(got["number"]) == list(range(900))
    assert all(flat[n] == k for k, n in zip(got["key"].tolist(), got["number"]))


def removed(messages):
    """Bucket, document and place of everything that messages tell of."""
    out = set()
    for some in messages:
        for _, b, blob in some:
            out |= {(b, int(i), x) for i, s, e in zip(*repeats.unpack(blob)) for x in range(s, e)}
    return out


@pytest.mark.parametrize("run_bytes, block", [(1 << 20, 1 << 15), (20_000, 64), (500, 3), (500, 1)])
def test_a_group_larger_than_memory(run_bytes, block):
    """Everything of a group on disk, blocks down to one tuple: the same windows as brute force finds."""
    rng = random.Random(3)
    shared = "shared passage of more than fifty bytes, as it happens, or so"
    texts = ["".join(rng.choice("ab") for _ in range(30)) + shared + "".join(rng.choice("ab") for _ in range(60)) + rng.choice(["", shared * 2, "ab" * 60]) for _ in range(14)]
    ids = [k // 2 for k in range(14)]
    sizes = repeats.Sizes(1, 1, 4, frozenset())
    hashes = np.unique(np.concatenate([sizes.short(p[4]) for p in repeats.stretches(suffix_dedup.KIND, [t.encode() for t in texts])]))
    messages = [repeats.cut_entries(suffix_dedup.KIND, sizes, b, ids[b::7], texts[b::7], hashes) for b in range(7)]
    group = suffix_dedup.SuffixOrder(run_bytes, block)
    for m in messages:
        for _, b, blob in m:
            if b < 0:
                group.add(blob)
                group._read()
    got = removed(group.removals()) | removed([[x for x in m if x[1] >= 0] for m in messages])
    if run_bytes == 500:
        assert len(group.queue.runs) > 3 and group.entries.file
    gone = brute_removal([(i, t.encode()) for i, t in zip(ids, texts)], 50)
    assert got == {(k % 7, k // 7, x) for k, own in enumerate(gone) for x in own}


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_hot_anchors_are_the_same_in_any_partitions(spark, module, monkeypatch):
    rng = random.Random(4)
    passage = " ".join(rng.choice("abcdef") + str(rng.randrange(99)) for _ in range(40))
    monkeypatch.setattr(repeats, "SAMPLE_LEAST", 1)
    monkeypatch.setattr(repeats, "HOT", 300)
    df = spark.createDataFrame([(i, f"{i} {rng.random()} " * rng.randrange(1, 4) + passage + f" {rng.random()}") for i in range(400)], "doc_id long, text string")
    few, many = (repeats.measure(module.KIND, df.repartition(n), None) for n in (4, 200))
    assert few.hot and few.hotter and few == many


def test_repeated_rows_are_worked_on_once(spark):
    text = "one text of more than fifty bytes that stands in very many rows of the table, all of them equal in id"
    df = spark.createDataFrame([(7, text)] * 500 + [(7, text + "x")] + [(9, text)] * 3, "doc_id long, text string").repartition(2)
    got = suffix_dedup.remove_covered(df).collect()
    assert sorted((r.doc_id, r.n, r.runs) for r in got) == [(7, len(text), [])] * 500 + [(7, len(text) + 1, [])] + [(9, len(text), [0, len(text)])] * 3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(60))
    passage = clean()
    rows = [(i, clean(), "en", "s", 0) for i in range(200)]
    for i in range(0, 200, 10):
        rows[i] = (i, rows[i][1] + " grumblefoot snarkish vilething", "en", "s", 0)
    rows += [(500, "token=abcdef0123456789abcdef0123 " + clean(), "en", "s", 0), (501, rows[3][1], "en", "s", 0), (502, clean() + " " + passage, "en", "s", 0), (503, None, None, None, None), (504, "", "", "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.count())
    assert kept == [205, 185, 183, 182, 182, 182]
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, done.collect())) == sorted(map(str, docs.collect()))
    ids = {r.doc_id for r in done.collect()}
    assert {500, 503} <= ids and not ids & {0, 10, 501, 502}
