"""Scores against a plain scorer, quotation, and accuracy on rows never learned from."""

import math
import os
import random
import re

import numpy as np
import pytest

from ledgerleaf.llm import toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.1").replace("sf0.001", "sf0.1")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def slow_quoted(text, s, e):
    """Pairs of marks on the hit's line, by one scan from its start."""
    pairs = {'"': '"', "“": "”", "„": "“”", "”": "”", "«": "»", "»": "«", "‹": "›", "›": "‹", "‘": "’", "’": "’"}
    at = text.rfind("\n", 0, s) + 1
    stack, found = [], []
    while at < len(text) and text[at] != "\n":
        c = text[at]
        word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
        if c in pairs and not (c in "‘’" and word(at - 1) and (c == "‘" or word(at + 1))):
            inner = [k for k, (m, _) in enumerate(stack) if c in pairs[m]]
            if inner:
                found.append((stack[inner[-1]][1], at))
                del stack[inner[-1] :]
            elif not word(at - 1):
                stack.append((c, at + 1))
        at += 1
    w = toxicity.WINDOW
    return any(s - w <= a <= s and e <= b <= e + w for a, b in found)


def slow_score(model, text):
    text = text.lower()
    weights, near_words = model.lexicon.weights, model.lexicon.near
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text)]
    abuse = strongest = near = quoted = 0.0
    plain = close = 0
    last, once = -10_000, set()
    for w, s, e in words:
        entry = w if w in weights else next((w[:k] + "*" for k in range(min(len(w), 8), 2, -1) if w[:k] + "*" in weights), None)
        kind = "exact"
        if entry is None:
            some = [(d, n) for n in near_words if (d := distance(w, n)) <= min(toxicity.edits(w), toxicity.edits(n))] if toxicity.edits(w) else []
            if not some:
                continue
            entry, kind = min(some)[1], "near"
        close += s - last <= toxicity.WINDOW
        last = e
        if w in once:
            continue
        once.add(w)
        v = weights[entry]
        if slow_quoted(text, s, e):
            quoted += v
        elif kind == "near":
            near += v
        else:
            abuse, strongest, plain = abuse + v, max(strongest, v), plain + 1
    x = np.round([1.0, math.log1p(abuse), strongest, math.log1p(plain), math.log1p(near), math.log1p(quoted), min(3.0, math.log1p(close) + 20.0 * len(once) / max(20, len(words)))], 3)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(x @ model.weights)))))


def test_scores_against_a_plain_scorer(spark):
    rng = random.Random(11)
    model = toxicity.Model(toxicity.Lexicon({"grumblefoot": 3.0, "snark*": 1.5, "vilething": 2.5, "dolt": 2.0}, ["grumblefoot", "vilething"]), toxicity.PRIOR)
    parts = ["grumblefoot", "grumblefot", "Vilethings", "vi1ething", "snarkish", "dolt", "dolts", "it's", "don’t", '"', "“", "”", "‘", "’", "«", "»", "\n", "alpha", "beta", "gamma.", "the", "of"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))).replace("“ ", "“").replace(" ”", "”") for _ in range(300)]
    texts += ["", "alpha " * 30_000 + "dolt", "grumblefoot " * 20_000, '"dolt" ' * 5_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (5, texts[5], "x")], "doc_id long, text string, score string")
    got = toxicity.score(df, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = slow_score(model, texts[r.doc_id] if r.doc_id is not None else "")
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.3)


@pytest.mark.parametrize("text, quoted", [("you’re an idiot and you don’t know it", False), ("you're an idiot, aren't you", False), ('he said "you idiot" to me', True), ("he said “you idiot” to me", True), ("he said ‘you idiot’ to me", True), ("“no” idiot “yes”", False), ("« idiot »", True), ('"a\nidiot" x', False), ("„du idiot“", True), ("the dogs’ idiot ’", False)])
def test_quotation_is_told_from_abuse(text, quoted):
    x = toxicity.Lexicon({"idiot": 3.0}, []).features(text)
    assert (x[5] > 0) == quoted and (x[1] > 0) != quoted


def test_the_fit_finds_the_least_cost():
    """Also where whole steps of Newton's method overshoot: no direction leads further down."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((400, 1)), rng.gamma(1.0, 2.0, (400, 6))], axis=1)
    n = rng.integers(1, 60, 400).astype(float)
    toxic = np.where(x[:, 2] > 4.0, n, 0.0)
    toxic[:3] = n[:3] / 2

    def cost(w):
        z = x @ w
        return np.sum(n * np.logaddexp(0, z) - toxic * z) + 0.5 * np.sum(toxicity.PRIOR_STRENGTH * (w - toxicity.PRIOR) ** 2)

    w = toxicity.fit_weights(x, toxic, n)
    assert all(cost(w + 1e-3 * d) > cost(w) for d in [*np.eye(7), *-np.eye(7), *rng.normal(size=(50, 7))])


def test_every_entry_is_kept():
    """Neither the lexicon nor its misspellings are cut at a number."""
    words = [f"{a}{b}{c}term" for a in "bcdfgh" for b in "aeiou" for c in "klmnpqrstv"]
    lexicon = toxicity.Lexicon({w: 2.0 for w in words}, words)
    assert all(lexicon.look_up(w[:3] + "x" + w[3:])[0] == "near" for w in words)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = toxicity.score(some, toxicity.fit(docs, labels)).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit, found, wanted = (sum(1 for r in got if p(r)) for p in (lambda r: r.predicted and r.toxic, lambda r: r.predicted, lambda r: r.toxic))
    assert wanted > 100 and hit >= 0.9 * wanted and hit >= 0.9 * found
