import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fp string, bucket string, key string, held string, runs string, score string, n_words string"


def rows(pairs):
    return [(i, t, None, "src0", None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in pairs]


def words(rng, n, vocab=60):
    return " ".join(rng.choice(["w", "Wé", "ß", "the"]) + str(rng.randrange(vocab)) for _ in range(n))


@pytest.fixture(scope="session")
def cases():
    """Ids and texts: nulls, empty and blank texts, ties, repeated rows, one id with two texts, odd characters, a very long text, shared passages."""
    rng = random.Random(5)
    passage, long_text = words(rng, 40), words(rng, 60_000, 5000)
    out = [(1, None), (None, "a null id with some words " + passage), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, passage), (6, passage), (7, "before " + passage + " after"), (8, words(rng, 30)), (8, words(rng, 30))]
    out += [(9, "İstanbul ΣΑΣ ﻿ 你好 \x00\x1c 🙂👍🏽 <|endoftext|> it's"), (10, long_text), (11, long_text[1000:3000] + " x " + passage[:120]), (12, passage[3:180]), (13, "ab " * 80), (14, "ab " * 90), (15, "\x0b\x0cform feed\r\nline")]
    out += [(20 + k, words(rng, rng.randrange(1, 80), 12)) for k in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, cases):
    return spark.createDataFrame(rows(cases), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
