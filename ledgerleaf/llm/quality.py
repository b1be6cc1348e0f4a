"""Quality rules, line first: each line is judged by itself, failing lines are removed, and a
document that loses too much of its text is rejected.

Line rules (w: words of the line): navigation (three or more of ``|•»``, one for every three words
at least), symbols (more than one of ``#*$%&<>`` for every five words), shouting (five words or
more and over twice as many capitals as small letters, A-Z), no punctuation (eight words or more without
any of ``.,:;!?…``), boilerplate (a phrase of BOILERPLATE). A line equal to an earlier one is removed as well, but
counts as no loss: repetition is judged by the document's repeated words.

Words: runs of anything but the six ASCII white-space characters.

Defined results: a null or empty text has no words and fails the base; repeated rows each give a
row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_arrow

LEAST_WORDS = 50
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = r"cookie|all rights reserved|licensed under|terms of (?:use|service)|privacy policy|javascript|click here|subscribe|copyright"
_BOILERPLATE = re.compile(BOILERPLATE.encode(), re.I)
_CAPITALS, _SMALL = (bytes(range(a, a + 26)) for a in (65, 97))
_NAV, _SYM, _PUNCT = (re.compile(p.encode()) for p in ("[|]|•|»", "[#*$%&<>]", "[.,:;!?]|…"))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, cleaned string"


def line_fails(line: bytes, w: int) -> bool:
    """Whether a line of ``w`` words breaks a rule."""
    n = len(line)
    nav = line.count(b"|") + (len(_NAV.findall(line)) - line.count(b"|") if b"\xe2" in line or b"\xc2" in line else 0)
    if nav >= 3 and 3 * nav >= w:
        return True
    if 5 * (n - len(line.translate(None, b"#*$%&<>"))) > w:
        return True
    if w >= 5 and n - len(line.translate(None, _CAPITALS)) > 2 * (n - len(line.translate(None, _SMALL))):
        return True
    return w >= 8 and not _PUNCT.search(line) or bool(_BOILERPLATE.search(line))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    _, pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, window, n = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[window] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(twice)] |= twice
    return int(hit.sum())


def judge(text: str) -> tuple[int, int, int, int, int, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words and the cleaned text."""
    raw = text.encode()
    words = raw.split()
    seen: set[bytes] = set()
    kept: list[bytes] = []
    dup = lost = 0
    for line in raw.split(b"\n"):
        w = len(line.split())
        if not w:
            kept.append(line)
        elif line in seen:
            dup += 1
            lost += w if line_fails(line, w) else 0
        else:
            seen.add(line)
            if line_fails(line, w):
                lost += w
            else:
                kept.append(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lost, b"\n".join(kept).decode()


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the counts of ``judge``, base_failed, kept and the cleaned text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*[judge(t) for t in batch.column(1).to_pylist()])) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in got[:6]), pa.array(got[6], pa.string())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "cleaned"])

    rows = map_arrow(id_text(docs, id_col, text_col), run, SCHEMA)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (2 * F.col("lost_words") <= F.col("n_words")))


def report(cleaned: DataFrame) -> DataFrame:
    """The contract's columns, with the length of the cleaned text."""
    return cleaned.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.length("cleaned").cast("long").alias("n_clean_chars"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, p, array_to_string(w[p : p + 2], ' ') AS s FROM w, unnest(range(1, len(w) - 1)) AS u(p)),
rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1) x, unnest(range(p, p + 3)) AS u(q) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d),
l1 AS (SELECT r, l, i, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY r, l ORDER BY i) AS k FROM l0),
l2 AS (SELECT *, w > 0 AND ((len(regexp_extract_all(l, '[|•»]')) >= 3 AND 3 * len(regexp_extract_all(l, '[|•»]')) >= w)
  OR 5 * len(regexp_extract_all(l, '[#*$%&<>]')) > w
  OR (w >= 5 AND len(regexp_extract_all(l, '[A-Z]')) > 2 * len(regexp_extract_all(l, '[a-z]')))
  OR (w >= 8 AND NOT regexp_matches(l, '[.,:;!?…]'))
  OR regexp_matches(l, '(?i)BOILERPLATE')) AS fails FROM l1),
l AS (SELECT r, count(*) FILTER (w > 0 AND k > 1) AS dup, sum(CASE WHEN fails THEN w ELSE 0 END) AS lost, length(string_agg(l, chr(10)) FILTER (w = 0 OR (k = 1 AND NOT fails))) AS clean FROM l2 GROUP BY r),
a AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(l.dup AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, l.lost, CAST(coalesce(l.clean, 0) AS BIGINT) AS n_clean_chars
FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= n_words AS kept, n_clean_chars FROM a
""".replace("BOILERPLATE", BOILERPLATE)
