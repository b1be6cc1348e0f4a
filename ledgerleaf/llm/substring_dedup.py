"""Substring deduplication over prefix-partitioned suffix trees.

Suffixes are the places of the anchors of ``repeats``: every window of 13 words starts at most
nine words before one. They are split by prefixes of variable length into groups that fit in memory: the
anchor's four words; nine words, to the right or to the left of the anchor, where the group under four would
outgrow its bound; all thirteen where that one would too. Within a group the trees are grown level
by level from the anchor on, to the right for what follows it and to the left for what
stands before it; a node with a single suffix is a leaf and is grown no further. A window is a pair of
a right and a left node whose depths add up to thirteen: where such a node is an
internal one, its suffixes form a maximal repeat, and all but those of the smallest document are removed.

Defined results: a null or empty text has no words and loses none; fewer than 13 words cannot
repeat; a null doc_id is left whole and removes nothing; equal ids do not remove from each other; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .repeats import Entries, Kind, later, remove_repeats, renumber, summary, unpack

KIND = Kind(words=True, window=13, gram=4)


def grow(e: Entries, node: np.ndarray, d: int) -> np.ndarray:
    """The nodes one symbol deeper, by the symbol at distance ``d`` from the anchor."""
    return renumber(node, e.column(d))


def solve(kind: Kind, e: Entries) -> tuple[Entries, np.ndarray]:
    """Entries of internal nodes, with a flag for each offset of a window that an earlier document holds."""
    top = kind.window - kind.gram
    node = np.zeros(len(e.doc), np.int64)
    e = e.keep(np.arange(len(e.doc)))
    for d in range(kind.gram):  # down to the prefix; leaves fall away
        node = grow(e, node, d)
        inner = np.bincount(node)[node] > 1
        e, node = e.keep(inner), node[inner]
    flags = np.zeros((len(e.doc), top + 1), bool)
    if len(e.doc):
        right = {kind.gram: node}
        for d in range(kind.gram, kind.window):
            right[d + 1] = grow(e, right[d], d)
        left = node
        for o in range(top + 1):
            if o:
                left = grow(e, left, -o)
            ok = np.flatnonzero(e.holds(o))
            flags[ok, top - o] = later(renumber(right[kind.window - o][ok], left[ok]), e.doc[ok])
    return e, flags


class Tree:
    """One group of prefixes, whose size the choice of prefixes bounds."""

    def __init__(self) -> None:
        self.payloads: list[list] = []

    def add(self, blob: bytes) -> None:
        self.payloads.append(unpack(blob))

    def removals(self) -> Iterator[list[tuple[int, int, bytes]]]:
        if self.payloads:
            e = Entries(KIND, self.payloads)
            self.payloads = []
            if len(e.doc):
                yield e.removals(solve(KIND, e))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (words), runs of removed words, kept (the other words, joined by one space)."""
    return remove_repeats(KIND, Tree, docs, id_col, text_col, hot)


def report(found: DataFrame) -> DataFrame:
    return summary(found, "n_words").drop("n_spans")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda p: array_to_string(w[p : p + 12], ' '))) AS s FROM d WHERE len(w) >= 13),
low AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, q FROM win JOIN low USING (s), unnest(range(p, p + 13)) AS u(q) WHERE win.doc_id > low.low),
each AS (SELECT r, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM each ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
