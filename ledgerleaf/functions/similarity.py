"""Comparisons that column expressions cannot state, as plain functions and as Arrow functions over them.

``ratio`` is the share of matching symbols by recursive longest common blocks (strings or lists),
which is no edit distance: only Python's difflib gives its exact values. ``levenshtein`` is
Spark's own and needs nothing here.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs of signs that a reader takes for each other, when two readings of a cell are classed.
CONFUSED_PAIRS = ("1I", "1L", "IL", "0O", "0D", "DO", "5S", "8B", "2Z", "6G", "PF", " _", "'\"", "R_", "MN", "EF", "CG", "HK", "UV", "VY", "17", "RK", "TI")

IDENTICAL, SPACING, CONFUSION, ADDED, MISSING, DIFFERENT, SHIFTED = "identical", "spacing", "confusion", "added", "missing", "different", "shifted"


def blocks(a: Sequence, b: Sequence) -> list[tuple[str, int, int, int, int]]:
    return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


@lru_cache(maxsize=1 << 16)
def _ratio(a, b) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def ratio(a: str | Sequence, b: str | Sequence) -> float:
    """Similarity from 0 to 1; two empty ones are equal."""
    if a == b:
        return 1.0
    return _ratio(a, b) if isinstance(a, str) else SequenceMatcher(None, a, b, autojunk=False).ratio()


def indel(a: str, b: str) -> int:
    """Signs to take out and put in along the matching blocks."""
    kept = sum(i2 - i1 for op, i1, i2, _, _ in blocks(a, b) if op == "equal")
    return len(a) + len(b) - 2 * kept


def _pairwise(f, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x, y) for x, y in zip(a, b)])

    return run


def ratio_of(a: Column, b: Column) -> Column:
    return _pairwise(lambda x, y: float(ratio(x or "", y or "")), "double")(a, b)


def indel_of(a: Column, b: Column) -> Column:
    return _pairwise(lambda x, y: indel(x or "", y or ""), "int")(a, b)


def edits_of(a: Column, b: Column) -> Column:
    """array<struct<lost, won>> of two texts: what stands in place of what, block by block."""

    @F.pandas_udf("array<struct<lost:string,won:string>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[] if p == q else [{"lost": p[i1:i2], "won": q[j1:j2]} for op, i1, i2, j1, j2 in blocks(p, q) if op != "equal"] for p, q in zip(x, y)])

    return run(a, b)


def cell_class(ref: Column, conv: Column) -> Column:
    """What separates two readings of a cell. An empty and a one-sign reading count as a confusion, which is tested before added and missing.

    Only the blocks in which two readings differ come from Python, and only for readings that differ by more than blanks; the rule
    is a column expression over them.
    """
    from .text import squeeze, without_space

    known = [F.lit("".join(sorted(p))) for p in CONFUSED_PAIRS]
    a, b = squeeze(ref), squeeze(conv)
    apart = without_space(ref) != without_space(conv)
    edits = edits_of(F.when(apart, a).otherwise(""), F.when(apart, b).otherwise(""))

    def confused(e: Column) -> Column:
        pair = F.array_join(F.array_sort(F.array(e["lost"], e["won"])), "")
        slip = (e["lost"] == "") | (e["won"] == "") | pair.isin(*known)
        return slip & (F.length(e["lost"]) <= 1) & (F.length(e["won"]) <= 1)

    return F.when(a == b, IDENTICAL).when(~apart, SPACING).when((F.size(edits) <= 2) & F.forall(edits, confused), CONFUSION).when(a == "", ADDED).when(b == "", MISSING).otherwise(DIFFERENT)


def shifted(ref: Column, conv: Column) -> Column:
    """array<boolean> over the cells of a row: whether words moved between this cell and a neighbour, one losing exactly the words that the other gains, and nothing else changed in either."""
    from ..operators.dedup import bag_minus
    from .text import words

    of = lambda row, k: words(F.coalesce(F.get(row, k), F.lit("")))
    places = F.sequence(F.lit(0), F.greatest(F.size(ref), F.size(conv), F.lit(1)) - 1)
    changes = F.transform(places, lambda k: F.struct(bag_minus(of(ref, k), of(conv, k)).alias("lost"), bag_minus(of(conv, k), of(ref, k)).alias("won")))
    gives = lambda x, y: (F.size(x["lost"]) > 0) & (x["lost"] == y["won"]) & (F.size(x["won"]) == 0) & (F.size(y["lost"]) == 0)
    nothing = F.struct(F.array().cast("array<string>").alias("lost"), F.array().cast("array<string>").alias("won"))
    # each cell beside the one before and the one after it
    before = F.concat(F.array(nothing), changes)
    after = F.concat(F.slice(changes, F.lit(2), F.greatest(F.size(changes) - 1, F.lit(0))), F.array(nothing))
    near = F.arrays_zip(changes.alias("own"), before.alias("left"), after.alias("right"))
    return F.transform(F.slice(near, F.lit(1), F.size(places)), lambda x: gives(x["own"], x["left"]) | gives(x["left"], x["own"]) | gives(x["own"], x["right"]) | gives(x["right"], x["own"]))


def closest(value: str, known: Sequence[str], cutoff: float = 0.82) -> str | None:
    """The known value most like ``value``, at ``cutoff`` or more; the greatest of equals."""
    best = max(((ratio(k, value), k) for k in known), default=(0.0, ""))
    return best[1] if best[0] >= cutoff and best[1] else None
