"""Classes of discrepancies between two readings of a cell, and the report over them."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import groupby, zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, fold, normalise

# Confidences, distances and shares that decide a class.
SURE = 90
LOW = 60
SMALL = 2
JOIN_ZONES = 3
FAITHFUL = 0.98
NOISE_SIGNS = 3


def classify(ref: Column, conv: Column, conf: Column, known_ref: Column, known_conv: Column) -> tuple[Column, Column]:
    """Class and reason of a pair of cells, decided in order.

    Equal: identical. Equal when folded: benign. Blank reference or doubtful reading: benign. Under SURE, a
    known converted value beside an unknown reference, or a distance up to SMALL: benign. Else lost content, an
    unknown converted value, or a divergence.
    """
    fr, fc, c = fold(ref), fold(conv), F.coalesce(conf, F.lit(100))
    blank_ref, blank_conv = F.trim(filled(ref)) == "", F.trim(filled(conv)) == ""
    cases = [
        (filled(ref) == filled(conv), "identical", ""),
        (normalise(ref) == normalise(conv), "benign", "format"),
        (fr == fc, "benign", "confusion"),
        (blank_ref, "benign", "reference_blank"),
        (c < LOW, "benign", "low_confidence"),
        ((c < SURE) & known_conv & ~known_ref, "benign", "reference_unknown"),
        ((c < SURE) & (F.levenshtein(fr, fc) <= SMALL), "benign", "small"),
        (blank_conv, "check", "content_lost"),
        (known_ref & ~known_conv, "check", "converted_unknown"),
    ]
    kind, reason = F.lit("check"), F.lit("divergence")
    for when, k, r in reversed(cases):
        kind, reason = F.when(when, k).otherwise(kind), F.when(when, r).otherwise(reason)
    return kind, reason


def lone_row(text: Column, conf: Column, side: str) -> Column:
    """Reason for a row on one side only: noise, doubtful, or missing/surplus."""
    signs = F.length(F.regexp_replace(filled(text), r"[^\p{L}\p{N}]", ""))
    return F.when(signs < NOISE_SIGNS, "noise").when(F.coalesce(conf, F.lit(100)) < LOW, "low_confidence").otherwise("missing_row" if side == "ref" else "surplus_row")


def summary(diffs: DataFrame, *by: str) -> DataFrame:
    """Counts, concordance ((identical + benign) / all, 1 if nothing was compared) and whether it is faithful. ``diffs`` has class and n_cells."""
    n = lambda *k: F.sum(F.when(F.col("class").isin(*k), F.col("n_cells")).otherwise(0)).cast("long")
    out = diffs.groupBy(*by).agg(n("identical").alias("identical"), n("benign").alias("benign"), n("check").alias("to_check"), F.sum("n_cells").cast("long").alias("cells"))
    rate = F.when(F.col("cells") > 0, (F.col("identical") + F.col("benign")) / F.col("cells")).otherwise(1.0)
    return out.withColumn("concordance", rate).withColumn("faithful", rate >= FAITHFUL)


def precision(cells: DataFrame, *by: str) -> DataFrame:
    """Identical / compared, 1 when nothing was compared. A lone reference row counts as compared and, having no class, as identical: measured figures rest on it."""
    gaps = F.sum(F.when(F.col("class").isNotNull() & (F.col("class") != "identical"), 1).otherwise(0))
    total = F.count("*")
    return cells.groupBy(*by).agg(total.alias("compared"), gaps.alias("gaps"), F.when(total > 0, 1 - gaps / total).otherwise(1.0).alias("precision"))


def zones(a: str, b: str, join: int = JOIN_ZONES) -> list[tuple[int, int, int, int]]:
    """Places where two texts differ, those with fewer than ``join`` equal signs between them as one."""
    apart = [s[1:] for s in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if s[0] != "equal"]
    first = [k for k, s in enumerate(apart) if not k or s[0] - apart[k - 1][1] >= join]
    return [(apart[k][0], apart[e - 1][1], apart[k][2], apart[e - 1][3]) for k, e in zip(first, [*first[1:], len(apart)])]


class Run:
    """Neighbouring cells read as one text; ``owner`` says which cell each sign stands in."""

    def __init__(self, cells: list[str], first: int):
        self.text = "".join(cells)
        self.owner = [first + k for k, c in enumerate(cells) for _ in c]

    def columns(self, s: int, e: int) -> set[int]:
        """The cells of the signs s..e; of a place between signs, the cell that holds both."""
        if s < e:
            return set(self.owner[s:e])
        return set(self.owner[max(0, s - 1) : s]) & set(self.owner[s : s + 1])


def row_zones(ref: list[str], conv: list[str]) -> list[tuple[list[int], str, str]]:
    """Differing zones of two folded rows: columns, reference segment, converted segment. Equal cells are anchors; runs of differing cells are compared as one text, so text that slid over a border is no zone."""
    out = []
    pairs = list(zip_longest(ref, conv, fillvalue=""))
    for differs, some in groupby(range(len(pairs)), key=lambda k: pairs[k][0] != pairs[k][1]):
        if differs:
            own = list(some)
            a, b = (Run([pairs[k][side] for k in own], own[0]) for side in (0, 1))
            for i1, i2, j1, j2 in zones(a.text, b.text):
                out.append((sorted(a.columns(i1, i2) | b.columns(j1, j2)) or [own[-1]], a.text[i1:i2], b.text[j1:j2]))
    return out


def zones_of(rows: DataFrame, ref: str = "ref_cells", conv: str = "conv_cells") -> DataFrame:
    """``rows`` (arrays of folded cells) with one row per differing zone: columns, ref_segment, conv_segment."""

    @F.pandas_udf("array<struct<columns:array<int>,ref_segment:string,conv_segment:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"columns": c, "ref_segment": x, "conv_segment": y} for c, x, y in row_zones(list(p), list(q))] for p, q in zip(a, b)])

    return rows.withColumn("zone", F.explode(run(F.transform(ref, lambda c: fold(c)), F.transform(conv, lambda c: fold(c))))).select(*[c for c in rows.columns if c not in (ref, conv)], "zone.*")


def footer_gaps(ref: DataFrame, conv: DataFrame, key: list[str], strict: list[str] = ()) -> DataFrame:
    """Labels whose values differ (key, label, ref_value, conv_value, class): spacing counts only for ``strict`` labels. Inputs hold key, label, value."""
    from ..functions.text import squeeze, without_space

    a, b = ref.select(*key, "label", F.col("value").alias("ref_value")), conv.select(*key, "label", F.col("value").alias("conv_value"))
    both = a.join(b, [*key, "label"], "full_outer")
    kind = F.when(squeeze(F.col("ref_value")) == squeeze(F.col("conv_value")), "identical").when(without_space(F.col("ref_value")) == without_space(F.col("conv_value")), "spacing")
    kind = kind.when(F.trim(filled(F.col("ref_value"))) == "", "added").when(F.trim(filled(F.col("conv_value"))) == "", "missing").otherwise("different")
    return both.withColumn("class", kind).where((F.col("class") != "identical") & ((F.col("class") != "spacing") | F.col("label").isin(*strict) if strict else F.col("class") != "spacing"))
