"""Data-quality rules over cells: each gives alerts (page_idx, row_idx, col_idx, rule, message, proposal, pair).

A rule never changes a value. Guard-rails turn a rule that fires too often into one synthesis row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, numbered, page_key, squeeze

# Signs that are taken for each other within a document, and those a lexicon may correct; shares and frequencies of the rules.
CONFUSIONS = (("O", "C"), ("O", "0"), ("I", "1"), ("S", "5"), ("B", "8"))
LEXICON_CONFUSIONS = (("O", "C"), ("O", "0"), ("O", "D"), ("O", "Q"), ("I", "1"), ("I", "L"), ("S", "5"), ("B", "8"), ("Z", "2"), ("G", "6"), ("E", "F"))
LONG_ENOUGH = 4
LEAST_MAJORITY = 2
MAJORITY_RATIO = 1.5
GUARD = 0.20
ALERT = ("page_idx", "row_idx", "col_idx", "rule", "message", "proposal", "pair")


def _alert(rows: DataFrame, rule: str, message: Column, keys: tuple[str, ...], proposal: Column | None = None, pair: Column | None = None) -> DataFrame:
    null = F.lit(None).cast("string")
    own = {c: F.col(c).cast("int") if c in rows.columns else F.lit(None).cast("int") for c in ALERT[:3]}
    return rows.select(*keys, *[own[c].alias(c) for c in ALERT[:3]], F.lit(rule).alias("rule"), message.alias("message"), (proposal if proposal is not None else null).alias("proposal"), (pair if pair is not None else null).alias("pair"))


def variants(form: Column, pairs: tuple[tuple[str, str], ...] = CONFUSIONS) -> Column:
    """array<struct<variant, pair>> of a form with one sign exchanged by each pair, either way; digits are never exchanged for digits."""

    def exchanged(x: str, y: str) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(form), F.lit(1))), lambda i: F.substring(form, i, F.lit(1)) == x)
        return F.transform(at, lambda i: F.struct(F.concat(F.substring(form, F.lit(1), i - 1), F.lit(y), F.substring(form, i + 1, F.length(form))).alias("variant"), F.lit(x + y).alias("pair")))

    return F.flatten(F.array(*[exchanged(x, y) for a, b in pairs for x, y in ((a, b), (b, a)) if not (x.isdigit() and y.isdigit())]))


def cell_forms(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Words long enough and the whole cell, in capitals, once per cell: keys, page_idx, row_idx, col_idx, form."""
    whole = F.upper(squeeze(F.col("value")))
    some = F.array_distinct(F.concat(F.array(whole), F.filter(F.split(whole, " "), lambda w: F.length(w) >= LONG_ENOUGH)))
    return cells.select(*keys, "page_idx", "row_idx", "col_idx", F.explode(F.filter(some, lambda f: F.length(f) >= LONG_ENOUGH)).alias("form"))


def coherence(cells: DataFrame, keys: list[str], lexicon: DataFrame | None = None) -> DataFrame:
    """A form one confusion away from a clearly more frequent form (or, failing that, from a lexicon form) is flagged, longest form first, one alert per cell. Forms of the lexicon are right."""
    forms = cell_forms(cells, keys)
    counts = forms.groupBy(*keys, "form").agg(F.count("*").alias("n"))
    suspects = counts.join(lexicon.select(F.upper("form").alias("form")).distinct(), "form", "left_anti") if lexicon is not None else counts
    tries = suspects.withColumn("v", F.explode(variants(F.col("form"), LEXICON_CONFUSIONS if lexicon is not None else CONFUSIONS))).select(*keys, "form", "n", F.col("v.variant").alias("variant"), F.col("v.pair").alias("pair"))
    better = tries.join(counts.select(*keys, F.col("form").alias("variant"), F.col("n").alias("m")), [*keys, "variant"]).where((F.col("m") >= LEAST_MAJORITY) & (F.col("m") >= MAJORITY_RATIO * F.col("n")))
    if lexicon is not None:
        known = tries.join(lexicon.select(F.upper("form").alias("variant")).distinct(), "variant").select(*keys, "variant", "form", "n", "pair", F.lit(0).cast("long").alias("m"))
        better = better.select(*known.columns).unionByName(known)
    best = better.groupBy(*keys, "form").agg(F.max(F.struct("m", "variant", "pair")).alias("best"))
    w = Window.partitionBy(*keys, "page_idx", "row_idx", "col_idx").orderBy(F.desc(F.length("form")), "form")
    first = forms.join(best, [*keys, "form"]).withColumn("place", F.row_number().over(w)).where("place = 1")
    return _alert(first, "coherence", F.concat(F.col("form"), F.lit(" -> "), F.col("best.variant")), tuple(keys), F.col("best.variant"), F.col("best.pair"))


def guard_rail(alerts: DataFrame, totals: DataFrame, keys: list[str], share: float = GUARD) -> DataFrame:
    """Alerts of a group (keys, rule) stay while they are at most ``share`` of its total; beyond, one synthesis row with no place replaces them."""
    n = alerts.groupBy(*keys, "rule").agg(F.count("*").alias("_n"))
    judged = n.join(totals.select(*keys, F.col("total").alias("_total")), keys).withColumn("_over", F.col("_n") > share * F.col("_total"))
    kept = alerts.join(judged.where("NOT _over").select(*keys, "rule"), [*keys, "rule"], "left_semi")
    one = _alert(judged.where("_over").withColumnRenamed("rule", "_rule"), "", F.concat(F.col("_n"), F.lit(" of "), F.col("_total")), (*keys, "_rule")).withColumn("rule", F.col("_rule")).drop("_rule")
    return kept.unionByName(one.select(*kept.columns))


def off_format(cells: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """Non-blank cells that do not match their column's pattern as a whole; columns without a pattern always match. ``patterns`` (col_name, pattern) is small by nature: one row per column of a format."""
    joined = cells.where(F.trim(filled(F.col("value"))) != "").join(F.broadcast(patterns), "col_name")
    return _alert(joined.where(~F.expr("rlike(trim(value), concat('^(?:', pattern, ')$'))")), "format", F.concat(F.col("col_name"), F.lit(": "), F.col("value")), tuple(keys))


def empty_columns(cells: DataFrame, mandatory: list[str], keys: list[str]) -> DataFrame:
    """Mandatory columns that are blank in every data row of a page."""
    per = cells.where(F.col("row_type") == "data").where(F.col("col_name").isin(*mandatory)).groupBy(*keys, "page_idx", "col_idx", "col_name").agg(F.max((F.trim(filled(F.col("value"))) != "").cast("int")).alias("any"))
    return _alert(per.where("any = 0"), "empty_column", F.col("col_name"), tuple(keys))


def off_dictionary(cells: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Values that their column's dictionary (col_name, value) lacks, where there is one."""
    some = cells.where(F.trim(filled(F.col("value"))) != "").join(known.select("col_name").distinct(), "col_name", "left_semi")
    named = known.select("col_name", F.upper("value").alias("_known")).distinct()
    missing = some.join(named, (some.col_name == named.col_name) & (F.upper(some.value) == named._known), "left_anti")
    return _alert(missing, "dictionary", F.col("value"), tuple(keys))


def continuity(cells: DataFrame, column: str, keys: list[str], jump: int = 20) -> DataFrame:
    """Numbers that fall or jump by more than ``jump`` in the sequence of a code; a section row starts all sequences anew.

    A state machine of two values per code: after an alert the sequence goes on from either the value before or the
    flagged one, so one slip gives one alert. It runs per page in order.
    """
    some = cells.where((F.col("col_name") == column) | (F.col("row_type") == "section")).withColumn("read", numbered(F.col("value")))
    flat = some.select(*keys, "page_idx", "row_idx", "col_idx", "row_type", F.col("read.prefix").alias("code"), F.col("read.number").alias("number"))
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        state: dict[str, tuple[int, int | None]] = {}
        for r in pdf.sort_values(["row_idx", "col_idx"]).itertuples(index=False):
            if r.row_type == "section":
                state = {}
            elif r.row_type == "data" and r.code is not None and r.number == r.number:
                n = int(r.number)
                sure, doubt = state.get(r.code, (None, None))
                if sure is None or 0 <= n - sure <= jump or doubt is not None and 0 <= n - doubt <= jump:
                    state[r.code] = (n, None)
                else:
                    out.append((*[getattr(r, k) for k in keys], r.page_idx, r.row_idx, r.col_idx, f"{sure} then {n}"))
                    state[r.code] = (sure, n)
        return pd.DataFrame(out, columns=[*keys, "page_idx", "row_idx", "col_idx", "message"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", page_idx int, row_idx int, col_idx int, message string"
    return _alert(flat.groupBy(*keys, "page_idx").applyInPandas(run, schema), "continuity", F.col("message"), tuple(keys))


def page_sequence(pages: DataFrame, keys: list[str], label: str = "label", order: str = "page_idx") -> DataFrame:
    """Against the last readable page number before: unreadable, repeated or decreasing labels. An unreadable one does not count as last."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    keyed = pages.withColumn("_key", page_key(F.col(label)))
    before = keyed.withColumn("_last", F.last("_key", ignorenulls=True).over(w))
    kind = F.when(F.col("_key").isNull(), "unreadable").when(F.col("_key") == F.col("_last"), "repeated").when(F.col("_key") < F.col("_last"), "decreasing")
    return before.withColumn("alert", kind).where("alert IS NOT NULL").select(*keys, order, label, "alert")


def merge_alerts(alerts: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per cell: distinct messages in order joined by '; ', the first proposal."""
    first = F.col(order) if order else F.col("rule")
    some = F.array_sort(F.collect_list(F.struct(first.alias("o"), F.col("message").alias("m"), F.col("proposal").alias("p"))))
    out = alerts.groupBy(*keys).agg(some.alias("all"))
    return out.select(*keys, F.array_join(F.array_distinct(F.transform("all", lambda a: a["m"])), "; ").alias("messages"), F.get(F.filter(F.transform("all", lambda a: a["p"]), lambda p: p.isNotNull()), F.lit(0)).alias("proposal"), F.size("all").alias("n_alerts"))


#: Rules by name; those off by default gave more false alerts than true ones when measured.
RULES: dict[str, bool] = {"coherence": True, "dictionary": False, "continuity": False, "empty_column": True, "format": True}


def control(rules: dict[str, Callable[[], DataFrame]], enabled: dict[str, bool] | None = None) -> DataFrame | None:
    """The union of the enabled rules' alerts; running it again gives the same alerts, since it replaces and never appends."""
    on = {**RULES, **(enabled or {})}
    found = [make() for name, make in rules.items() if on.get(name)]
    return reduce(DataFrame.unionByName, found) if found else None


def line_count_decisions(pages: DataFrame, keys: list[str], share: float = GUARD, small: int = 2) -> DataFrame:
    """``pages`` (visible, read, exact) with a decision: vector pages alert on any difference; scans of which over ``share`` are off are not judged; else one or two lines off is an alert, more is uncertain, and lines seen but none read is lost."""
    off = F.col("visible") - F.col("read")
    scans = Window.partitionBy(*keys, "exact")
    rate = F.avg((off != 0).cast("double")).over(scans)
    kind = F.when(off == 0, "ok").when(F.col("exact"), "alert").when((F.col("visible") > 0) & (F.col("read") == 0), "lost").when(rate > share, "not_judged").when(F.abs(off) <= small, "alert").otherwise("uncertain")
    return pages.withColumn("decision", kind)
