"""Pipe text: the line grammar of recorded readings, parsed and written with column expressions only.

A line is a tag (TYPE_PAGE:, PIED_BRUT:, LOGO:, REVISIONS:, SECTION:, META: with JSON) or a row of cells between pipes.
Tags are looked for before pipes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, squeeze

# The tags of a line; words of footer rows.
TAGS = ("TYPE_PAGE", "PIED_BRUT", "LOGO", "REVISIONS", "SECTION", "META")
FOOTER_WORDS = ("N° PLAN", "NO PLAN", "INDICE", "BORNIER :", "CABLE :", "P.E.T")


def lines_of(raw: DataFrame, keys: list[str], text: str = "raw") -> DataFrame:
    """keys, line_idx, kind (tag in lower case, row, or other), body."""
    lines = raw.select(*keys, F.posexplode(F.split(filled(F.col(text)), r"\r?\n", -1)).alias("line_idx", "_line")).withColumn("_line", F.trim("_line")).where("_line <> ''")
    kind, body = F.when(F.contains("_line", F.lit("|")), "row").otherwise("other"), F.col("_line")
    for t in TAGS:
        at = F.startswith(F.upper("_line"), F.lit(t + ":"))
        kind, body = F.when(at, t.lower()).otherwise(kind), F.when(at, F.trim(F.substring("_line", len(t) + 2, 1 << 20))).otherwise(body)
    return lines.select(*keys, "line_idx", kind.alias("kind"), body.alias("body"))


def split_cells(body: Column) -> Column:
    """Segments of a pipe line without its outer pipes."""
    return F.transform(F.split(F.regexp_replace(body, r"^\s*\||\|\s*$", ""), r"\|", -1), lambda c: F.trim(c))


def fit_cells(parts: Column, n: int) -> Column:
    """Exactly ``n`` cells: short rows are padded; of too many segments the first n-2 stand, the middle ones join in the last but one, the last stays last."""
    size = F.size(parts)
    padded = F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)
    if n < 2:
        return F.when(size > n, F.array(F.array_join(parts, " "))).otherwise(padded)
    middle = F.array_join(F.slice(parts, F.lit(n - 1), F.greatest(size - n + 1, F.lit(1))), " ")
    over = F.concat(F.slice(parts, 1, n - 2) if n > 2 else F.array().cast("array<string>"), F.array(middle), F.array(F.element_at(parts, -1)))
    return F.when(size > n, over).otherwise(padded)


def is_footer(cells: Column) -> Column:
    text = F.upper(F.array_join(cells, " "))
    return F.array_contains(F.array(*[F.contains(text, F.lit(w)) for w in FOOTER_WORDS]), True)


def parse_rows(lines: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Data and section rows in order: keys, line_idx, row_type, cells, text. Empty and footer-like rows are dropped."""
    cells = fit_cells(split_cells(F.col("body")), n)
    rows = lines.where("kind IN ('row', 'section')").withColumn("cells", F.when(F.col("kind") == "row", cells).otherwise(F.array().cast("array<string>")))
    data = (F.col("kind") == "section") | (F.exists("cells", lambda c: c != "") & ~is_footer(F.col("cells")))
    return rows.where(data).select(*keys, "line_idx", F.when(F.col("kind") == "section", "section").otherwise("data").alias("row_type"), "cells", F.when(F.col("kind") == "section", F.col("body")).alias("text"))


def parse_meta(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The META map of each text, leniently: the outermost braces of the line, {} when they hold no object."""
    found = F.from_json(F.regexp_extract("body", r"(\{.*\})", 1), "map<string,string>")
    return lines.where("kind = 'meta'").groupBy(*keys).agg(F.min_by(F.coalesce(found, F.create_map().cast("map<string,string>")), "line_idx").alias("meta"))


def off_columns(lines: DataFrame, keys: list[str], n: int, examples: int = 5) -> DataFrame:
    """Rows whose number of segments is not ``n``: how many, and the first few."""
    odd = lines.where("kind = 'row'").where(F.size(split_cells(F.col("body"))) != n)
    return odd.groupBy(*keys).agg(F.count("*").alias("n"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct("line_idx", "body"))), 1, examples), lambda r: r["body"]).alias("examples"))


def ambiguous(lines: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first row with more than ``n`` segments."""
    return lines.where("kind = 'row'").where(F.size(split_cells(F.col("body"))) > n).groupBy(*keys).agg(F.min_by("body", "line_idx").alias("body"))


def repair(body: Column, n: int) -> tuple[Column, Column]:
    """State and cells under the stricter grammar: accepted, repaired (surplus joined to the last cell, or padded with [INCOMPLETE]) or rejected (one segment)."""
    parts = split_cells(body)
    size = F.size(parts)
    state = F.when(size == n, "accepted").when(size <= 1, "rejected").otherwise("repaired")
    surplus = F.concat(F.slice(parts, 1, n - 1), F.array(F.array_join(F.slice(parts, F.lit(n), F.greatest(size - n + 1, F.lit(1))), " ")))
    short = F.slice(F.concat(parts, F.array_repeat(F.lit("[INCOMPLETE]"), n)), 1, n)
    return state, F.when(size > n, surplus).otherwise(short)


def join_cells(cells: Column) -> Column:
    return F.concat_ws(" | ", F.transform(cells, lambda c: squeeze(c)))


def footer_pairs(text: Column, labels: list[str], last_wins: bool = True) -> Column:
    """map<label, value> of LABEL: value pairs in a line, cut at the starts of labels; of repeated labels the last (or first) stands."""
    import re

    names = "|".join(re.escape(x) for x in sorted(labels, key=len, reverse=True))
    keys = F.regexp_extract_all(text, F.lit(rf"(?i)({names})\s*:"), F.lit(1))
    values = F.slice(F.split(text, rf"(?i)(?:{names})\s*:"), F.lit(2), F.size(keys))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(F.upper(k).alias("key"), F.trim(F.regexp_replace(v, r"^\s+|\s+$", "")).alias("value")))
    keep = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)) if last_wins else F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(keep)


def split_type(footer: Column) -> Column:
    """The first word of TYPE stays; the others become COMPLEMENT unless that is given."""
    kind = F.try_element_at(footer, F.lit("TYPE"))
    rest = F.trim(F.regexp_replace(kind, r"^\S+\s*", ""))
    given = F.map_filter(footer, lambda k, v: k != "TYPE")
    more = F.when((rest != "") & F.try_element_at(footer, F.lit("COMPLEMENT")).isNull(), F.map_concat(given, F.create_map(F.lit("COMPLEMENT"), rest))).otherwise(given)
    return F.when(kind.isNull(), footer).otherwise(F.map_concat(more, F.create_map(F.lit("TYPE"), F.regexp_extract(kind, r"^(\S*)", 1))))


def merge_footer(copied: Column, meta: Column) -> Column:
    """The copied footer stands; META fills what it lacks."""
    return F.map_concat(copied, F.map_filter(meta, lambda k, v: F.try_element_at(copied, k).isNull()))


def footer_conflicts(pages: DataFrame, keys: list[str], copied: str, meta: str) -> DataFrame:
    """Labels on which the copied footer and META disagree beyond spacing: never silent."""
    from ..functions.text import compact

    a = pages.select(*keys, F.explode(copied).alias("label", "value"))
    b = pages.select(*keys, F.explode(meta).alias("label", "meta_value"))
    return a.join(b, [*keys, "label"]).where(compact(F.col("value")) != compact(F.col("meta_value")))


def revision_codes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct revision codes (first word of one or two capitals or digits) in order of first appearance."""
    code = F.regexp_extract("body", r"^([A-Z0-9]{1,2})(?:\s|$|\|)", 1)
    first = lines.where("kind IN ('revisions', 'other')").withColumn("code", code).where("code <> ''").groupBy(*keys, "code").agg(F.min("line_idx").alias("at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]).alias("codes"))
