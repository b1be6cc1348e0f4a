"""Lines, columns and blocks from positions, and positions in delivered sheets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from .running import folded, running_total

# Blank rows are added above this many heights of gap, at most three; rows of a sheet page and of its footer.
BLANK_FROM = 1.6
MOST_BLANKS = 3
SHEET_ROWS = 59
FOOTER_ROWS = 2


def lines_by_gap(words: DataFrame, group: list[str], y: str, tolerance: float, tie: str) -> DataFrame:
    """A line ends where the next y is more than ``tolerance`` from the one before: line numbers from 0."""
    w = Window.partitionBy(*group).orderBy(y, tie)
    new = (F.abs(F.col(y) - F.lag(y).over(w)) > tolerance).cast("int")
    return words.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("line", F.sum("_new").over(w).cast("int")).drop("_new")


def _fold_lines(words: DataFrame, group: list[str], y: str, tolerance: float, tie: str, mean: bool) -> DataFrame:
    def start() -> Callable[[float], int]:
        line, ref = -1, None

        def step(v: float) -> int:
            nonlocal line, ref
            if ref is None or abs(v - ref) > tolerance:
                line, ref = line + 1, v
            elif mean:
                ref = (ref + v) / 2
            return line

        return step

    return folded(words, group, [y, tie], [y], start, "line")


def lines_by_anchor(words: DataFrame, group: list[str], y: str, tolerance: float, tie: str) -> DataFrame:
    """A line ends where y is more than ``tolerance`` from the line's first: a fold in order, per page."""
    return _fold_lines(words, group, y, tolerance, tie, False)


def lines_by_mean(words: DataFrame, group: list[str], y: str, tolerance: float, tie: str) -> DataFrame:
    """A line ends where y is more than ``tolerance`` from the line's running mean of halves: a fold in order, per page."""
    return _fold_lines(words, group, y, tolerance, tie, True)


def clusters(rows: DataFrame, group: list[str], value: str, gap: float, tie: str) -> DataFrame:
    """Whole-number means of values that lie within ``gap`` of their neighbours: group, line, position, n."""
    return lines_by_gap(rows, group, value, gap, tie).groupBy(*group, "line").agg(F.avg(value).cast("int").alias("position"), F.count("*").alias("n"))


def into_columns(words: DataFrame, bounds: DataFrame, group: list[str], x: str = "x0") -> DataFrame:
    """Each word with the column whose bounds hold its ``x`` (from lo, below hi), words outside all in the last: one equi-join with the page's few bounds as an array, not a row for each pair."""
    per = bounds.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("col_idx", "lo", "hi"))).alias("_bounds"))
    hit = F.get(F.filter("_bounds", lambda b: (F.col(x) >= b["lo"]) & (F.col(x) < b["hi"])), F.lit(0))
    return words.join(per, group).select(*words.columns, F.coalesce(hit["col_idx"], F.element_at("_bounds", -1)["col_idx"]).alias("col_idx"))


def cells_from_words(words: DataFrame, group: list[str], x: str = "x0", text: str = "text", conf: str = "conf") -> DataFrame:
    """Words of a cell joined in order of ``x``; the confidence is the whole-number mean, 100 without any."""
    some = F.sort_array(F.collect_list(F.struct(F.col(x).alias("x"), F.col(text).alias("t"))))
    return words.groupBy(*group, "col_idx").agg(some.alias("_w"), F.coalesce(F.avg(conf).cast("int"), F.lit(100)).alias("confidence")).select(*group, "col_idx", F.array_join(F.transform("_w", lambda w: w["t"]), " ").alias("value"), "confidence")


def islands(words: DataFrame, group: list[str], left: str, right: str) -> DataFrame:
    """Words of one cell: a word joins while its left edge is at most the furthest right so far plus max(10, 0.75 of the median width)."""
    w = Window.partitionBy(*group)
    gap = F.greatest(F.lit(10.0), 0.75 * F.median(F.col(right) - F.col(left)).over(w))
    before = F.max(right).over(w.orderBy(left, right).rowsBetween(Window.unboundedPreceding, -1))
    return words.withColumn("_new", F.coalesce((F.col(left) > before + gap).cast("int"), F.lit(0))).withColumn("cell", F.sum("_new").over(w.orderBy(left, right)).cast("int")).drop("_new")


def blank_rows(gap: Column, height: Column) -> Column:
    """Blank rows that a vertical gap stands for."""
    n = F.least(F.lit(MOST_BLANKS), F.greatest(F.lit(1), F.bround(gap / height).cast("int") - 1))
    return F.when(gap > BLANK_FROM * height, n).otherwise(0)


def merge_partial(rows: DataFrame, page: list[str]) -> DataFrame:
    """Consecutive data rows whose non-empty cells stand in different columns are one row: a fold in order, per page. Input and output: page, row_idx, row_type, cells."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in pdf.sort_values("row_idx").to_dict("records"):
            cells = [c or "" for c in r["cells"]]
            last = out[-1] if out else None
            if last and last["row_type"] == r["row_type"] == "data" and not any(a and b for a, b in zip(last["cells"], cells)):
                n = len(last["cells"])
                last["cells"] = [a or b for a, b in zip(last["cells"], (cells + [""] * n)[:n])]
            else:
                out.append({**r, "cells": cells})
        return pd.DataFrame(out)[[*page, "row_idx", "row_type", "cells"]]

    return rows.select(*page, "row_idx", "row_type", "cells").groupBy(*page).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in (*page, "row_idx", "row_type", "cells")))


def gutters(lines: DataFrame, page: list[str], headers: DataFrame) -> DataFrame:
    """Column cuts of character-grid lines (page, text): between consecutive header starts (page, col_idx, start), the end of the widest run of columns blank in all lines; the earlier of equally wide ones."""
    width = lines.groupBy(*page).agg(F.max(F.length("text")).alias("n"))
    signs = lines.select(*page, F.posexplode(F.split("text", "")).alias("x", "sign")).where("trim(sign) <> ''").select(*page, "x").distinct()
    blank = width.select(*page, F.explode(F.sequence(F.lit(0), F.col("n"))).alias("x")).join(signs, [*page, "x"], "left_anti")
    runs = blank.withColumn("_r", F.col("x") - F.row_number().over(Window.partitionBy(*page).orderBy("x"))).groupBy(*page, "_r").agg(F.min("x").alias("s"), (F.max("x") + 1).alias("e"))
    spans = headers.withColumn("next", F.lead("start").over(Window.partitionBy(*page).orderBy("col_idx"))).where("next IS NOT NULL")
    both = spans.join(runs, page).where((F.col("e") > F.col("start")) & (F.col("s") < F.col("next"))).select(*page, "col_idx", F.greatest("s", "start").alias("s"), F.least("e", "next").alias("e"))
    return both.groupBy(*page, "col_idx").agg(F.max(F.struct((F.col("e") - F.col("s")).alias("w"), (-F.col("s")).alias("o"), F.col("e").alias("cut"))).alias("b")).select(*page, "col_idx", F.col("b.cut").alias("cut"))


def find_header(rows: DataFrame, page: list[str], words: list[str]) -> DataFrame:
    """The first row of a page in which at least max(2, half) of the header words stand as words: page, row_idx, hits."""
    text = F.upper(F.array_join("cells", " "))
    hits = sum((F.rlike(text, F.lit(rf"(?<![A-Z0-9])\Q{w.upper()}\E(?![A-Z0-9])")).cast("int") for w in words), F.lit(0))
    least = max(2, (len(words) + 1) // 2)
    return rows.withColumn("hits", hits).where(F.col("hits") >= least).groupBy(*page).agg(F.min(F.struct("row_idx", "hits")).alias("h")).select(*page, "h.row_idx", "h.hits")


def sheet_rows(rows: DataFrame, block: list[str], order: str, size: int = SHEET_ROWS) -> DataFrame:
    """``rows`` with sheet_row: blocks stand below each other in order of their (numeric) first key, each as high as whole sheets that hold a header, its rows and the footer."""
    per = rows.groupBy(*block).agg((F.ceil((1 + F.count("*") + FOOTER_ROWS) / F.lit(size)) * size).cast("long").alias("height"))
    start = running_total(per, block[0], "height", "_end", tuple(block[1:])).select(*block, (F.col("_end") - F.col("height")).alias("start"))
    return rows.join(start, block).withColumn("sheet_row", F.col("start") + 1 + F.row_number().over(Window.partitionBy(*block).orderBy(order)))


def side_by_side(pages: DataFrame, group: list[str], order: str, width: str, gap: float) -> DataFrame:
    """x offset of each page when pages stand side by side."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("x_offset", F.coalesce(F.sum(F.col(width) + gap).over(w), F.lit(0.0)))


def segments(rows: DataFrame, group: list[str], opens: Column, order: list[str]) -> DataFrame:
    """Blocks that a matching row opens, numbered from 1; rows before the first are in block 0."""
    return rows.withColumn("segment", F.sum(opens.cast("int")).over(Window.partitionBy(*group).orderBy(*order)).cast("int"))


def spacing(gap: Column, sign_width: Column) -> Column:
    """Blanks that a gap between words stands for: 1 to 12."""
    return F.greatest(F.lit(1), F.least(F.lit(12), F.bround(gap / sign_width).cast("int")))


def text_pages(pages: DataFrame, least_signs: int = 20, image: float = 0.10, full: float = 0.8) -> DataFrame:
    """Nature of a page from visible_signs, hidden_signs and image_share: vector, hidden_ocr, scan or empty."""
    kind = F.when((F.col("visible_signs") >= least_signs) & (F.col("image_share") < full), "vector").when(F.col("hidden_signs") >= least_signs, "hidden_ocr").when(F.col("image_share") >= image, "scan").otherwise("empty")
    return pages.withColumn("nature", kind)


def image_share(images: DataFrame, page: list[str]) -> DataFrame:
    """Share of a page that its images (w, h, page_area) cover, 1 at most."""
    return images.groupBy(*page).agg(F.least(F.lit(1.0), F.sum(F.col("w") * F.col("h")) / F.max("page_area")).alias("image_share"))


def kept_pages(pages: DataFrame, least_rows: int = 1, least_density: float = 0.0) -> DataFrame:
    """``pages`` (success, header_found, n_rows, n_cells, n_readable) with the reason why a page is left out, null if it stays: a page without rows under a valid header stays."""
    density = F.col("n_readable") / F.nullif(F.col("n_cells"), F.lit(0))
    why = F.when(~F.col("success"), "failed").when(~F.col("header_found") & (F.col("n_rows") < least_rows), "no_table").when((F.col("n_rows") > 0) & (F.coalesce(density, F.lit(1.0)) < least_density), "unreadable")
    return pages.withColumn("reason", why)


def text_of(rows: DataFrame, separator: str = " | ") -> Column:
    """Cells as one line of pipe text."""
    return F.concat_ws(separator, F.transform("cells", lambda c: filled(c)))
