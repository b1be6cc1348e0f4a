"""Pages of signs with positions as lines of a character grid, and grids as rows of cells.

Signs: page keys, span, seq (order within the span), x, y (of the span), sign. All by windows per page: no fold in Python
but that of the lines' anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import layout

# How far the words of a line may stand apart in height; the gap, in signs, from which two spans are two words; what separates rows.
LINE_TOLERANCE = 3.0
WORD_GAP = 0.5
SEPARATOR = r"^[\s|+\-_=]*$"


def pitch(signs: DataFrame, page: list[str]) -> DataFrame:
    """Per page the commonest distance between neighbouring signs of a span, the first seen of equals."""
    w = Window.partitionBy(*page, "span").orderBy("seq")
    gaps = signs.withColumn("gap", F.bround(F.lead("x").over(w) - F.col("x"), 2)).where("gap > 0")
    counts = gaps.groupBy(*page, "gap").agg(F.count("*").alias("n"), F.min(F.struct("span", "seq")).alias("first"))
    return counts.groupBy(*page).agg(F.max_by("gap", F.struct("n", (-F.col("first.span")).alias("s"), (-F.col("first.seq")).alias("q"))).alias("pitch"))


def words_of_signs(signs: DataFrame, page: list[str]) -> DataFrame:
    """Words between blanks of a span: page, span, y, span_x (of the span's first sign), x, last_x, text. A word of underlines only is a rule of the frame."""
    w = Window.partitionBy(*page, "span").orderBy("seq")
    blank = F.trim("sign") == ""
    each = signs.withColumn("_word", F.sum(blank.cast("int")).over(w)).withColumn("span_x", F.first("x").over(w)).where(~blank)
    own = F.array_sort(F.collect_list(F.struct("seq", "sign", "x")))
    out = each.groupBy(*page, "span", "_word").agg(own.alias("s"), F.first("y").alias("y"), F.first("span_x").alias("span_x"))
    out = out.select(*page, "span", "y", "span_x", F.get("s", F.lit(0))["x"].alias("x"), F.element_at("s", -1)["x"].alias("last_x"), F.array_join(F.transform("s", lambda r: r["sign"]), "").alias("text"))
    return out.where(F.regexp_replace("text", "_", "") != "")


def grid_lines(signs: DataFrame, page: list[str], tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """page, line (from 0), text: each word at the column that its place gives, counted in the page's own pitch.

    A word stands at its column, or after the word before it with one blank between words of one span or with a
    real gap. So k(i) = max(wanted(i), k(i-1) + step(i)), which is a running sum of steps plus a running maximum of
    what is wanted less those sums.
    """
    pitches = pitch(signs, page).hint("merge")  # a row for each page, which grows with the input: never sent through the driver, however small the files look
    words = words_of_signs(signs, page).join(pitches, page).withColumn("x0", F.min("x").over(Window.partitionBy(*page)))
    words = words.dropDuplicates([*page, "x", "y", "last_x", "text"])  # printed twice at one place
    lines = layout.lines_by_anchor(words, page, "y", tolerance, "x")
    w = Window.partitionBy(*page, "line").orderBy("x", "last_x", "text")
    wanted = (F.bround((F.col("span_x") - F.col("x0")) / F.col("pitch")) + F.bround((F.col("x") - F.col("span_x")) / F.col("pitch"))).cast("long")
    gap = (F.col("x") - F.lag("last_x").over(w) - F.col("pitch")) / F.col("pitch")
    apart = (gap >= WORD_GAP) | (F.col("span") == F.lag("span").over(w))
    step = F.coalesce(F.length(F.lag("text").over(w)) - 1 + F.when(apart, 2).otherwise(1), F.lit(0)).cast("long")
    lines = lines.withColumn("wanted", wanted).withColumn("step", step).withColumn("sum", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("k", F.col("sum") + F.max(F.col("wanted") - F.col("sum")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("blanks", (F.col("k") - F.coalesce(F.lag(F.col("k") + F.length("text")).over(w), F.lit(0))).cast("int"))
    own = F.array_sort(F.collect_list(F.struct("k", "blanks", "text")))
    placed = F.array_join(F.transform(own, lambda r: F.concat(F.repeat(F.lit(" "), r["blanks"]), r["text"])), "")
    return lines.groupBy(*page, "line").agg(F.rtrim(placed).alias("text"))


def header_starts(text: Column, columns: list[str]) -> Column:
    """array<int>: where each column's name starts in a line, in order; null if one is missing or out of order."""
    starts: list[Column] = []
    for name in columns:
        starts.append(_after(text, name, starts[-1] if starts else None))
    return F.when(F.forall(F.array(*starts), lambda s: s > 0), F.transform(F.array(*starts), lambda s: s - 1))


def _after(text: Column, name: str, before: Column | None) -> Column:
    """Where a name starts beyond a place (from 1), 0 if nowhere."""
    if before is None:
        return F.instr(F.upper(text), F.lit(name.upper()))
    at = F.instr(F.substr(F.upper(text), before + 1), F.lit(name.upper()))
    return F.when((before > 0) & (at > 0), at + before).otherwise(0)


def rows_of_grid(lines: DataFrame, page: list[str], columns: list[str], section: Column, footer: Column) -> DataFrame:
    """page, line, row_type, cells, unsplit of the lines between a page's header and its footer.

    The header is the first line that holds all column names in order; it has a frame if it shows one more mark
    than columns. In a frame, a line with another number of cells is kept whole in the first one and marked unsplit.
    Without one, columns are cut at the gutters and the margin that all cells of a column share is taken off.
    """
    n = len(columns)
    seen = lines.withColumn("starts", header_starts(F.col("text"), columns))
    heads = seen.where("starts IS NOT NULL").groupBy(*page).agg(F.min_by(F.struct(F.col("line").alias("head"), "starts", (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit(""))) >= n + 1).alias("framed")), "line").alias("h")).select(*page, "h.*")
    body = lines.join(heads, page).where(F.col("line") > F.col("head"))
    body = body.withColumn("_end", F.min(F.when(footer, F.col("line"))).over(Window.partitionBy(*page))).where(F.col("_end").isNull() | (F.col("line") < F.col("_end")))
    body = body.withColumn("row_type", F.when(section, "section").otherwise("data")).where((F.col("row_type") == "section") | ~F.rlike("text", F.lit(SEPARATOR)))
    split = F.split("text", r"\|", -1)
    inner = F.slice(split, F.lit(2), F.greatest(F.size(split) - 2, F.lit(0)))
    blank = F.array_repeat(F.lit(""), n - 1)
    whole = F.concat(F.array(F.array_join(F.filter(F.split(F.replace("text", F.lit("|"), F.lit(" ")), r"\s+"), lambda t: t != ""), " ")), blank)
    framed = body.where("framed AND row_type = 'data'").withColumn("unsplit", F.size(inner) != n)
    framed = framed.withColumn("cells", F.when(F.col("unsplit"), whole).otherwise(F.transform(inner, lambda c: F.rtrim(F.regexp_replace(c, "^ ", "")))))
    plain = body.where("NOT framed AND row_type = 'data'")
    starts = heads.where("NOT framed").select(*page, F.posexplode("starts").alias("col_idx", "start"))
    cuts = layout.gutters(plain.select(*page, "text"), page, starts).groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("col_idx", "cut"))).alias("c"))
    cut = plain.join(cuts, page, "left").withColumn("edges", F.concat(F.array(F.lit(0)), F.coalesce(F.transform("c", lambda x: x["cut"].cast("int")), F.array().cast("array<int>")), F.array(F.lit(1 << 20))))
    raw = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k < F.size("edges") - 1, F.rtrim(F.substr("text", F.get("edges", k) + 1, F.get("edges", k + 1) - F.get("edges", k)))).otherwise(""))
    cut = cut.withColumn("raw", raw)
    w = Window.partitionBy(*page)
    margins = F.array(*[F.coalesce(F.min(F.when(F.trim(F.get("raw", F.lit(k))) != "", F.length(F.get("raw", F.lit(k))) - F.length(F.ltrim(F.get("raw", F.lit(k)))))).over(w), F.lit(0)) for k in range(n)])
    cut = cut.withColumn("m", margins).withColumn("cells", F.zip_with("raw", "m", lambda c, m: F.substr(c, m + 1))).withColumn("unsplit", F.lit(False))
    heading = body.where("row_type = 'section'").withColumn("cells", F.array(F.array_join(F.filter(F.split("text", r"\s+"), lambda t: t != ""), " "))).withColumn("unsplit", F.lit(False))
    names = [*page, "line", "row_type", "cells", "unsplit"]
    some = lambda f: f.where(F.exists("cells", lambda c: F.trim(c) != "")).select(*names)
    return some(framed).unionByName(some(cut)).unionByName(heading.select(*names))


def first_bounds(candidates: DataFrame, page: list[str], n: int, least: float = 0.0) -> DataFrame:
    """Of the column bounds that several detectors found (method, rank, bounds, score), per page the first by rank that has the right number of increasing bounds and a score of ``least`` or more."""
    rising = F.forall(F.sequence(F.lit(1), F.size("bounds") - 1), lambda k: F.get("bounds", k) > F.get("bounds", k - 1))
    fits = (F.size("bounds") == n + 1) & rising & (F.col("score") >= least)
    return candidates.where(fits).groupBy(*page).agg(F.min_by(F.struct("method", "bounds"), "rank").alias("b")).select(*page, "b.*")
