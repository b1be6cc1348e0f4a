"""How good alerts and counts are, against what is known to be wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import variants

# Signs that an earlier detector took for each other; what it read as a code; when a form counts as the right one.
WIDE_CONFUSIONS = (("1", "I"), ("1", "L"), ("I", "L"), ("0", "O"), ("0", "D"), ("O", "D"), ("5", "S"), ("8", "B"), ("2", "Z"), ("6", "G"), ("P", "F"), ("R", "K"), ("E", "F"), ("C", "G"), ("H", "K"), ("U", "V"), ("V", "Y"), ("7", "T"), ("M", "N"))
CODE = r"[A-Z0-9][A-Z0-9'\"_/.-]{2,}"
LEAST, RATIO = 2, 1.5


def suspect_codes(cells: DataFrame, group: list[str], key: str, text: str = "value") -> DataFrame:
    """group, key, form, better: codes of a document that are one confusion or one surplus sign away from a clearly more frequent code of it."""
    codes = cells.select(*group, key, F.explode(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(CODE), F.lit(0))).alias("form"))
    counts = codes.groupBy(*group, "form").agg(F.count("*").alias("n"))
    form = F.col("form")
    shorter = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.concat(F.substring(form, F.lit(1), i - 1), F.substring(form, i + 1, F.length(form))))
    tries = counts.select(*group, "form", "n", F.explode(F.array_union(F.transform(variants(form, WIDE_CONFUSIONS), lambda v: v["variant"]), shorter)).alias("better"))
    met = tries.join(counts.select(*group, F.col("form").alias("better"), F.col("n").alias("m")), [*group, "better"]).where((F.col("m") >= LEAST) & (F.col("m") >= RATIO * F.col("n")) & (F.col("better") != form))
    best = met.groupBy(*group, "form").agg(F.max(F.struct("m", "better")).alias("b")).select(*group, "form", "b.better")
    return codes.join(best, [*group, "form"]).select(*group, key, "form", "better").distinct()


def judged_alerts(alerts: DataFrame, wrong: DataFrame, full: DataFrame, doc: list[str]) -> DataFrame:
    """``alerts`` (page, row, col; null: of the whole document, of a whole column) with right: a cell alert is, if the cell is wrong, a column alert, if the column of that page is in ``full``; one without a page never is."""
    cells = wrong.select(*doc, F.col("page").alias("page"), F.col("row").alias("row"), F.col("col").alias("col")).distinct().withColumn("_cell", F.lit(True))
    columns = full.select(*doc, "page", "col").distinct().withColumn("_column", F.lit(True))
    out = alerts.join(cells, [*doc, "page", "row", "col"], "left").join(columns, [*doc, "page", "col"], "left")
    right = F.when(F.col("page").isNull(), False).when(F.col("row").isNull(), F.coalesce("_column", F.lit(False))).otherwise(F.coalesce("_cell", F.lit(False)))
    return out.withColumn("right", right).drop("_cell", "_column")


def missed_errors(wrong: DataFrame, alerts: DataFrame, doc: list[str]) -> DataFrame:
    """Errors (page, row, col; col null: anywhere in the row) that no alert of their page and row points at."""
    at = [*doc, "page", "row"]
    cell = alerts.select(*at, "col").distinct()
    row = alerts.select(*at).distinct()
    exact = wrong.where("col IS NOT NULL").join(cell, [*at, "col"], "left_anti")
    return exact.unionByName(wrong.where("col IS NULL").join(row, at, "left_anti").select(*exact.columns))


def alert_quality(alerts: DataFrame, wrong: DataFrame, full: DataFrame, doc: list[str]) -> DataFrame:
    """Per document and rule: right and false alerts."""
    return judged_alerts(alerts, wrong, full, doc).groupBy(*doc, "rule").agg(F.sum(F.col("right").cast("int")).alias("right"), F.sum((~F.col("right")).cast("int")).alias("false"))


def counter_audit(pages: DataFrame, doc: list[str]) -> DataFrame:
    """Per document of pages (counted, null where it was impossible; read; scanned): pages, false alerts, impossible counts in all and on scans, and on how many pages the loss of one line would be found."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    none = F.col("counted").isNull()
    return pages.groupBy(*doc).agg(
        F.count("*").alias("pages"),
        n(F.col("counted") != F.col("read")).alias("false_alerts"),
        n(none).alias("impossible"),
        n(none & F.col("scanned")).alias("impossible_scans"),
        n(F.col("counted") != F.col("read") - 1).alias("losses_found"),
    )


def training_pairs(lines: DataFrame, images: DataFrame, page: list[str]) -> DataFrame:
    """page, image, text: the k-th line of a page with its k-th image, where a page has as many of both; blank lines are none."""
    def ranked(f: DataFrame, order: str, value: str) -> DataFrame:
        w = Window.partitionBy(*page)
        return f.select(*page, value, F.row_number().over(w.orderBy(order)).alias("_k"), F.count("*").over(w).alias("_n"))

    return ranked(images, "rank", "image").join(ranked(lines.where(F.trim("text") != ""), "line", "text"), [*page, "_k", "_n"]).drop("_k", "_n")
