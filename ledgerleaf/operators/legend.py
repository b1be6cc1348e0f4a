"""Legend tables of drawings: words with positions to rows of code, label and description."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

# Words of a header row, rows and columns that make a table.
HEADINGS = ("code", "ref", "désignation", "libellé", "description", "symbole", "nom", "type", "n°", "repère")
LEAST_ROWS, LEAST_COLUMNS = 3, 2


def table_pages(words: DataFrame, page: list[str], rows: int = LEAST_ROWS, columns: int = LEAST_COLUMNS) -> DataFrame:
    """Pages on which enough words start at enough common places (to the ten)."""
    at = words.groupBy(*page, F.bround("x", -1).alias("_x")).agg(F.count("*").alias("n")).where(F.col("n") >= rows)
    return at.groupBy(*page).agg(F.count("*").alias("columns")).where(F.col("columns") >= columns)


def legend_rows(words: DataFrame, page: list[str]) -> DataFrame:
    """page, code, label, description, in order of appearance: words (x, y, text) of one height (to the ten) are a row, its first two cells code and label, the others the description. Of rows with one code the first stays; headings and rows of one cell go."""
    some = words.withColumn("text", squeeze(F.col("text"))).where("text <> ''")
    rows = some.groupBy(*page, F.bround("y", -1).alias("y")).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]).alias("c")).where(F.size("c") >= 2)
    rows = rows.select(*page, "y", F.get("c", F.lit(0)).alias("code"), F.get("c", F.lit(1)).alias("label"), F.array_join(F.slice("c", F.lit(3), F.size("c")), " — ").alias("description"))
    first = F.row_number().over(Window.partitionBy(*page, "code").orderBy("y"))
    return rows.where(~F.lower("code").isin(*HEADINGS)).withColumn("_p", first).where("_p = 1").drop("_p")
