"""Types of the data model: pages, rows, cells, words, alerts, log lines, events and drawing entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "struct<type:string, cells:array<string>, confidence:array<int>, text:string, raw:string, exact:boolean>"
PAGE = f"doc_id string, page_idx int, success boolean, error string, detection_method string, image_path string, headers array<string>, rows array<{ROW}>, metadata map<string,string>, footer array<string>, revisions array<string>"
WORD = "doc_id string, page_idx int, x0 double, y0 double, x1 double, y1 double, text string, conf int"
ALERT = "page_idx int, row_idx int, col_idx int, rule string, message string, proposal string, pair string"
LOG = "ts string, image string, model string, id string, usage struct<input_tokens:long, output_tokens:long, cache_read_input_tokens:long, cache_creation_input_tokens:long>, raw string, rows int, metadata map<string,string>, success boolean, error string"
EVENT = "type string, ts double, page_idx int, rank int, total int, state string, block string, n_rows int, alerts array<string>, batch string, message string"
ENTITY = "page_idx int, kind string, layer string, color struct<r:int,g:int,b:int>, lineweight double, points array<struct<x:double,y:double>>, text string"


def rows_of(pages: DataFrame) -> DataFrame:
    """One row per table row: the page's keys, row_idx (document order) and the row's fields."""
    keep = [c for c in ("doc_id", "page_idx", "headers") if c in pages.columns]
    return pages.select(*keep, F.posexplode_outer("rows").alias("row_idx", "row")).where("row IS NOT NULL").select(*keep, "row_idx", "row.*")


def cells_of(pages: DataFrame) -> DataFrame:
    """The long form that most rules read: doc_id, page_idx, row_idx, row_type, col_idx, col_name, value, confidence. Missing cells are ''."""
    rows = rows_of(pages)
    n = F.greatest(F.size("headers"), F.size("cells"))
    padded = pad(F.col("cells"), n)
    return rows.select("doc_id", "page_idx", "row_idx", F.col("type").alias("row_type"), "headers", "confidence", F.posexplode(padded).alias("col_idx", "value")).select(
        "doc_id", "page_idx", "row_idx", "row_type", "col_idx", F.get("headers", F.col("col_idx")).alias("col_name"), "value", F.get("confidence", F.col("col_idx")).alias("confidence")
    )


def pad(cells: Column, n: Column | int) -> Column:
    """Exactly ``n`` cells: null and missing ones become ''."""
    n = F.lit(n) if isinstance(n, int) else n
    some = F.transform(F.coalesce(cells, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")))
    return F.slice(F.concat(some, F.array_repeat(F.lit(""), F.greatest(n - F.size(some), F.lit(0)))), F.lit(1), n)
