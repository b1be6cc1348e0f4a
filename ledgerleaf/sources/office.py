"""Workbooks and word files through the standard library: zip archives of XML, one file per task record.

Files are read by Spark (binaryFile), so any store that Spark knows will do; the parsers see bytes only.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layout import segments

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SHEET = "file string, sheet string, row_idx int, cells array<string>"
TABLE = "file string, table_idx int, row_idx int, cells array<string>"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Sheet, row number from 0 and cells of each row of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            target = targets[s.get(f"{_R}id")].lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            for row in ElementTree.fromstring(z.read(part)).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    v = c.find(f"{_S}v")
                    kind = c.get("t")
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else shared[int(v.text)] if kind == "s" and v is not None else (v.text or "") if v is not None else ""
                yield s.get("name"), int(row.get("r") or 1) - 1, cells


def word_tables(content: bytes) -> Iterator[tuple[int, int, list[str]]]:
    """Table, row and cells of each table row of a word file; a cell merged over several columns stands once."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for k, table in enumerate(body.iter(f"{_W}tbl")):
        for r, row in enumerate(table.iter(f"{_W}tr")):
            yield k, r, [" ".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in c.iter(f"{_W}p")).strip() for c in row.iter(f"{_W}tc")]


def word_images(content: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(n for n in z.namelist() if n.startswith("word/media/")):
            yield name.rsplit("/", 1)[1], z.read(name)


def _read(spark: SparkSession, path: str, parse, schema: str, names: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, content in zip(f["path"], f["content"]):
                yield pd.DataFrame([(file, *r) for r in parse(bytes(content))], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, workbook_rows, SHEET, ["file", "sheet", "row_idx", "cells"])


def read_word_tables(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, word_tables, TABLE, ["file", "table_idx", "row_idx", "cells"])


def read_word_images(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, word_images, "file string, name string, content binary", ["file", "name", "content"])


def pages_from_sheet(rows: DataFrame, header: list[str]) -> DataFrame:
    """Rows of sheets cut into pages: a row whose first cells are the header opens one. Adds page_idx (from 1) and row_type: header, section (one cell), footer (a label with a colon) or data."""
    names = F.array(*[F.lit(h.upper()) for h in header])
    is_header = F.slice(F.transform("cells", lambda c: F.upper(F.trim(c))), 1, len(header)) == names
    cut = segments(rows, ["file", "sheet"], is_header, ["row_idx"]).withColumnRenamed("segment", "page_idx")
    full = F.filter("cells", lambda c: F.trim(c) != "")
    kind = F.when(is_header, "header").when(F.size(full) == 0, "blank").when((F.size(full) == 1) & ~F.contains(F.get(full, F.lit(0)), F.lit(":")), "section").when(F.exists(full, lambda c: F.rlike(c, F.lit(r"^\S[^:]*:"))), "footer").otherwise("data")
    return cut.withColumn("row_type", kind)


def workbook_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of text cells."""

    def name(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    main = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        n = len(sheets)
        z.writestr("[Content_Types].xml", main + '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, n + 1)) + "</Types>")
        z.writestr("_rels/.rels", main + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", main + f'<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", main + '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", main + f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(rows: DataFrame, doc: str, sheet: str, order: str) -> DataFrame:
    """One workbook per document as bytes (doc, content), built where its rows meet: doc, sheet, order, cells."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sheets = {s: [list(c) for c in g.sort_values(order)["cells"]] for s, g in pdf.groupby(sheet, sort=True)}
        return pd.DataFrame({doc: [pdf[doc].iloc[0]], "content": [workbook_bytes(sheets)]})

    return rows.groupBy(doc).applyInPandas(run, f"{doc} {kinds[doc]}, content binary")
