"""Office files as block tables, one file per row of a binaryFile source."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the XML namespace of word-processing documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "document_id string, path string, pos int, block_type string, is_heading boolean, cell string, text string, error string"


def docx_blocks(content: bytes) -> Iterator[tuple]:
    """(pos, block_type, is_heading, cell, text) of each non-empty paragraph and table cell, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{W}t")).strip()
    pos, table = 0, 0
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            style = node.find(f"{W}pPr/{W}pStyle")
            heading = style is not None and style.get(f"{W}val", "").lower().startswith(("heading", "title"))
            found = [("heading" if heading else "paragraph", heading, None, said(node))]
        elif node.tag == f"{W}tbl":
            table += 1
            found = [
                ("table_cell", False, f"T{table}R{r}C{c}", said(cell))
                for r, row in enumerate(node.findall(f"{W}tr"), 1)
                for c, cell in enumerate(row.findall(f"{W}tc"), 1)
            ]
        else:
            continue
        for kind, heading, cell, text in found:
            if text:
                yield pos, kind, heading, cell, text
                pos += 1


#: Fixed value: the XML namespace of sheets.
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def xlsx_blocks(content: bytes) -> Iterator[tuple]:
    """(pos, "sheet_cell", False, cell, text) of each non-empty cell, sheet by sheet; a formula without a value is kept as =formula."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        shared = ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{S}si") if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = [ElementTree.fromstring(z.read(n)) for n in names]
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{S}t"))
    pos = 0
    for number, sheet in enumerate(sheets, 1):
        for cell in sheet.iter(f"{S}c"):
            kind, value, formula = cell.get("t"), cell.findtext(f"{S}v"), cell.findtext(f"{S}f")
            if kind == "inlineStr":
                text = said(cell)
            elif value is None:
                text = f"={formula}" if formula else ""
            elif kind == "s":
                text = said(shared[int(value)])
            elif kind == "b":
                text = "TRUE" if value == "1" else "FALSE"
            else:
                text = value
            if text.strip():
                yield pos, "sheet_cell", False, f"S{number}!{cell.get('r')}", text.strip()
                pos += 1


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all .docx files below a path; a damaged file gives one row with an error."""
    return _read(spark, path, "*.docx", docx_blocks)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all .xlsx files below a path; a damaged file gives one row with an error."""
    return _read(spark, path, "*.xlsx", xlsx_blocks)


def _read(spark: SparkSession, path: str, glob: str, blocks: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = files.select("path", "content", F.concat(F.lit("doc-"), F.substring(F.sha2("content", 256), 1, 16)).alias("document_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content, document in zip(b["path"], b["content"], b["document_id"], strict=True):
                try:
                    rows = [(document, name, *block, None) for block in blocks(bytes(content))]
                except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as problem:
                    rows = [(document, name, None, None, None, None, None, type(problem).__name__)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return named.mapInPandas(run, BLOCKS)
