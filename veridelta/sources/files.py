"""Documents as files: routing by kind, a parser for DOCX, and places for PDF and recogniser plug-ins.

Every parser is a function bytes -> (pages, elements); one runs on the executors for each file. PDF,
conversion and recognition need libraries or services that aren't part of this package: they are
passed in. A file that can't be parsed gives a row with ``error`` and no pages.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions.layout import file_type

PARSED = (
    "file_path string, file_type string, error string, "
    "pages array<struct<page_index: int, page_number: int, plain_text: string>>, "
    "elements array<struct<page_index: int, element_ordinal: int, element_id: string, element_type: string, text: string, cells: array<array<string>>, rows: int, cols: int, extension: string, width: int, height: int, page_index_estimated: boolean>>"
)
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FIELDS = ("page_index", "element_ordinal", "element_id", "element_type", "text", "cells", "rows", "cols", "extension", "width", "height", "page_index_estimated")

Parser = Callable[[bytes], tuple[list[dict], list[dict]]]


def element(**given) -> dict:
    return {name: given.get(name) for name in FIELDS}


def parse_docx(data: bytes) -> tuple[list[dict], list[dict]]:
    """One logical page: paragraphs outside tables, then tables, then embedded images."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        images = sorted(n for n in archive.namelist() if n.startswith("word/media/"))
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    found: list[dict] = []
    for node in body.findall(f"{_W}p"):
        if text(node):
            found.append(element(element_type="paragraph", text=text(node), element_id=f"docx-paragraph-{len(found)}"))
    for at, table in enumerate(body.findall(f"{_W}tbl")):
        cells = [[text(cell) for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")]
        flat = " ".join(c for row in cells for c in row if c)
        found.append(element(element_type="table", text=flat, cells=cells, rows=len(cells), cols=max(map(len, cells), default=0), element_id=f"docx-table-{at}", page_index_estimated=True))
    for at, name in enumerate(images):
        found.append(element(element_type="image", text="", extension=name.rpartition(".")[2].lower(), element_id=f"docx-image-{at}", page_index_estimated=True))
    for at, e in enumerate(found):
        e |= {"page_index": 0, "element_ordinal": at}
    plain = "\n".join(e["text"] for e in found if e["element_type"] == "paragraph")
    return [{"page_index": 0, "page_number": 1, "plain_text": plain}], found


def parse_image(data: bytes) -> tuple[list[dict], list[dict]]:
    """One page with one image element, without recognition."""
    return [{"page_index": 0, "page_number": 1, "plain_text": ""}], [element(page_index=0, element_ordinal=0, element_id="image-0", element_type="image", text="")]


def _no_pdf(data: bytes):
    raise RuntimeError("no PDF parser was passed: read_documents(..., parsers={'pdf': function})")


PARSERS: dict[str, Parser] = {"docx": parse_docx, "image": parse_image, "pdf": _no_pdf}


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Files below a path (a folder, file or glob) as PARSED rows. Files of unknown kind have no
    pages; names that start with '~$' are skipped. A missing path raises."""
    use = PARSERS | (parsers or {})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(~F.rlike("path", F.lit(r"/~\$[^/]*$"))).select(F.col("path").alias("file_path"), file_type("path").alias("file_type"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                pages, elements, error = [], [], None
                if row.file_type in use:
                    try:
                        pages, elements = use[row.file_type](row.content)
                    except Exception as e:  # a bad file is a row, not a failed job
                        error = f"{type(e).__name__}: {e}"
                out.append((row.file_path, row.file_type, error, pages, elements))
            yield pd.DataFrame(out, columns=["file_path", "file_type", "error", "pages", "elements"])

    return files.mapInPandas(run, PARSED)


def as_pages(parsed: DataFrame, side: str, pair_id=None) -> tuple[DataFrame, DataFrame]:
    """Pages and elements of parsed files for a comparison; the pair is the file path unless given."""
    pair = F.col("file_path") if pair_id is None else F.lit(pair_id) if isinstance(pair_id, str) else pair_id
    head = [pair.alias("pair_id"), F.lit(side).alias("side")]
    return parsed.select(*head, F.inline("pages")), parsed.select(*head, F.inline("elements"))


def document_text(parsed: DataFrame) -> DataFrame:
    """file_path, text: the texts of all pages in order, joined by line ends and stripped."""
    pages = F.transform(F.array_sort("pages"), lambda p: p["plain_text"])
    return parsed.select("file_path", F.trim(F.array_join(pages, "\n")).alias("text"))


def table_cells(parsed: DataFrame) -> DataFrame:
    """Long cells of the tables in parsed files: file_path, page_index, table_id, row_idx, col_idx,
    col_name, value. The first row names the columns; tables of one row have no cells."""
    tables_ = parsed.select("file_path", F.inline("elements")).where("element_type = 'table' and size(cells) > 1")
    rows = tables_.select("file_path", "page_index", F.col("element_id").alias("table_id"), F.get("cells", F.lit(0)).alias("head"), F.posexplode(F.slice("cells", 2, 1_000_000_000)).alias("row_idx", "row"))
    cells = rows.select("file_path", "page_index", "table_id", "row_idx", "head", F.posexplode("row").alias("col_idx", "value"))
    return cells.select("file_path", "page_index", "table_id", "row_idx", "col_idx", F.trim(F.coalesce(F.get("head", "col_idx"), F.lit(""))).alias("col_name"), F.trim("value").alias("value"))
