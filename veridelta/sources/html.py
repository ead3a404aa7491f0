"""HTML: page elements by tag, and table cells with spans, by the standard parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<table: int, row: int, col: int, rowspan: int, colspan: int, tag: string, text: string>>"
KINDS = {"h1": "title", "p": "paragraph", "li": "paragraph", "footer": "footer", "nav": "header"}


class _Tables(HTMLParser):
    """Cells with their place, where spans of earlier cells hold places taken."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.table, self.row, self.taken, self.cell = [], -1, -1, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.close_cell()
            self.table, self.row, self.taken = self.table + 1, -1, []
        elif tag == "tr":
            self.close_cell()
            self.row += 1
        elif tag in ("td", "th") and self.row >= 0:
            self.close_cell()
            given = dict(attrs)
            spans = []
            for name in ("rowspan", "colspan"):
                value = (given.get(name) or "").strip()
                spans.append(max(1, int(value)) if value.isdecimal() else 1)
            # Places taken by earlier cells, as (last row, first column, last column); past rows go.
            self.taken = [x for x in self.taken if x[0] >= self.row]
            col, moved = 0, True
            while moved:
                moved = False
                for _, first, last in self.taken:
                    if first <= col <= last:
                        col, moved = last + 1, True
            self.taken.append((self.row + spans[0] - 1, col, col + spans[1] - 1))
            self.cell = [max(self.table, 0), self.row, col, *spans, tag, []]

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[-1].append(data)

    def close_cell(self):
        if self.cell is not None:
            *head, parts = self.cell
            self.out.append((*head, " ".join(" ".join(parts).split())))
            self.cell = None


def parse_spans(html: str | None) -> list[tuple]:
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    parser.close_cell()
    return parser.out


def _spans(html: pd.Series) -> pd.Series:
    names = ("table", "row", "col", "rowspan", "colspan", "tag", "text")
    return html.map(lambda x: [dict(zip(names, cell, strict=True)) for cell in parse_spans(x)])


def spans(html: Column | str) -> Column:
    """The cells of all tables in an HTML text."""
    return F.pandas_udf(_spans, SPAN)(html)


def grid(cells: DataFrame, by: list[str]) -> DataFrame:
    """Span cells (exploded) to a long grid: every covered place holds the text."""
    place = F.struct((F.col("row") + F.col("i")).alias("row_idx"), (F.col("col") + F.col("j")).alias("col_idx"))
    rows = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rowspan") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("colspan") - 1)))
    return rows.select(*by, "table", place.alias("p"), F.col("text").alias("value")).select(*by, "table", "p.*", "value")


class _Elements(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag in KINDS:
            self.open.append((tag, len(self.out), []))
            self.out.append([KINDS[tag], ""])

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                _, place, parts = self.open.pop(at)
                self.out[place][1] = " ".join(" ".join(parts).split())
                return

    def handle_data(self, data):
        for _, _, parts in self.open:
            parts.append(data)


def parse_elements(html: str | None) -> list[tuple[str, str]]:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    for _, place, parts in parser.open:
        parser.out[place][1] = " ".join(" ".join(parts).split())
    return [tuple(x) for x in parser.out]


def _elements(html: pd.Series) -> pd.Series:
    return html.map(lambda x: [{"element_type": t, "text": s} for t, s in parse_elements(x)])


def elements(pages: DataFrame, id_col: str, html: str = "html") -> DataFrame:
    """id, element_ordinal, element_type, text: titles, paragraphs, headers and footers, in order."""
    rows = pages.select(id_col, F.posexplode(F.pandas_udf(_elements, "array<struct<element_type: string, text: string>>")(html)).alias("element_ordinal", "e"))
    return rows.select(id_col, "element_ordinal", "e.element_type", "e.text")
