"""The whole comparison as one lazy plan over many document pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.operators import align, elements, evidence, page_tables
from veridelta.sources.shared import stored


class DocumentComparison:
    """Candidate and baseline documents as rows of pages and elements (see operators.align).

    cells: the tables' cells in long form (see operators.page_tables). Where given, the tables of those
    page pairs are compared of which some difference asks for it."""

    def __init__(self, pages: DataFrame, page_elements: DataFrame, cells: DataFrame | None = None, key_columns: Sequence[str] = (), numeric_columns: Sequence[str] | None = None, **thresholds):
        self.pages, self.elements = pages, page_elements
        self.cells, self.key_columns, self.numeric_columns = cells, key_columns, numeric_columns
        self.text_threshold = thresholds.pop("page_text_threshold", 0.98)
        self.thresholds = thresholds
        self.prints = align.fingerprints(pages, page_elements)

    @cached_property
    def alignments(self) -> DataFrame:
        """Worked out once and kept: several branches of the comparison start from it."""
        return stored(align.align(self.prints, **self.thresholds), "alignments")

    @cached_property
    def pairs(self) -> DataFrame:
        """Alignments with what the comparison needs of both pages, kept too."""
        return stored(elements.pair_pages(self.alignments, self.prints), "pairs")

    def differences(self) -> DataFrame:
        pairs = self.pairs
        found = elements.status_differences(pairs).unionByName(elements.page_differences(pairs, self.text_threshold))
        found = found.unionByName(elements.element_differences(pairs, self.elements))
        if self.cells is None:
            return found
        found = stored(found, "differences")  # read twice: as rows, and for what they ask
        tables = page_tables.compare_tables(self.alignments, self.cells, page_tables.flagged(found), self.key_columns, self.numeric_columns)
        numbers = pairs.select("pair_id", "alignment_seq", F.col("c.page_number").cast("int").alias("candidate_page"), F.col("b.page_number").cast("int").alias("baseline_page"))
        named = F.map_filter(F.create_map(F.lit("candidate_table"), "candidate_table", F.lit("baseline_table"), "baseline_table"), lambda k, v: v.isNotNull())
        tables = tables.join(numbers, ["pair_id", "alignment_seq"]).withColumns({"metadata": named, "stage": F.lit(8), "within_seq": F.lit(0), "requires_table_compare": F.col("diff_type").isin("table_added", "table_deleted")})
        return found.unionByName(tables.drop("candidate_table", "baseline_table"), allowMissingColumns=True)

    def evidence(self) -> DataFrame:
        # Kept before they are numbered: range bounds are sampled, which would work them out twice.
        return evidence.index(stored(self.differences(), "found"), ["pair_id", "alignment_seq", "stage", "within_seq", "diff_type", "message"])

    def summary(self) -> DataFrame:
        return evidence.summary(self.evidence())

    def annotations(self) -> DataFrame:
        return evidence.annotate(self.evidence())


def from_texts(candidate: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and paragraph elements of (pair_id, page_number, text) rows: one paragraph for each
    line that isn't blank."""
    sides = [df.select(F.lit(s).alias("side"), "pair_id", "page_number", "text") for s, df in (("candidate", candidate), ("baseline", baseline))]
    return from_sides(sides[0].unionByName(sides[1]))


def from_sides(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As from_texts, of (pair_id, side, page_number, text) rows. Pages carry their lines, so that
    fingerprints need no elements."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    both = both.withColumn("page_index", (F.col("page_number") - 1).cast("int"))
    pages = both.select("pair_id", "side", "page_index", "page_number", F.col("text").alias("plain_text"), lines.alias("lines"))
    rows = both.select("pair_id", "side", "page_index", "page_number", F.posexplode(lines).alias("element_ordinal", "text"))
    name = F.format_string("p%d-line-%d", "page_number", "element_ordinal")
    return pages, rows.select("pair_id", "side", "page_index", "element_ordinal", name.alias("element_id"), F.lit("paragraph").alias("element_type"), "text")
