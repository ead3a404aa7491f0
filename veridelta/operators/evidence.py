"""Evidence: categories, ids, summaries, filters, groups, annotations and render jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.operators.cells import numbered

# Difference types by category, and by kind of annotation.
PAGE_TYPES = ("page_added", "page_deleted", "page_reordered")
PARAGRAPH_TYPES = ("paragraph_added", "paragraph_deleted", "paragraph_modified", "low_confidence_element_match")
TABLE_TYPES = ("table_added", "table_deleted", "table_modified", "table_cell_modified", "table_row_added", "table_row_deleted")
IMAGE_TYPES = ("image_added", "image_deleted", "image_modified", "image_replaced", "image_modified_candidate")
LAYOUT_TYPES = ("layout_changed", "layout_structure_changed")

# Labels shown for difference types.
LABELS = {
    "paragraph_added": "新增段落",
    "paragraph_deleted": "删除段落",
    "paragraph_modified": "段落修改",
    "table_added": "新增表格",
    "table_deleted": "删除表格",
    "table_modified": "表格修改",
    "image_added": "新增图片",
    "image_deleted": "删除图片",
    "image_modified_candidate": "疑似图片变化",
    "layout_structure_changed": "版面结构变化",
    "text_modified": "页面文本变化",
    "page_added": "新增页面",
    "page_deleted": "删除页面",
    "page_reordered": "页面顺序变化",
    "layout_changed": "版面变化",
    "low_confidence_element_match": "低置信度元素匹配",
}
DEFAULT_LABEL = "未知证据"


def category(diff_type: Column | str, wants_table: Column | None = None) -> Column:
    """A wish for a table comparison decides before the type does."""
    d = F.col(diff_type) if isinstance(diff_type, str) else diff_type
    out = F.when(F.coalesce(wants_table, F.lit(False)), "table") if wants_table is not None else F.when(F.lit(False), "table")
    return (
        out.when(d.isin(*PAGE_TYPES), "page").when(d == "text_modified", "text").when(d.isin(*PARAGRAPH_TYPES), "paragraph").when(d.isin(*TABLE_TYPES), "table")
        .when(d.isin(*IMAGE_TYPES), "image").when(d == "signature_modified", "signature").when(d.isin(*LAYOUT_TYPES), "layout").otherwise("unknown")
    )


def annotation_type(diff_type: Column | str, has_box: Column) -> Column:
    d = F.col(diff_type) if isinstance(diff_type, str) else diff_type
    kind = (
        F.when(d.isin(*PARAGRAPH_TYPES), "text_block").when(d.isin(*TABLE_TYPES), "table_block").when(d.isin(*IMAGE_TYPES), "image_block")
        .when(d.isin(*LAYOUT_TYPES), "layout_structure").when(d.isin(*PAGE_TYPES, "text_modified"), "page_level").otherwise("unknown")
    )
    return F.when(has_box, kind).otherwise("page_level")


def label(diff_type: Column | str) -> Column:
    d = F.col(diff_type) if isinstance(diff_type, str) else diff_type
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, d), F.lit(DEFAULT_LABEL))


def flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def index(differences: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Evidence records: 1-based seq in the given order, evidence_id, category."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = numbered(differences, cols, "seq", start=1)
    return rows.withColumns({
        "evidence_id": F.format_string("ev-%05d-%s", "seq", "diff_type"),
        "category": category("diff_type", flag(differences, "requires_table_compare")),
        "requires_manual_review": flag(differences, "requires_manual_review"),
        "requires_table_compare": flag(differences, "requires_table_compare"),
    })


def summary(evidence: DataFrame) -> DataFrame:
    """One pass: (dimension, value, n) for severity, category, diff_type, all, and the two flags."""
    entries = F.array(
        *(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("severity", "category", "diff_type")),
        F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")),
    )
    flags = F.array(*(F.when(F.col(f), F.struct(F.lit(f).alias("dimension"), F.lit("true").alias("value"))) for f in ("requires_manual_review", "requires_table_compare")))
    rows = evidence.select(F.inline(F.concat(entries, F.filter(flags, lambda x: x.isNotNull()))))
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def pages(evidence: DataFrame) -> DataFrame:
    """side, page: the distinct pages that evidence names."""
    both = F.array(F.struct(F.lit("candidate").alias("side"), F.col("candidate_page").alias("page")), F.struct(F.lit("baseline").alias("side"), F.col("baseline_page").alias("page")))
    return evidence.select(F.inline(both)).where("page is not null").distinct()


def filtered(evidence: DataFrame, severity=None, category=None, diff_type=None, requires_manual_review=None, requires_table_compare=None) -> DataFrame:
    """Filters that are None don't filter; a flag that is null counts as false."""
    out = evidence
    for name, wanted in (("severity", severity), ("category", category), ("diff_type", diff_type)):
        if wanted is not None:
            out = out.where(F.col(name) == wanted)
    for name, wanted in (("requires_manual_review", requires_manual_review), ("requires_table_compare", requires_table_compare)):
        if wanted is not None:
            out = out.where(flag(out, name) == F.lit(bool(wanted)))
    return out


def by_page(evidence: DataFrame, side: str = "candidate", at_most: int | None = None) -> DataFrame:
    """page, n, evidence_ids in order. Pages hold few records; at_most bounds the list where they don't."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence_id"))), lambda x: x["evidence_id"])
    if at_most is not None:
        ids = F.slice(ids, 1, at_most)
    return evidence.where(F.col(f"{side}_page").isNotNull()).groupBy(F.col(f"{side}_page").alias("page")).agg(F.count("*").alias("n"), ids.alias("evidence_ids"))


def annotate(evidence: DataFrame) -> DataFrame:
    """Annotations: a box from the record's own metadata, else from its location (candidate side)."""
    cols = set(evidence.columns)
    box = "struct<page_number: int, x0: double, y0: double, x1: double, y1: double>"
    got = lambda n: F.col(n) if n in cols else F.lit(None).cast(box)
    text = lambda n: F.coalesce(F.col(n), F.lit("")) if n in cols else F.lit("")
    candidate = F.coalesce(got("candidate_bbox"), F.when(F.col("candidate_page").isNotNull(), got("location")))
    out = evidence.withColumns({"candidate_bbox": candidate, "baseline_bbox": got("baseline_bbox")})
    out = out.withColumn("selected_bbox_source", F.when(F.col("candidate_bbox").isNotNull(), "candidate_bbox").when(F.col("baseline_bbox").isNotNull(), "baseline_bbox"))
    has = F.col("selected_bbox_source").isNotNull()
    return out.select(
        "evidence_id", F.col("seq").alias("diff_index"), "diff_type", "severity", F.col("candidate_page").alias("candidate_page_number"), F.col("baseline_page").alias("baseline_page_number"),
        "candidate_bbox", "baseline_bbox", *(F.col(c) if c in cols else F.lit(None).cast("string").alias(c) for c in ("candidate_element_id", "baseline_element_id")),
        text("candidate_text_preview").alias("candidate_text_preview"), text("baseline_text_preview").alias("baseline_text_preview"),
        annotation_type("diff_type", has).alias("annotation_type"), label("diff_type").alias("annotation_label"), F.lit("pending").alias("review_status"), has.alias("bbox_available"), "selected_bbox_source",
    )


def side_jobs(annotations: DataFrame, sides: Sequence[str] = ("candidate", "baseline")) -> DataFrame:
    """Render jobs: one for each side with a box; annotations without any keep one row that says why not."""
    one = lambda s: F.when(F.col(f"{s}_bbox").isNotNull(), F.struct(F.lit(s).alias("source_side"), F.coalesce(F.col(f"{s}_bbox")["page_number"], F.col(f"{s}_page_number")).alias("page_number"), F.col(f"{s}_bbox").alias("bbox")))
    jobs = F.filter(F.array(*(one(s) for s in sides)), lambda x: x.isNotNull())
    out = annotations.select("evidence_id", "diff_type", "severity", "annotation_label", F.inline_outer(jobs))
    status = F.when(F.col("source_side").isNull(), "skipped_no_bbox").when(F.col("page_number").isNull(), "skipped_no_page_number").otherwise("ready")
    return out.withColumn("render_status", status)
