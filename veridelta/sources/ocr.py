"""Recogniser output as rows: JSON blocks of several styles, tables in them, and stored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridelta.functions.layout import element_type_of

TYPE_KEYS = ("type", "label", "block_label", "block_type")
TEXT_KEYS = ("text", "block_content", "content", "rec_text", "rec_texts")
BOX_KEYS = ("bbox", "box", "layout_bbox", "coordinate", "block_bbox")
SCORE_KEYS = ("confidence", "score", "prob", "rec_scores")
HTML_KEYS = ("pred_html", "html", "table_html")


def _first(v: Column, keys: Sequence[str], kind: str) -> Column:
    """The first key that is there, at the top or else under ``res``."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{at}{k}", kind) for at in ("", "res.") for k in keys))


def block(json: Column | str) -> Column:
    """struct(block_type, element_type, text, bbox, html) of one block's JSON; unreadable JSON gives
    an unknown, empty block. A list of texts is joined by blanks; a box needs four numbers."""
    v = F.try_parse_json(json)
    kind = F.lower(F.trim(F.coalesce(_first(v, TYPE_KEYS, "string"), F.lit(""))))
    # One text goes before a list of them, the block's own before that below ``res``.
    read = lambda at, k: F.coalesce(F.nullif(F.array_join(F.try_variant_get(v, f"$.{at}{k}", "array<string>"), " "), F.lit("")), F.nullif(F.try_variant_get(v, f"$.{at}{k}", "string"), F.lit("")))
    places = [("", "text"), ("res.", "text"), ("res.", "rec_texts"), ("", "rec_texts"), *((at, k) for at in ("", "res.") for k in TEXT_KEYS if k not in ("text", "rec_texts"))]
    text = F.coalesce(*(read(at, k) for at, k in places), F.lit(""))
    box = _first(v, BOX_KEYS, "array<double>")
    whole = (F.size(box) == 4) & ~F.exists(box, lambda x: x.isNull())
    page = F.coalesce(_first(v, ("page_number", "page_index"), "int"), F.lit(1))
    bbox = F.when(whole, F.struct(page.alias("page_number"), *(F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))))
    source = F.coalesce(*(F.when(F.try_variant_get(v, f"$.{at}{k}", "array<double>").isNotNull(), F.lit(k)) for at in ("", "res.") for k in BOX_KEYS))
    return F.struct(
        kind.alias("block_type"), element_type_of(kind).alias("element_type"), text.alias("text"), bbox.alias("bbox"), _first(v, HTML_KEYS, "string").alias("html"),
        _first(v, SCORE_KEYS, "double").alias("confidence"), F.when(bbox.isNotNull(), source).alias("bbox_source"),
    )


def blocks(pages: DataFrame, id_cols: Sequence[str], json: str) -> DataFrame:
    """One element for each entry of a JSON array of blocks."""
    parts = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")
    rows = pages.select(*id_cols, F.posexplode(F.transform(parts, lambda x: F.to_json(x))).alias("element_ordinal", "j"))
    return rows.select(*id_cols, "element_ordinal", block("j").alias("b")).select(*id_cols, "element_ordinal", "b.*")


UNIFIED = (
    "schema_version string, source struct<file_path: string, file_type: string>, engines array<struct<name: string, version: string>>, "
    "pages array<struct<page_number: int, width: double, height: double, elements: array<struct<element_id: string, element_type: string, text: string, bbox: array<double>, confidence: double>>, "
    "tables: array<struct<table_id: string, bbox: array<double>, cells: array<struct<row: int, col: int, rowspan: int, colspan: int, text: string>>>>>>"
)


def unified(df: DataFrame, id_cols: Sequence[str], json: str) -> DataFrame:
    """Elements of documents in the unified JSON form."""
    rows = df.select(*id_cols, F.from_json(json, UNIFIED).alias("d")).select(*id_cols, F.explode("d.pages").alias("p"))
    return rows.select(*id_cols, "p.page_number", F.posexplode("p.elements").alias("element_ordinal", "e")).select(*id_cols, "page_number", "element_ordinal", "e.*")


def table_cells(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of stored cell-detection results."""
    box = "struct<cls_id: int, label: string, score: double, coordinate: array<double>>"
    schema = f"image string, model_name string, threshold double, results array<struct<res: struct<input_path: string, page_index: int, boxes: array<{box}>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.select("image", "model_name", "threshold", F.explode("results.res").alias("r"))
    return rows.select("image", "model_name", "threshold", "r.page_index", F.posexplode("r.boxes").alias("box_index", "b")).select("image", "model_name", "threshold", "page_index", "box_index", "b.*")
