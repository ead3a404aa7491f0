"""Expressions on boxes, element counts, page kinds and file or label kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridelta.functions.text import _col, count_similarity, strip

# Words that tell what an unmatched page is likely to be.
TOC_WORD = "目录"
COVER_WORDS = ("目录", "合同协议书", "监理人", "代建人", "发包人")
SIGN_WORDS = ("签字", "盖章", "日期", "年", "月", "日", "法定代表人", "授权代表", "监理人", "代建人")
ATTACHMENT_WORDS = ("附件", "承诺书", "职责", "EHS", "诚信")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")


def file_type(path: Column | str) -> Column:
    """By the suffix alone: pdf, docx, image or unknown."""
    suffix = F.lower(F.regexp_extract(_col(path), r"[^/\\](\.[^./\\]+)$", 1))
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx").when(suffix.isin(*IMAGE_SUFFIXES), "image").otherwise("unknown")


def _any_of(text: Column, words) -> Column:
    return F.rlike(text, F.lit("|".join(words)))


def page_kind(text: Column | str, page_number: Column | str, is_blank: Column | str) -> Column:
    """What an unmatched page looks like; the first rule that holds decides."""
    text, number, blank = _col(text), _col(page_number), _col(is_blank)
    size = F.length(text)
    residue = (size <= 30) & (F.contains(F.lower(text), F.lit("page")) | F.rlike(text, F.lit(r"第\s*\d+\s*页")) | (F.contains(text, F.lit("第")) & F.contains(text, F.lit("页")) & F.contains(text, F.lit("共"))))
    cover = F.contains(text, F.lit(TOC_WORD)) | ((number <= 3) & _any_of(text, COVER_WORDS))
    return (
        F.when(residue, "likely_page_number_residue")
        .when(cover, "likely_toc_or_cover_format_noise")
        .when((size <= 80) & _any_of(text, SIGN_WORDS), "likely_short_signature_or_date_page")
        .when(blank | (size <= 5), "likely_blank_or_near_blank")
        .when(_any_of(F.substring(text, 1, 160), ATTACHMENT_WORDS), "likely_attachment_start_page_needs_manual_review")
        .when(size <= 150, "likely_pagination_split_noise")
        .otherwise("unknown_needs_manual_review")
    )


def page_kind_severity(kind: Column | str) -> Column:
    kind = _col(kind)
    low = ("likely_page_number_residue", "likely_short_signature_or_date_page", "likely_blank_or_near_blank")
    medium = ("likely_toc_or_cover_format_noise", "likely_pagination_split_noise")
    return F.when(kind.isin(*low), "low").when(kind.isin(*medium), "medium").otherwise("high")


def ocr_reason(text: Column | str, n_blocks: Column | str, least: int = 20) -> Column:
    """Why a page needs OCR, or ''."""
    size = F.length(strip(text))
    return F.when(size == 0, "empty_native_text").when(size < least, "native_text_below_min_length").when(_col(n_blocks) == 0, "no_native_text_blocks").otherwise("")


def element_type_of(label: Column | str) -> Column:
    """Element type of a recogniser's label."""
    label = F.lower(F.trim(_col(label)))
    return (
        F.when(label.isin("title", "table", "header", "footer", "image", "signature", "paragraph"), label)
        .when(label == "text", "paragraph")
        .when(label == "figure", "image")
        .when(label == "seal", "signature")
        .otherwise("unknown")
    )


def width(box: Column | str) -> Column:
    box = _col(box)
    return F.greatest(F.lit(0.0), box["x1"] - box["x0"])


def height(box: Column | str) -> Column:
    box = _col(box)
    return F.greatest(F.lit(0.0), box["y1"] - box["y0"])


def scaled(box: Column | str, factor: Column | float) -> Column:
    box = _col(box)
    return F.struct(box["page_number"].alias("page_number"), *((box[k] * factor).alias(k) for k in ("x0", "y0", "x1", "y1")))


def box_similarity(a: Column | str, b: Column | str) -> Column:
    """.30 area + .20 width + .20 height + .30 centre; both missing 1, one missing .5."""
    a, b = _col(a), _col(b)
    centre = F.abs(a["x0"] + a["x1"] - b["x0"] - b["x1"]) / 2 + F.abs(a["y0"] + a["y1"] - b["y0"] - b["y1"]) / 2
    span = F.greatest(a["x1"], b["x1"], a["y1"], b["y1"], F.lit(1.0))
    near = F.greatest(F.lit(0.0), 1 - centre / span)
    wa, wb, ha, hb = width(a), width(b), height(a), height(b)
    score = 0.30 * count_similarity(wa * ha, wb * hb) + 0.20 * count_similarity(wa, wb) + 0.20 * count_similarity(ha, hb) + 0.30 * near
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.5).otherwise(score)


def same_value(a: Column | str, b: Column | str) -> Column:
    """1 if equal, null and '' being one value; else 0."""
    return F.when(F.coalesce(_col(a).cast("string"), F.lit("")) == F.coalesce(_col(b).cast("string"), F.lit("")), 1.0).otherwise(0.0)


def as_int(value: Column | str) -> Column:
    """Unreadable is 0."""
    return F.coalesce(_col(value).try_cast("int"), F.lit(0))


def image_similarity(box_a, box_b, width_a, width_b, height_a, height_b, ext_a, ext_b) -> Column:
    """.50 box + .40 size + .10 extension."""
    size = (count_similarity(as_int(width_a), as_int(width_b)) + count_similarity(as_int(height_a), as_int(height_b))) / 2
    return 0.50 * box_similarity(box_a, box_b) + 0.40 * size + 0.10 * same_value(ext_a, ext_b)


def table_like(text: Column | str) -> Column:
    """At least two lines that hold a tab or three parts between double blanks."""
    lines = F.filter(F.split(_col(text), r"\r\n|\n|\r"), lambda x: strip(x) != "")
    parts = lambda x: F.size(F.filter(F.split(x, "  "), lambda p: F.trim(p) != ""))
    return F.size(F.filter(lines, lambda x: F.contains(x, F.lit("\t")) | (parts(x) >= 3))) >= 2


def table_rows(text: Column | str) -> Column:
    """Rows of cells of a table-like text."""
    lines = F.filter(F.transform(F.split(_col(text), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    cells = lambda x: F.when(F.contains(x, F.lit("\t")), F.split(x, "\t")).otherwise(F.filter(F.split(x, r"\s{2,}"), lambda p: F.trim(p) != ""))
    return F.transform(lines, lambda x: F.transform(cells(x), lambda x: F.trim(x)))


def normalized_cells(cells: Column | str) -> Column:
    """Nulls are '', blanks trimmed."""
    return F.transform(_col(cells), lambda row: F.transform(row, lambda c: strip(F.coalesce(c, F.lit("")))))


def cells_shape(cells: Column | str) -> Column:
    """struct(rows, cols): the widest row counts."""
    cells = _col(cells)
    return F.struct(F.size(cells).alias("rows"), F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0)).alias("cols"))


def cells_text(cells: Column | str) -> Column:
    return F.array_join(F.filter(F.flatten(normalized_cells(cells)), lambda c: c != ""), " ")
