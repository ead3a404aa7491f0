"""Tables of aligned pages: presence, ranking, decision, and cell comparison where it is possible.

Cells are long: pair_id, side, page_index, table_id, row_idx, col_idx, col_name, value. Everything is
joined by document pair and alignment, so many pages are compared in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.functions.text import NUMERIC_KEYWORDS, normalize_cell, normalize_number
from veridelta.operators import tables

PAGE = ("pair_id", "alignment_seq")


def flagged(differences: DataFrame) -> DataFrame:
    """The alignments of which some difference asks for a table comparison."""
    return differences.where("requires_table_compare").select(*PAGE).distinct()


def compare_tables(pairs: DataFrame, cells: DataFrame, wanted: DataFrame | None = None, key_columns: Sequence[str] = (), numeric_columns: Sequence[str] | None = None, top_k: int = 3, max_distance: int = 1, numeric_tolerance: str = "0.01") -> DataFrame:
    """Differences of the tables of matched pages (``wanted``: only of these alignments).

    Tables on one side only: table_added or table_deleted, high. Else each candidate table's best
    ranked baseline table decides: without an auto match, an unknown difference that wants a manual
    review; without key columns, an unknown, low one that says cells were skipped; else one
    table_cell_modified for each differing cell or missing row (high if numeric, else medium).
    """
    pages = pairs.where("status = 'matched'")
    if wanted is not None:
        pages = pages.join(wanted, list(PAGE), "left_semi")
    sided = pages.select(*PAGE, F.inline(F.array(F.struct(F.lit("candidate").alias("side"), F.col("candidate_index").alias("page_index")), F.struct(F.lit("baseline").alias("side"), F.col("baseline_index").alias("page_index")))))
    body = cells.join(sided, ["pair_id", "side", "page_index"])
    scan, base = (body.where(F.col("side") == s) for s in ("candidate", "baseline"))
    left, right = (tables.describe(x, key_columns, (*PAGE, "table_id")) for x in (scan, base))
    count = lambda x, n: x.groupBy(*PAGE).agg(F.count("*").alias(n))
    both = count(left, "n_candidate").join(count(right, "n_baseline"), list(PAGE), "full_outer")
    presence = both.where("n_candidate is null or n_baseline is null").select(
        *PAGE, F.when(F.col("n_baseline").isNull(), "table_added").otherwise("table_deleted").alias("diff_type"), F.lit("high").alias("severity"),
        F.format_string("Tables on one side only: %d", F.coalesce("n_candidate", "n_baseline")).alias("message"), *_tables(None, None), F.lit(False).alias("requires_manual_review"),
    )
    best = tables.rank(left, right, key_columns, top_k, PAGE).where("rank = 1").select(*PAGE, "scan_table_id", "base_table_id", "decision", "score")
    review = best.where("decision <> 'auto_match'").select(
        *PAGE, F.lit("unknown").alias("diff_type"), F.lit("medium").alias("severity"), F.concat(F.lit("Best baseline table: "), "decision", F.lit("; review by hand")).alias("message"),
        *_tables("scan_table_id", "base_table_id"), F.lit(True).alias("requires_manual_review"),
    )
    sure = best.where("decision = 'auto_match'")
    if not key_columns:
        return presence.unionByName(review).unionByName(sure.select(
            *PAGE, F.lit("unknown").alias("diff_type"), F.lit("low").alias("severity"), F.lit("Tables match; without key columns cells are not compared").alias("message"), *_tables("scan_table_id", "base_table_id"), F.lit(False).alias("requires_manual_review"),
        ))
    found = _cells(sure, scan, base, list(key_columns), numeric_columns, max_distance, numeric_tolerance)
    return presence.unionByName(review).unionByName(found)


def _tables(scan: str | None, base: str | None) -> list:
    as_col = lambda c: F.col(c) if c else F.lit(None)
    return [as_col(scan).cast("string").alias("candidate_table"), as_col(base).cast("string").alias("baseline_table")]


def _rows(matched: DataFrame, cells: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Rows of matched tables: key text, and the other cells as a map."""
    rows = cells.withColumnRenamed("table_id", table).join(matched, [*PAGE, table])
    entry = F.struct(F.col("col_name"), normalize_cell("value").alias("v"))
    rows = rows.groupBy(*PAGE, "scan_table_id", "base_table_id", "row_idx").agg(F.map_from_entries(F.collect_set(entry)).alias("m"))
    key = F.array(*(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("")) for k in keys))
    return rows.select(*PAGE, "scan_table_id", "base_table_id", F.to_json(key).alias("key"), F.map_filter("m", lambda k, v: ~k.isin(*keys)).alias("m"))


def _cells(sure, scan, base, keys, numeric_columns, max_distance, tolerance) -> DataFrame:
    matched = sure.select(*PAGE, "scan_table_id", "base_table_id")
    on = [*PAGE, "scan_table_id", "base_table_id", "key"]
    a = _rows(matched, base, "base_table_id", keys).withColumnRenamed("m", "b")
    c = _rows(matched, scan, "scan_table_id", keys).withColumnRenamed("m", "c")
    joined = a.join(c, on, "full_outer")
    shared = F.array_intersect(F.map_keys("b"), F.map_keys("c"))
    cells = F.transform(shared, lambda k: F.struct(k.alias("column"), F.try_element_at(F.col("b"), k).alias("base_text"), F.try_element_at(F.col("c"), k).alias("scan_text")))
    cells = F.filter(cells, lambda x: x["base_text"] != x["scan_text"])
    alone = F.array(F.struct(F.lit("").alias("column"), F.lit("").alias("base_text"), F.lit("").alias("scan_text")))
    single = F.col("b").isNull() | F.col("c").isNull()
    rows = joined.select(*on, single.alias("single"), F.inline(F.when(single, alone).otherwise(cells)))
    name = F.lower(F.trim("column"))
    numeric = name.isin([x.strip().lower() for x in numeric_columns]) if numeric_columns is not None else F.rlike(name, F.lit("|".join(NUMERIC_KEYWORDS)))
    x, y = F.when(numeric, normalize_number("base_text")), F.when(numeric, normalize_number("scan_text"))
    rows = rows.withColumns({"x": x, "y": y, "numeric": numeric})
    read = F.col("x").isNotNull() & F.col("y").isNotNull()
    far = F.when(read, F.abs(F.col("x") - F.col("y")) > F.lit(tolerance).cast("decimal(38,10)")).otherwise(F.levenshtein("base_text", "scan_text") > F.when(F.col("numeric"), 1).otherwise(max_distance))
    rows = rows.where(F.col("single") | far)
    kind = F.when(F.col("single"), "row_presence").when(read, "numeric").when(F.col("numeric"), "numeric_parse_failed").otherwise("text")
    message = F.concat(F.lit("Table cell differs ("), kind, F.lit(") in "), F.when(F.col("column") == "", "row").otherwise(F.col("column")), F.lit(" at "), "key")
    return rows.select(*PAGE, F.lit("table_cell_modified").alias("diff_type"), F.when(kind == "numeric", "high").otherwise("medium").alias("severity"), message.alias("message"), *_tables("scan_table_id", "base_table_id"), F.lit(False).alias("requires_manual_review"))
