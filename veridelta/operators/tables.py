"""Ranking baseline tables for a candidate table.

A table is a row: table_id, columns (visible names), signature, n_rows, n_cols, and keys (map from a
key column's name to its distinct compacted values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.text import _col, compact, edit_similarity, ratio_similarity
from veridelta.operators.cells import LINEAGE

AUTO, REVIEW = 0.75, 0.45


def describe(cells: DataFrame, key_columns: Sequence[str] = (), by: Sequence[str] = ("table_id",), head: int = 5, size: int = 500) -> DataFrame:
    """Long cells (by, row_idx, col_idx, col_name, value) to one row for each table. Only the first
    ``head`` rows are gathered as text; keys are gathered as distinct values."""
    seen = cells.where(~F.col("col_name").isin(*LINEAGE) & (F.trim("col_name") != ""))
    names = F.transform(F.array_sort(F.collect_set(F.struct("col_idx", "col_name"))), lambda x: x["col_name"])
    first = F.when(F.col("row_idx") < head, F.struct("row_idx", "col_idx", compact("value").alias("t")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(first)), lambda x: x["t"]), "")
    keys = [F.collect_set(F.when(F.col("col_name") == k, compact("value"))).alias(f"k{i}") for i, k in enumerate(key_columns)]
    out = seen.groupBy(*by).agg(names.alias("columns"), text.alias("t"), (F.max("row_idx") + 1).alias("n_rows"), F.countDistinct("col_idx").alias("n_cols"), *keys)
    signature = F.substring(F.concat(F.array_join("columns", ""), "t"), 1, size).alias("signature")
    pairs = [x for i, k in enumerate(key_columns) for x in (F.lit(k), F.when(F.array_contains("columns", k), F.col(f"k{i}")))]
    keyed = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string, array<string>>")
    return out.select(*by, "columns", signature, "n_rows", "n_cols", keyed.alias("keys"))


def column_similarity(left: Column | str, right: Column | str) -> Column:
    """Mean, over the names of both sides, of the best similarity on the other side."""
    left, right = _col(left), _col(right)
    best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: edit_similarity(x, y)))), F.lit(0.0), lambda a, v: a + v)
    n = F.size(left) + F.size(right)
    return F.when(n == 0, 1.0).when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise((best(left, right) + best(right, left)) / n)


def key_overlap(left: Column | str, right: Column | str, key_columns: Sequence[str]) -> Column:
    """Mean over the keys of the Jaccard similarity of their values; a missing key counts 0, no keys 0."""
    left, right = _col(left), _col(right)
    if not key_columns:
        return F.lit(0.0)
    total = F.lit(0.0)
    for k in key_columns:
        a, b = left[k], right[k]
        union = F.size(F.array_union(a, b))
        total = total + F.when(a.isNull() | b.isNull(), 0.0).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
    return total / len(key_columns)


def decision(score: Column | str) -> Column:
    """On the unrounded score."""
    score = _col(score)
    return F.when(score >= AUTO, "auto_match").when(score >= REVIEW, "needs_review").otherwise("no_match")


def rank(scan: DataFrame, base: DataFrame, key_columns: Sequence[str] = (), top_k: int = 5, block: Sequence[str] = (), small_rows: int = 20_000) -> DataFrame:
    """The top_k base tables of each scan table, by .40 columns + .30 text + .20 shape + .10 keys.

    ``block`` names columns that both sides share: only tables that agree in them are compared.
    Without blocks every pair is: that is what the ranking means; then the base side, checked to
    hold at most small_rows tables, is sent to all tasks, else ValueError asks for blocks.
    """
    names = ("table_id", "columns", "signature", "n_rows", "n_cols", "keys")
    left = scan.select(*block, *(F.col(c).alias(f"scan_{c}") for c in names))
    right = base.select(*block, *(F.col(c).alias(f"base_{c}") for c in names))
    if block:
        pairs = left.join(right, list(block))
    else:
        if base.limit(small_rows + 1).count() > small_rows:
            raise ValueError(f"more than {small_rows} baseline tables: name block columns")
        pairs = left.join(F.broadcast(right))
    shape = (ratio_similarity("scan_n_rows", "base_n_rows") + ratio_similarity("scan_n_cols", "base_n_cols")) / 2
    pairs = pairs.withColumns({
        "column_score": column_similarity("scan_columns", "base_columns"),
        "text_score": edit_similarity("scan_signature", "base_signature"),
        "shape_score": shape,
        "key_overlap_score": key_overlap("scan_keys", "base_keys", key_columns),
    })
    raw = 0.40 * F.col("column_score") + 0.30 * F.col("text_score") + 0.20 * F.col("shape_score") + 0.10 * F.col("key_overlap_score")
    pairs = pairs.withColumns({"raw": raw, "score": F.round(raw, 6), "decision": decision(raw)})
    common = F.array_sort(F.array_intersect("scan_columns", "base_columns"))
    order = Window.partitionBy(*block, "scan_table_id").orderBy(F.desc("score"), F.desc(F.round("column_score", 6)), F.desc(F.round("text_score", 6)), "base_table_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    reason = F.format_string("columns %.2f, text %.2f, shape %.2f, keys %.2f", "column_score", "text_score", "shape_score", "key_overlap_score")
    return ranked.select(*block, "scan_table_id", "base_table_id", "rank", "score", *(F.round(c, 6).alias(c) for c in ("column_score", "text_score", "shape_score", "key_overlap_score")), "decision", common.alias("common_columns"), reason.alias("reason"))
