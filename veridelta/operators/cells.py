"""Tables as rows: fills, headers, lineage and the tolerant cell comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridelta.functions.text import is_numeric_column, normalize_cell, normalize_number, normalize_number_or_text
from veridelta.sources.shared import stored

LINEAGE = ("_source_file", "_source_page", "_source_table", "_source_row")


def forward_fill(df: DataFrame, columns: Sequence[str], order: Sequence[str], by: Sequence[str] = (), blank_is_null: bool = False) -> DataFrame:
    """Nulls (and '' where asked) take the last value above them; what stays null becomes '' where asked."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for c in columns:
        value = F.nullif(F.col(c), F.lit("")) if blank_is_null else F.col(c)
        value = F.last(value, ignorenulls=True).over(w)
        filled[c] = F.coalesce(value, F.lit("")) if blank_is_null else value
    return df.withColumns(filled)


def expand_merged(cells: DataFrame, along: str = "row_idx", by: Sequence[str] = ("table_id",), value: str = "value") -> DataFrame:
    """Merged cells of a long table (row_idx, col_idx, value): nulls take the value above (along
    rows) or to the left (along columns)."""
    across = {"row_idx": "col_idx", "col_idx": "row_idx"}[along]
    return forward_fill(cells, [value], [along], [*by, across])


def promote_header(cells: DataFrame, by: Sequence[str] = ("table_id",)) -> DataFrame:
    """The first row of each long table names its columns; the others move up."""
    head = cells.where("row_idx = 0").select(*by, "col_idx", normalize_cell("value").alias("col_name"))
    return cells.where("row_idx > 0").drop("col_name").join(head, [*by, "col_idx"], "left").withColumn("row_idx", F.col("row_idx") - 1)


def attach_lineage(df: DataFrame, source_file, page=None, table=None, order: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Adds _source_file, _source_page, _source_table and _source_row (0-based, in the given order)."""
    as_col = lambda x, kind: x if isinstance(x, Column) else F.lit(x).cast(kind)
    row = (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int")
    return df.withColumns({"_source_file": as_col(source_file, "string"), "_source_page": as_col(page, "int"), "_source_table": as_col(table, "int"), "_source_row": row})


def prepared(df: DataFrame, keys: Sequence[str], order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A table as its cells are compared: names trimmed, nulls of every column taking the value above
    them (in the given order, within ``by``), keys as normalised text; the order columns go. A table
    without ``by`` is filled in one task: name its parts (files, pages, tables) for large inputs."""
    out = df.toDF(*(c.strip() for c in df.columns))
    out = forward_fill(out, [c for c in out.columns if c not in (*order, *by)], order, by)
    return out.withColumns({k: normalize_cell(k) for k in keys if k in out.columns}).drop(*order)


def visible_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.strip() and c.strip() not in LINEAGE]


def normalize_frame(df: DataFrame, order: Sequence[str], key_columns: Sequence[str] = (), numeric_columns: Sequence[str] | None = None, fill_keys: bool = True) -> DataFrame:
    """Cells normalised, keys filled down, numeric columns as plain numbers (text where unreadable)."""
    names = [c for c in df.columns if c not in order]
    out = df.withColumns({c: normalize_cell(c) for c in names})
    if fill_keys and key_columns:
        out = forward_fill(out, list(key_columns), order, blank_is_null=True)
    return out.withColumns({c: normalize_number_or_text(c) for c in names if is_numeric_column(c, numeric_columns)})


def join_rows(base: DataFrame, scan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on the keys: struct base, struct scan (null where missing), merge_status.
    Equal keys multiply, on both sides. Null keys match null keys."""
    for name in keys:
        if name not in base.columns or name not in scan.columns:
            raise ValueError(f"key column {name!r} is missing")
    pack = lambda df, side: df.select(*(F.col(k).alias(f"{side}_{k}") for k in keys), F.struct(*df.columns).alias(side))
    left, right = pack(base, "base"), pack(scan, "scan")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"base_{k}").eqNullSafe(F.col(f"scan_{k}"))
    joined = left.join(right, on, "full_outer")
    status = F.when(F.col("scan").isNull(), "left_only").when(F.col("base").isNull(), "right_only").otherwise("both")
    return joined.select(*(F.coalesce(f"base_{k}", f"scan_{k}").alias(k) for k in keys), "base", "scan", status.alias("merge_status"))


def compare_cells(base: DataFrame, scan: DataFrame, key_columns: Sequence[str], max_distance: int = 1, numeric_columns: Sequence[str] | None = None, numeric_tolerance: str = "0.01", with_row_index: bool = True, order: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Differing cells of two keyed tables. With ``order`` both are first prepared(): names trimmed,
    nulls filled down, keys compared as text.

    One row for each missing row (``row_presence``) and each comparable cell that differs: numeric
    columns by an exact decimal tolerance, others by edit distance; a numeric cell that can't be
    read is compared as text with distance 1 (``numeric_parse_failed``). Columns: the keys,
    row_index (position of the joined row in key order), column, comparison_type, base_text,
    scan_text, base_value, scan_value, numeric_diff, distance, similarity, merge_status.

    row_index needs one global order; without it the plan has only the join's shuffle.
    """
    keys = [k.strip() for k in key_columns] if order else list(key_columns)
    if order:
        base, scan = (prepared(x, keys, order, by) for x in (base, scan))
    joined = join_rows(base, scan, keys)
    if with_row_index:
        joined = numbered(joined, [F.col(k).asc_nulls_last() for k in keys] + [F.hash("base"), F.hash("scan")], "row_index")
    head = ["row_index", *keys] if with_row_index else keys
    names = [c for c in base.columns if c in scan.columns and c not in keys and c.strip()]
    presence = F.when(F.col("merge_status") != "both", F.array(F.struct(F.lit("__row__").alias("column"), F.lit(False).alias("numeric"), F.lit("").alias("base_text"), F.lit("").alias("scan_text"))))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(is_numeric_column(c, numeric_columns)).alias("numeric"), normalize_cell(F.col("base")[c]).alias("base_text"), normalize_cell(F.col("scan")[c]).alias("scan_text")) for c in names)) if names else F.lit(None).cast("array<struct<column: string, numeric: boolean, base_text: string, scan_text: string>>")
    # Equal texts differ in nothing: they go before numbers and distances are worked out.
    cells = F.filter(cells, lambda x: x["base_text"] != x["scan_text"])
    rows = joined.select(*head, "merge_status", F.inline(F.coalesce(presence, cells)))
    rows = rows.withColumns({"base_value": F.when(F.col("numeric"), normalize_number("base_text")), "scan_value": F.when(F.col("numeric"), normalize_number("scan_text"))})
    readable = F.col("base_value").isNotNull() & F.col("scan_value").isNotNull()
    both = F.col("merge_status") == "both"
    distance = F.when(both & ~(F.col("numeric") & readable), F.levenshtein("base_text", "scan_text"))
    rows = rows.withColumns({
        "comparison_type": F.when(~both, "row_presence").when(F.col("numeric") & readable, "numeric").when(F.col("numeric"), "numeric_parse_failed").otherwise("text"),
        "numeric_diff": F.when(F.col("numeric") & readable, F.abs(F.col("base_value") - F.col("scan_value"))),
        "distance": distance,
    })
    tolerance = F.lit(numeric_tolerance).cast("decimal(38,10)")
    differs = F.when(~both, True).when(F.col("comparison_type") == "numeric", F.col("numeric_diff") > tolerance).when(F.col("comparison_type") == "numeric_parse_failed", F.col("distance") > 1).otherwise(F.col("distance") > max_distance)
    longest = F.greatest(F.length("base_text"), F.length("scan_text"), F.lit(1))
    rows = rows.where(differs).withColumn("similarity", F.round(1 - F.col("distance") / longest, 6))
    return rows.select(*head, F.when(both, F.col("column")).otherwise("").alias("column"), "comparison_type", "base_text", "scan_text", "base_value", "scan_value", "numeric_diff", "distance", "similarity", "merge_status")


def numbered(df: DataFrame, order: Sequence[Column], name: str, start: int = 0, partitions: int | None = None) -> DataFrame:
    """Dense global numbers in an order, without gathering rows in one task: rows are range
    partitioned and sorted, each partition is counted, and offsets are added to local numbers."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    keyed = keyed.withColumn("_id", F.monotonically_increasing_id())
    # Range bounds are sampled, so the numbered rows are kept: both uses below must see the same.
    keyed = stored(keyed.withColumn("_part", F.shiftright("_id", 33)), "numbered")
    sizes = keyed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return keyed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + local + start).cast("long")).drop("_id", "_part", "_before")


def cell_differences(cells: DataFrame, keys: Sequence[str], candidate_page=None, baseline_page=None) -> DataFrame:
    """Cell differences as difference rows: numeric ones are high, others medium."""
    shown = F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys))
    place = F.when(F.col("column") == "", F.lit("row")).otherwise(F.concat(F.lit("column "), "column"))
    return cells.withColumns({
        "diff_type": F.lit("table_cell_modified"),
        "severity": F.when(F.col("comparison_type") == "numeric", "high").otherwise("medium"),
        "message": F.concat(F.lit("Table cell differs in "), place, F.lit(" ("), "comparison_type", F.lit(") at "), shown),
        "candidate_page": F.lit(candidate_page).cast("int"),
        "baseline_page": F.lit(baseline_page).cast("int"),
    })
