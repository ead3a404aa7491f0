"""Sinks: CSV, JSON, Markdown and HTML, behind a write gate.

Everything is written unless ``limit`` is given, which bounds the records shown. Rows come to the driver
one partition at a time; rows of any number are written by the executors (write_rows).
"""

from __future__ import annotations

import csv
import html
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridelta.operators import evidence as ev


def allow(path: str, allow_write: bool, overwrite: bool) -> None:
    """Writing is off unless asked for, and never replaces a file unless asked for."""
    if not allow_write:
        raise PermissionError(f"writing {path} needs allow_write=True")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)


def write_text(path: str, text: str, allow_write: bool = False, overwrite: bool = False, encoding: str = "utf-8") -> str:
    allow(path, allow_write, overwrite)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding=encoding) as out:
        out.write(text)
    return path


def write_rows(df: DataFrame, path: str, form: str = "parquet", allow_write: bool = False, overwrite: bool = False) -> str:
    """Rows of any number, written by the executors."""
    if not allow_write:
        raise PermissionError(f"writing {path} needs allow_write=True")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    writer.option("header", True).format(form).save(path)
    return path


def write_csv_file(df: DataFrame, path: str, limit: int | None = None, write_empty: bool = True, allow_write: bool = False, overwrite: bool = False) -> str | None:
    """One CSV file with a byte order mark, of all rows unless limited; None if there are no rows and
    none are wanted."""
    allow(path, allow_write, overwrite)
    rows = (df if limit is None else df.limit(limit)).toLocalIterator()
    first = next(rows, None)
    if first is None and not write_empty:
        return None
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as out:
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(df.columns)
        if first is not None:
            writer.writerow(first)
            writer.writerows(rows)
    return path


def safe_name(name: str) -> str:
    """A file name of letters, digits, dots, dashes and underscores."""
    return re.sub(r"[^\w.-]+", "_", name).strip("._") or "unnamed"


def bundle_counts(pages: DataFrame, evidence: DataFrame, rendered: DataFrame | None = None) -> dict:
    """Numbers of a comparison: pages by side, differences, records with a box, renderings by status."""
    sides = {r["side"]: r["n"] for r in pages.groupBy("side").agg(F.count("*").alias("n")).collect()}
    boxed = [c for c in ("candidate_bbox", "baseline_bbox") if c in evidence.columns]
    has = F.coalesce(*(F.col(c).isNotNull() for c in boxed)) if boxed else F.lit(False)
    total = evidence.agg(F.count("*").alias("n"), F.count_if(has).alias("boxed")).collect()[0]
    out = {"candidate_page_count": sides.get("candidate", 0), "baseline_page_count": sides.get("baseline", 0), "difference_count": total["n"], "boxed_count": total["boxed"]}
    if rendered is not None:
        out["render_status"] = {r["render_status"]: r["n"] for r in rendered.groupBy("render_status").agg(F.count("*").alias("n")).collect()}
    return out


def summary_dict(evidence: DataFrame) -> dict:
    out: dict = {"total": 0, "by_severity": {}, "by_category": {}, "by_diff_type": {}, "requires_manual_review_count": 0, "requires_table_compare_count": 0}
    for r in ev.summary(evidence).orderBy("dimension", "value").collect():
        if r["dimension"] == "total":
            out["total"] = r["n"]
        elif r["dimension"].startswith("requires_"):
            out[f"{r['dimension']}_count"] = r["n"]
        else:
            out[f"by_{r['dimension']}"][r["value"]] = r["n"]
    found = ev.pages(evidence).groupBy("side").agg(F.array_sort(F.collect_set("page")).alias("pages")).collect()
    pages = {r["side"]: r["pages"] for r in found}
    return out | {"candidate_pages": pages.get("candidate", []), "baseline_pages": pages.get("baseline", [])}


# The section headings of reports.
_SHOWN = ("seq", "evidence_id", "category", "severity", "diff_type", "candidate_page", "baseline_page", "message")


def _records(evidence: DataFrame, limit: int | None) -> list[dict]:
    names = [c for c in (*_SHOWN, "metadata") if c in evidence.columns]
    rows = evidence.select(*names).orderBy("seq")
    return [r.asDict() for r in (rows if limit is None else rows.limit(limit)).toLocalIterator()]


def _block(r: dict) -> list[str]:
    more = ["", "```json", json.dumps(r["metadata"], ensure_ascii=False, indent=2, sort_keys=True), "```"] if r.get("metadata") else []
    return [f"### {r['evidence_id']}", "", *(f"- {k}: {r[k]}" for k in _SHOWN[2:] if k in r), *more, ""]


def markdown(evidence: DataFrame, metadata: dict | None = None, limit: int | None = None, annotations: DataFrame | None = None) -> str:
    """Summary, metadata, first annotations, records by candidate page, records without one."""
    lines = ["# Document comparison", "", "## Summary", "", "```json", json.dumps(summary_dict(evidence), ensure_ascii=False, indent=2), "```", "", "## Metadata", ""]
    lines += [f"- {k}: {(metadata or {})[k]}" for k in sorted(metadata or {})] + [""]
    lines += ["## Evidence Annotations", ""]
    if annotations is not None:
        first = annotations.orderBy("diff_index").limit(20).collect()
        lines += [f"- {r['evidence_id']}: {r['annotation_label']} ({r['annotation_type']}, {r['review_status']})" for r in first]
    records = _records(evidence, limit)
    lines += ["", "## Evidence by Candidate Page", ""]
    for page in sorted({r["candidate_page"] for r in records if r["candidate_page"] is not None}):
        lines += [f"## Candidate page {page}", ""]
        for r in records:
            if r["candidate_page"] == page:
                lines += _block(r)
    lines += ["## Evidence Without Candidate Page", ""]
    for r in records:
        if r["candidate_page"] is None:
            lines += _block(r)
    return "\n".join(lines) + "\n"


def html_report(evidence: DataFrame, metadata: dict | None = None, limit: int | None = None) -> str:
    e = lambda x: html.escape("" if x is None else str(x))
    s = summary_dict(evidence)
    cards = "".join(f"<div class='card'><b>{e(k)}</b> {e(v)}</div>" for k, v in s.items() if not isinstance(v, dict | list))
    names = _SHOWN[1:]
    body = "".join("<tr>" + "".join(f"<td>{e(r.get(k))}</td>" for k in names) + "</tr>" for r in _records(evidence, limit))
    head = "".join(f"<th>{e(k)}</th>" for k in names)
    blob = e(json.dumps({"summary": s, "metadata": metadata or {}}, ensure_ascii=False, indent=2, default=str))
    return f"<!doctype html><html><head><meta charset='utf-8'><title>Document comparison</title></head><body><h1>Document comparison</h1>{cards}<pre>{blob}</pre><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></body></html>\n"


def write_bundle(evidence: DataFrame, folder: str, metadata: dict | None = None, allow_write: bool = False, overwrite: bool = False, limit: int | None = None) -> dict[str, str]:
    """Report as HTML and Markdown, and the summary as JSON; nothing is written unless all may be."""
    paths = {n: os.path.join(folder, n) for n in ("verification_report.html", "verification_report.md", "verification_summary.json")}
    for path in paths.values():
        allow(path, allow_write, overwrite)
    texts = (html_report(evidence, metadata, limit), markdown(evidence, metadata, limit), json.dumps(summary_dict(evidence), ensure_ascii=False, indent=2) + "\n")
    return {n: write_text(p, t, allow_write, overwrite) for (n, p), t in zip(paths.items(), texts, strict=True)}
