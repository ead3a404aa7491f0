import io
import random
import zipfile
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from veridelta import cli
from veridelta.functions import layout, text
from veridelta.operators import align, cells, elements, evidence, images, page_tables, tables
from veridelta.plans import compare, report
from veridelta.sources import files, html, ocr

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_numbers(spark):
    given = ["￥1,234.50元", "(5)", "—3", "abc", "", None, "1e2", " － 7 ".replace(" ", ""), "NaN"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").select("i", text.normalize_number("x").alias("n")).orderBy("i").collect()
    assert [None if r.n is None else float(r.n) for r in rows] == [1234.5, -5, -3, None, None, None, 100, -7, None]


def test_text(spark):
    got = one(spark, text.collapse_space(F.lit(" a　 b\n\xa0c ")).alias("a"), text.compact(F.lit("a b　c")).alias("b"), text.edit_similarity(F.lit("合同"), F.lit("合约")).alias("c"), text.edit_similarity(F.lit(""), F.lit("")).alias("d"), text.count_similarity(F.lit(3), F.lit(4)).alias("e"), text.count_similarity(F.lit(0), F.lit(0)).alias("f"), text.sequence_ratio(F.lit("tide"), F.lit("diet")).alias("g"))
    assert tuple(got) == ("a b c", "abc", 0.5, 1.0, 0.75, 1.0, 0.25)
    assert text.ratio("diet", "tide") == 0.5
    assert text.is_numeric_column(" Unit Price ") and not text.is_numeric_column("name") and text.is_numeric_column("Name", ["name"])


def test_kinds(spark):
    rows = [("第 3 页", 9, False), ("目录 abc", 9, False), ("签字：", 9, False), ("", 9, True), ("附件" + "x" * 200, 9, False), ("x" * 100, 9, False), ("x" * 200, 9, False)]
    got = spark.createDataFrame(rows, "t string, n int, b boolean").select(layout.page_kind("t", "n", "b").alias("k")).collect()
    assert [r.k.removeprefix("likely_") for r in got] == ["page_number_residue", "toc_or_cover_format_noise", "short_signature_or_date_page", "blank_or_near_blank", "attachment_start_page_needs_manual_review", "pagination_split_noise", "unknown_needs_manual_review"]
    got = one(spark, layout.file_type(F.lit("/a/b.PDF")).alias("a"), layout.file_type(F.lit("x.docx.tmp")).alias("b"), layout.table_like(F.lit("a\tb\nc  d  e")).alias("c"), layout.table_rows(F.lit("a\tb\n\nc  d")).alias("d"))
    assert (got.a, got.b, got.c, got.d) == ("pdf", "unknown", True, [["a", "b"], ["c", "d"]])


def test_cells(spark):
    base = spark.createDataFrame([(1, "a", "1.00"), (2, "b", "2.00"), (3, "c", "x"), (5, "same", "7")], "k int, name string, price string")
    scan = spark.createDataFrame([(1, "a", "1.01"), (2, "bbbb", "2.02"), (3, "c", "yyyy"), (4, "d", "4"), (5, "same", "7")], "k int, name string, price string")
    got = {(r.k, r.column): r for r in cells.compare_cells(base, scan, ["k"]).collect()}
    assert set(got) == {(2, "name"), (2, "price"), (3, "price"), (4, "")}
    assert got[2, "price"].comparison_type == "numeric" and float(got[2, "price"].numeric_diff) == 0.02 and got[2, "price"].row_index == 1
    assert got[3, "price"].comparison_type == "numeric_parse_failed" and got[4, ""].merge_status == "right_only"
    with pytest.raises(ValueError):
        cells.compare_cells(base, scan, ["missing"])


def test_numbers_are_dense(spark):
    rows = cells.numbered(spark.range(1000).withColumn("x", F.rand(1)), [F.col("x"), F.col("id")], "n", 1).orderBy("x", "id").collect()
    assert [r.n for r in rows] == list(range(1, 1001))


def test_header_and_lineage(spark):
    rows = spark.createDataFrame([("t", 0, 0, " A "), ("t", 0, 1, "B"), ("t", 1, 0, "1"), ("t", 1, 1, None)], "table_id string, row_idx int, col_idx int, value string")
    got = sorted(tuple(r) for r in cells.promote_header(rows).select("row_idx", "col_name", "value").collect())
    assert got == [(0, "A", "1"), (0, "B", None)]
    frame = spark.createDataFrame([(0, "x", "1,000.50"), (1, "", "abc")], "i int, key string, amount string")
    got = [tuple(r) for r in cells.normalize_frame(frame, ["i"], ["key"]).orderBy("i").collect()]
    assert got == [(0, "x", "1000.5"), (1, "x", "abc")]


def test_decision_bands(spark):
    got = spark.createDataFrame([(0.75,), (0.7499,), (0.45,), (0.4499,)], "s double").select(tables.decision("s").alias("d")).collect()
    assert [r.d for r in got] == ["auto_match", "needs_review", "needs_review", "no_match"]


def brute_align(candidate, baseline, match=0.75, low=0.45, window=2):
    used, cursor, out = set(), 0, []
    for i, c in enumerate(candidate):

        def best(reach):
            found = None
            for j in range(max(0, cursor - reach), min(len(baseline), cursor + reach + 1)):
                if j not in used:
                    s = align.page_score(c, baseline[j], abs(i - j))["score"]
                    if found is None or s > found[1]:
                        found = (j, s)
            return found

        got = best(window)
        if (got[1] if got else 0) < low:
            wide = best(min(max(3 * window, window + 3), len(baseline)))
            if wide and (got is None or wide[1] > got[1]):
                got = wide
        if got is None or got[1] < low:
            out.append((i, None, "candidate_added"))
            continue
        j, s = got
        out.append((i, j, ("matched" if j >= cursor else "possible_reordered") if s >= match else "low_confidence"))
        used.add(j)
        cursor = max(cursor, j + 1)
    return out + [(None, j, "baseline_deleted") for j in range(len(baseline)) if j not in used]


def test_alignment(spark):
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    pages = [" ".join(rng.choice(words) for _ in range(30)) + f"\nline {i}" for i in range(14)]
    other = [p for i, p in enumerate(pages) if i not in (3, 4, 9)]
    other[5], other[6] = other[6], other[5]
    other.insert(2, "completely new 12345 !!!")
    frame = lambda ps: spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(ps)], "pair_id string, page_number int, text string")
    page_rows, element_rows = compare.from_texts(frame(other), frame(pages))
    prints = align.fingerprints(page_rows, element_rows)
    sides = {"candidate": [], "baseline": []}
    for r in prints.orderBy("page_index").collect():
        sides[r.side].append(r.asDict() | {"tokens": set(r.tokens)})
    got = [(r.candidate_index, r.baseline_index, r.status) for r in align.align(prints).orderBy("alignment_seq").collect()]
    assert got == brute_align(sides["candidate"], sides["baseline"])
    whole = compare.DocumentComparison(page_rows, element_rows)
    found = whole.evidence().orderBy("seq").collect()
    assert [r.seq for r in found] == list(range(1, len(found) + 1)) and found[0].evidence_id.startswith("ev-00001-")
    assert {r.diff_type for r in found} >= {"page_added", "page_deleted"}


def test_flags_boxes_and_tables(spark, tmp_path):
    """Low confidence asks for a review, tables for a comparison, which then finds the cell."""
    for side, price in (("c", "987654.25"), ("b", "2.00")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "d.docx").write_bytes(docx(["the same words on both sides of it"], [["id", "price", "name"], ["1", price, "ann"], ["2", "3.00", "bob"]]))
    docs = {s: files.read_documents(spark, str(tmp_path / s[0])) for s in ("candidate", "baseline")}
    sides = [files.as_pages(docs[s], s, "pair") for s in docs]
    cells_ = [files.table_cells(docs[s]).select(F.lit("pair").alias("pair_id"), F.lit(s).alias("side"), "page_index", "table_id", "row_idx", "col_idx", "col_name", "value") for s in docs]
    both = [sides[0][i].unionByName(sides[1][i]) for i in (0, 1)]
    cells_ = cells_[0].unionByName(cells_[1])
    plain_run = compare.DocumentComparison(*both).differences().collect()
    assert [r.diff_type for r in plain_run if r.requires_table_compare] == ["table_modified"]
    found = compare.DocumentComparison(*both, cells=cells_, key_columns=["id"]).evidence().collect()
    assert [(r.severity, r.category) for r in found if r.diff_type == "table_cell_modified"] == [("high", "table")]
    counts = report.summary_dict(compare.DocumentComparison(*both).evidence())
    assert counts["requires_table_compare_count"] == 1 and counts["total"] == len(plain_run)

    box = "struct<page_number:int,x0:double,y0:double,x1:double,y1:double>"
    pages = spark.createDataFrame([("p", s, 0, 1, "one page of text that is the same") for s in ("candidate", "baseline")], "pair_id string, side string, page_index int, page_number int, plain_text string")
    items = spark.createDataFrame([("p", "candidate", 0, 0, "i1", "image", "", (1, 0.0, 0.0, 10.0, 10.0), 10, 10, "png"), ("p", "baseline", 0, 0, "i2", "image", "", (1, 50.0, 0.0, 90.0, 90.0), 70, 90, "jpg"), ("p", "candidate", 0, 1, "i3", "image", "", None, 0, 0, None)], f"pair_id string, side string, page_index int, element_ordinal int, element_id string, element_type string, text string, bbox {box}, width int, height int, extension string")
    run = compare.DocumentComparison(pages, items, match=0.3, low=0.1)
    got = {r.diff_type: r for r in run.differences().collect()}
    added = [r for r in run.differences().collect() if r.diff_type == "image_added"]
    assert "image_added" in got and all(r.metadata["element_type"] == "image" for r in added)
    low = [r for r in run.differences().collect() if r.diff_type == "low_confidence_element_match"]
    assert all(r.requires_manual_review for r in low)
    boxed = [r for r in run.annotations().collect() if r.bbox_available]
    assert boxed and all(r.annotation_type == "image_block" or r.annotation_label for r in boxed)
    assert elements.page_profile(run.prints).where("side = 'candidate'").select("image_count", "is_blank").first() == (2, False)
    assert report.bundle_counts(pages, run.evidence())["candidate_page_count"] == 1


def test_whole_reports(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id"), F.concat(F.lit("a,\""), F.col("id").cast("string")).alias("t"))
    path = report.write_csv_file(rows, str(tmp_path / "x.csv"), allow_write=True)
    assert len(open(path, encoding="utf-8-sig").read().splitlines()) == 3001
    assert report.write_csv_file(rows.limit(0), str(tmp_path / "y.csv"), write_empty=False, allow_write=True) is None
    assert report.safe_name("../a b:c.png") == "a_b_c.png" and report.safe_name("..") == "unnamed"


def test_wide_spans_and_blank_pages(spark):
    found = html.parse_spans("<table><tr><td colspan=5000>A</td><td>B</td></tr><tr><td rowspan=3000>C<b>c</b></td></tr><tr><td>D</td></tr></table>")
    assert [(c[1], c[2], c[6]) for c in found] == [(0, 0, "A"), (0, 5000, "B"), (1, 0, "C c"), (2, 1, "D")]
    pages = spark.createDataFrame([("p", "candidate", 0, 1, "\n\t"), ("p", "baseline", 0, 1, " x ")], "pair_id string, side string, page_index int, page_number int, plain_text string")
    none = spark.createDataFrame([], "pair_id string, side string, page_index int, element_ordinal int, element_id string, element_type string, text string")
    assert {r.side: r.is_blank for r in align.fingerprints(pages, none).collect()} == {"candidate": True, "baseline": False}


def test_greedy_is_one_to_one():
    rng = random.Random(1)
    left, right = ([{"text": "".join(rng.choice("ab") for _ in range(5))} for _ in range(12)] for _ in range(2))
    plain = elements.greedy([(s, i, j) for i, a in enumerate(left) for j, b in enumerate(right) if (s := SequenceMatcher(None, a["text"], b["text"]).ratio()) >= 0.01])
    same = elements._equal(left, right)
    assert [x for x in plain if x[0] == 1.0] == same
    assert len({x[1] for x in plain}) == len(plain) == len({x[2] for x in plain})


def test_bounds_hold():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert align.most_ratio(a, b) >= text.ratio(a, b) - 1e-12


def test_html(spark):
    table = "<table><tr><td rowspan=2>A</td><td>B</td></tr><tr><td>C"
    assert [(c[1], c[2], c[6]) for c in html.parse_spans(table)] == [(0, 0, "A"), (0, 1, "B"), (1, 1, "C")]
    assert html.parse_spans(None) == [] and html.parse_elements("<h1>T</h1><ul><li>x</ul>") == [("title", "T"), ("paragraph", "x")]
    cell_rows = spark.range(1).select(F.inline(html.spans(F.lit(table))))
    got = {(r.row_idx, r.col_idx): r.value for r in html.grid(cell_rows, []).collect()}
    assert got == {(0, 0): "A", (1, 0): "A", (0, 1): "B", (1, 1): "C"}


def test_ocr(spark):
    got = one(spark, ocr.block(F.lit('{"type": "Seal", "res": {"rec_texts": ["a", "b"], "bbox": [1, 2, 3, "x"]}}')).alias("a"), ocr.block(F.lit("not json")).alias("b"))
    assert (got.a.element_type, got.a.text, got.a.bbox) == ("signature", "a b", None)
    assert (got.b.element_type, got.b.text) == ("unknown", "")
    rows = spark.createDataFrame([(1, '[{"type":"title","text":"T"},{"label":"table","pred_html":"<table></table>"}]')], "id int, j string")
    assert [(r.element_ordinal, r.element_type, r.html) for r in ocr.blocks(rows, ["id"], "j").orderBy("element_ordinal").collect()] == [(0, "title", None), (1, "table", "<table></table>")]


def docx(paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_files_and_cli(spark, tmp_path, capsys):
    for side, word in (("c", "changed"), ("b", "old")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "d.docx").write_bytes(docx(["same line", f"this one is {word} here"], [["a", "b"], ["1", "2"]]))
    (tmp_path / "c" / "~$d.docx").write_bytes(b"")
    (tmp_path / "b" / "x.pdf").write_bytes(b"%PDF")
    rows = {r.file_path.rsplit("/")[-1]: r for r in files.read_documents(spark, str(tmp_path / "b")).collect()}
    assert rows["d.docx"].elements[2].rows == 2 and "RuntimeError" in rows["x.pdf"].error
    assert files.document_text(files.read_documents(spark, str(tmp_path / "c"))).first().text == "same line\nthis one is changed here"
    out = tmp_path / "out"
    assert cli.main([str(tmp_path / "c"), str(tmp_path / "b"), "--output", str(out)]) == 3
    assert cli.main([str(tmp_path / "none"), str(tmp_path / "b")]) == 2 and cli.main(["a", "b", "--low", "2"]) == 1
    assert cli.main([str(tmp_path / "c"), str(tmp_path / "b"), "--output", str(out), "--allow-write"]) == 0
    assert "paragraph_modified" in (out / "verification_report.md").read_text()
    assert cli.main([str(tmp_path / "c"), str(tmp_path / "b"), "--output", str(out), "--allow-write"]) == 3


def test_report_gate(spark, tmp_path):
    with pytest.raises(PermissionError):
        report.write_text(str(tmp_path / "a"), "x")
    report.write_text(str(tmp_path / "a"), "x", allow_write=True)
    with pytest.raises(FileExistsError):
        report.write_text(str(tmp_path / "a"), "x", allow_write=True)


def test_images(spark):
    import numpy as np

    page = np.full((130, 130, 3), 255, np.uint8)
    page[10:30, 10:30] = (0, 0, 220)
    page[50:60] = 0
    clean = images.suppress_red(page)
    assert (clean[10:30, 10:30] == 255).all() and (clean[50:60] == 0).all()
    small = images.thumbnail(images.red_gray(page))
    assert abs(small.mean()) < 1e-9 and abs(small.std() - 1) < 1e-9
    assert images.thumbnail(np.zeros((9, 9))).sum() == 0


def test_stream(spark, tmp_path):
    from veridelta.streaming.watch import watch

    make = lambda t: spark.createDataFrame([("p", 1, t)], "pair_id string, page_number int, text string")
    make("a text that has changed a bit").write.parquet(str(tmp_path / "in"))
    got = []
    query = watch(spark, str(tmp_path / "in"), make("a text that was changed a lot"), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"), once=True)
    query.awaitTermination()
    assert min(r.evidence_id for r in got).startswith("ev-00001")


def test_entry_without_optional_part(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    repo = pathlib.Path(__spark_entry__.__file__).parent
    shutil.copytree(repo / "veridelta", tmp_path / "veridelta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n); assert set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_page_tables(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "d.docx").write_bytes(docx(["x"], [["id", "price", "name"], ["1", "2.00", "ann"], ["2", "3.00", "bob"], ["3", "1", "eve"]]))
    (tmp_path / "c" / "d.docx").write_bytes(docx(["x"], [["id", "price", "name"], ["1", "2.50", "ann"], ["2", "3.01", "robert"], ["4", "1", "eve"]]))
    side = lambda s: files.table_cells(files.read_documents(spark, str(tmp_path / s[0]))).select(F.lit("p").alias("pair_id"), F.lit(s).alias("side"), "page_index", "table_id", "row_idx", "col_idx", "col_name", "value")
    cells_ = side("candidate").unionByName(side("baseline"))
    pages = spark.createDataFrame([("p", 0, 0, 0, "matched")], "pair_id string, alignment_seq int, candidate_index int, baseline_index int, status string")
    got = page_tables.compare_tables(pages, cells_, key_columns=["id"]).collect()
    assert sorted((r.severity, r.message.split(" at ")[0]) for r in got) == [("high", "Table cell differs (numeric) in price"), ("medium", "Table cell differs (row_presence) in row"), ("medium", "Table cell differs (row_presence) in row"), ("medium", "Table cell differs (text) in name")]
    assert [r.severity for r in page_tables.compare_tables(pages, cells_).collect()] == ["low"]
    assert [r.diff_type for r in page_tables.compare_tables(pages, cells_.where("side = 'baseline'"), key_columns=["id"]).collect()] == ["table_deleted"]
    none = spark.createDataFrame([], "pair_id string, alignment_seq int")
    assert page_tables.compare_tables(pages, cells_, none, ["id"]).count() == 0


def plain(value):
    if isinstance(value, float):
        return f"{value:.8g}"
    return [plain(v) for v in value] if isinstance(value, list | tuple) else str(value)


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if n.startswith("q_")))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = __spark_entry__.queries()[name](spark, SF)
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(str(plain(list(r))) for r in found.select(*names).collect()) == sorted(str(plain(list(r))) for r in want.fetchall())


def test_pages_of_every_language(spark):
    from collections import Counter

    from veridelta.plans import catalogue

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "text").collect()
    got = catalogue.QUERIES["q_align_pages"](spark, sf).collect()
    assert Counter(r.pair_id for r in got if r.baseline_index is not None) == Counter(r.source for r in rows)
    assert Counter(r.pair_id for r in got if r.candidate_index is not None) == Counter(r.source for r in rows if r.doc_id % 11 != 3)
    assert any(r.lang != "en" for r in rows) and any(not r.text.isascii() for r in rows)


def test_duplicate_keys_of_the_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()["q_cell_diff_dups_whole"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["q_cell_diff_dups_whole"](spark, SF).collect()]
    rows = con.execute("SELECT count(*) FROM lineitem").fetchone()[0]
    assert sorted(got) == sorted(want) and sum(n for _, n, _ in got) > 0.9 * rows


def test_page_locator_ties(spark, tmp_path):
    """Scores equal to four digits go by id, and flat vectors have no score, as in its SQL."""
    rng = random.Random(5)
    base = [rng.gauss(0, 1) for _ in range(64)]
    rows = [(i, [x + (rng.gauss(0, 0.004) if i else 0) for x in base]) for i in range(40)]
    rows += [(40, [1.0] * 64), (41, [0.0] * 64), (42, [float("nan"), *base[1:]]), (43, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()["q_page_locator"]).fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["q_page_locator"](spark, str(tmp_path)).collect()]
    assert [plain(list(r)) for r in got] == [plain(list(r)) for r in want]


def test_alignment_of_a_long_pair(spark):
    """One side far ahead of the other, windows of several widths: as worked out on whole lists."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    baseline = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(260)]
    candidate = [f"new page {i} " + " ".join(rng.choice("xyz") for _ in range(9)) for i in range(120)] + [t for i, t in enumerate(baseline) if i % 5]
    frame = lambda ps: spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(ps)], "pair_id string, page_number int, text string")
    for c, b in ((candidate, baseline), (baseline, candidate), (candidate, baseline[:4]), (candidate[:3], []), ([], baseline)):
        prints = align.fingerprints(*compare.from_texts(frame(c), frame(b)))
        sides = {"candidate": [], "baseline": []}
        for r in prints.orderBy("page_index").collect():
            sides[r.side].append(r.asDict() | {"tokens": set(r.tokens)})
        for window in (0, 2, 5):
            got = [(r.candidate_index, r.baseline_index, r.status) for r in align.align(prints, window=window).orderBy("alignment_seq").collect()]
            assert got == brute_align(sides["candidate"], sides["baseline"], window=window)


def test_texts_of_pages_are_shuffled_once(spark):
    from veridelta.plans import catalogue

    found = catalogue._comparison(spark, "/root/testdata/sf0.001")
    plan = align.align(found.prints)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("+- == Initial Plan ==")[0].count("Exchange ") == 1
    # What is read with the alignments holds no whole text.
    kinds = elements.pair_pages(found.alignments, found.prints).schema["c"].dataType.names
    assert not {"normalized_text", "tokens", "table_text"} & set(kinds)


def test_line_and_element_fingerprints_agree(spark):
    rows = [("p", "candidate", 1, "one\n\n two \n\tthree"), ("p", "baseline", 1, "\n \t\n"), ("p", "baseline", 2, None), ("p", "candidate", 2, ""), ("p", "candidate", 3, "é" * 200)]
    pages, items = compare.from_sides(spark.createDataFrame(rows, "pair_id string, side string, page_number int, text string"))
    key = lambda df: sorted(str(r) for r in df.drop("body").collect())
    assert key(align.fingerprints(pages, items)) == key(align.fingerprints(pages.drop("lines"), items))


def test_differences_are_worked_out_once(spark, monkeypatch):
    kept, real = [], compare.stored
    monkeypatch.setattr(compare, "stored", lambda df, name="part": (kept.append(name), real(df, name))[1])
    frame = lambda ps: spark.createDataFrame([("p", i + 1, t) for i, t in enumerate(ps)], "pair_id string, page_number int, text string")
    same = "alpha beta gamma delta\nepsilon zeta eta theta"
    found = compare.DocumentComparison(*compare.from_texts(frame([same, same + " iota"]), frame([same, same])))
    assert [r.diff_type for r in elements.element_differences(found.pairs, found.elements).collect()] == ["paragraph_modified"]
    assert found.pairs.where("status = 'matched' and c.body <> b.body").count() == 1
    found.evidence()
    assert kept == ["alignments", "pairs", "found"]


def test_ratio_is_difflibs():
    rng = random.Random(4)
    alphabets = ("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + " " * 8 + "eeeetttt", "éßa漢 ")
    for n in range(800):
        letters = rng.choice(alphabets)
        a = "".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice((5, 60, 250, 3000 if n % 20 == 0 else 300)))))
        b = "".join(c if rng.random() < 0.97 else rng.choice(("", letters[0], letters[-1] * 2)) for c in a) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 250)))
        if b:
            assert text.ratio(a, b) == SequenceMatcher(None, a, b).ratio()
            assert text._matched(a, b, few=0) == text._matched(a, b, few=1 << 40)


def test_greedy_texts_is_greedy():
    rng = random.Random(6)
    for _ in range(200):
        left, right = (["".join(rng.choice("ab c") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 9))] for _ in range(2))
        scores = [(s, i, j) for i, a in enumerate(left) for j, b in enumerate(right) if (s := text.ratio(a, b)) >= elements.LEAST]
        assert elements.greedy_texts(left, right) == elements.greedy(scores)
