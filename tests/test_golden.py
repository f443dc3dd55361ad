"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import clean as C
from pagewright.functions import predicates as P
from pagewright.operators import chunks as CH
from pagewright.operators import headings, lines, paragraphs, sections, tables


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "analyzer", "parser", "chunker"),
    [
        ("$116.18 - $91.50", True, True, False),
        ("-", False, False, False),
        ("—", False, False, False),
        ("$", False, False, False),
        ("", False, False, False),
        ("(228)", True, True, True),
        ("12%", True, True, True),
        ("1,234", True, True, True),
        ("1e5", False, False, True),
        ("1d", False, False, False),
    ],
)
def test_numeric(spark, text, analyzer, parser, chunker):
    assert [one(spark, text, f) for f in (P.numeric_token, P.numeric_cell, P.numeric_value)] == [analyzer, parser, chunker]


def test_html_names(spark):
    assert one(spark, "foo.html", lambda c: C.apply(c, C.V1["c14_artifacts"])) == "l"
    assert one(spark, "foo.html", lambda c: C.clean(c, C.V2)) == ""
    assert one(spark, "6/6/14", lambda c: C.clean(c, C.V2)) == "6/6/14"


def page(spark, rows, schema):
    return spark.createDataFrame([("c", "f", 1, *r) for r in rows], "company string, file_name string, page_index int, " + schema)


def test_export_block(spark):
    block = ["Apple Inc. | 2016 Form 10-K | 22", "5/16/26, 9:56 AM", "Document", "https://www.sec.gov/x", "25/84"]
    whole = page(spark, list(enumerate(["a", *block, "75"])), "line_index int, text string")
    assert [r.text for r in lines.drop_export_blocks(whole).orderBy("line_index").collect()] == ["a", "75"]
    part = page(spark, list(enumerate(["a", *block[:2], *block[3:]])), "line_index int, text string")
    assert lines.drop_export_blocks(part).count() == 5


def test_heading_scores(spark):
    rows = [("Item 7A.", 6, 2), ("condition.", 0, 0), ("94-2404110", 0, 0)]
    df = page(spark, [(k, t, 9.0, 16) for k, (t, _, _) in enumerate(rows)] + [(9, "body text of the page", 9.0, 0)], "line_index int, text string, size double, flags int")
    got = {r.text: (r.score, r.level) for r in headings.detect(df).collect()}
    assert [got[t] for t, _, _ in rows] == [(s, lv) for _, s, lv in rows]
    df = page(spark, [(0, "iPhone", 9.0, 2), (1, "body text", 9.0, 0)], "line_index int, text string, size double, flags int")
    r = headings.detect(df).where("line_index = 0").first()
    assert (r.score, r.level) == (5, 4)


def test_bold_run(spark):
    long = " ".join(["word"] * 30)
    df = page(spark, [(0, long, 9.0, 16), (1, "local currencies.", 9.0, 16), (2, "Heading", 9.0, 16), (3, "plain", 9.0, 0)], "line_index int, text string, size double, flags int")
    got = {r.line_index: r for r in headings.detect(df).collect()}
    assert not got[1].is_heading and "continuation_of_bold_sentence" in got[1].reasons
    assert got[2].is_heading


def test_row_label(spark):
    rows = [(0, "iPhone", 72.0, [72.0], 100.0, 0.0), (1, "$137,781", 300.0, [300.0], 101.0, 1.0), (2, "1", 300.0, [300.0], 112.0, 1.0)]
    df = page(spark, rows, "line_index int, text string, x double, xs array<double>, y double, numeric_ratio double")
    assert tables.candidates(df).where("line_index = 0").first().promoted_as_row_label


def test_label_cascade(spark):
    words = "some words that make a label"
    rows = [(k, words, 72.0, [72.0], 100.0 + 12 * k, 0.0) for k in range(3)] + [(3, "1 2", 72.0, [72.0, 300.0], 136.0, 1.0)]
    df = page(spark, rows, "line_index int, text string, x double, xs array<double>, y double, numeric_ratio double")
    assert tables.candidates(df).where("cand4").count() == 4


COLS = [{"x": 300.0, "text": "2021"}, {"x": 360.0, "text": "2020"}, {"x": 420.0, "text": "2019"}]


def cells(*pairs):
    return [{"text": t, "x": float(x), "bold": False} for t, x in pairs]


def test_table_cells():
    r = tables.data_row(cells(("Net sales", 72), ("$", 290), ("163,220", 300)), COLS[:2], 20, 20)
    assert r["label"] == "Net sales" and r["values"][0]["val"] == "163,220"
    r = tables.data_row(cells(("x", 72), ("—", 300), ("—", 360), ("(136)", 420)), COLS, 20, 20)
    assert [v["val"] for v in r["values"]] == ["—", "—", "(136)"]
    r = tables.data_row(cells(("EPS", 72), ("1", 330), ("2", 390), ("3", 450)), COLS, 20, 20)
    assert [v["val"] for v in r["values"]] == ["1", "2", "3"]
    r = tables.data_row(cells(("EPS", 72), ("1", 270), ("2", 330), ("3", 390)), COLS, 20, 20)
    assert [v["val"] for v in r["values"]] == [None, None, None]


def test_merge_labels():
    row = lambda bold, *p: {"y": 0, "n": 1, "cells": [{"text": t, "x": float(x), "bold": bold} for t, x in p]}
    out = tables.merge_labels([row(True, ("REVENUE", 72)), row(False, ("Net sales", 72), ("163,220", 300))])
    assert len(out) == 2
    out = tables.merge_labels([row(True, ("EFFECT OF CASH", 72)), row(True, ("EQUIVALENTS", 72), ("70", 300))])
    assert tables.data_row(out[0]["cells"], COLS, 20, 20) == {"label": "EFFECT OF CASH EQUIVALENTS", "values": [{"col": "2021", "val": "70"}, {"col": "2020", "val": None}, {"col": "2019", "val": None}]}
    wrapped = [row(True, ("REVENUE", 72)), row(False, ("Net (gains)/losses", 72)), row(False, ("included in net income", 72), ("163,220", 300))]
    assert [" ".join(c["text"] for c in r["cells"]) for r in tables.merge_labels(wrapped)] == ["REVENUE", "Net (gains)/losses included in net income 163,220"]
    assert len(tables.merge_labels([row(False, ("Assets:", 72)), row(False, ("Cash", 72), ("1", 300)), row(False, ("end", 72))])) == 3


def test_text_header():
    row = lambda *p: {"cells": [{"text": t, "x": float(x), "bold": False} for t, x in p]}
    rows = [row(("Periods", 72), ("Total", 300), ("$", 330), ("Average", 380), ("(1)", 520), ("(unaudited)", 600)), row(("—", 200), ("Price", 385)), row(("a", 72), ("1", 340), ("2", 420))]
    first, cols = tables.text_header(rows, 14, 20)
    assert (first, [c["text"] for c in cols]) == (2, ["Total", "Average Price", "(unaudited)"])
    got = tables.data_row(cells(("a", 72), ("b", 270), ("N/A", 340), ("$", 400), ("2", 420)), cols, 45, 45)
    assert got["label"] == "a" and [v["val"] for v in got["values"]] == ["b", "N/A", "2"]  # a tie goes to the left cell


def test_report(spark):
    """Raw lines to chunks: a heading's paragraphs are packed, its page's table is text of its own."""
    from pagewright.operators import report

    flag = lambda b: 16 if b else 0
    def line(page, k, y, *spans, kind=0):
        cells_ = [{"text": t, "font": "F", "size": 9.0, "flags": flag(b), "bbox": [float(x), y, x + 20.0, y + 10], "origin": [0.0, 0.0]} for t, x, b in spans]
        return ("c", "f", page, page, 0, kind, k, [float(spans[0][1]), y, 500.0, y + 10], [1.0, 0.0], cells_)

    raw = [
        line(1, 0, 72.0, ("Item 7. Results", 72, True)),
        line(1, 1, 90.0, ("Sales rose because of the many new things that were sold.", 72, False)),
        line(1, 2, 101.0, ("More of the same paragraph, see https://x.org/a now.", 72, False)),
        line(1, 3, 120.0, ("an image", 72, False), kind=1),
        line(2, 0, 100.0, (" ", 10, False), ("2021", 300, True), ("2020", 380, True)),
        line(2, 1, 112.0, ("Net", 72, False)),
        line(2, 2, 124.0, ("sales", 72, False), ("$", 290, False), ("10", 300, False), ("20", 380, False)),
        line(2, 3, 136.0, ("Cost", 72, False), ("(5)", 300, False), ("—", 380, False)),
    ]
    schema = "company string, file_name string, page_index int, page_number int, block_index int, block_type int, line_in_block int, line_bbox array<double>, dir array<double>, spans array<struct<text:string,font:string,size:double,flags:int,bbox:array<double>,origin:array<double>>>"
    got = {r.chunk_type: r for r in report.to_chunks(spark.createDataFrame(raw, schema)).collect()}
    assert got["text"].text == "Sales rose because of the many new things that were sold. More of the same paragraph, see now." and got["text"].path == ["Item 7. Results"]
    assert got["table"].text == "Columns: 2021, 2020\nNet sales -- 2021: 10, 2020: 20\nCost -- 2021: (5), 2020: -" and got["table"].page_numbers == [2]
    cells_ = tables.with_cells(lines.flatten(spark.createDataFrame(raw, schema))).where("page_index = 2 and line_index = 2").first()
    assert (cells_.x, cells_.y, cells_.numeric, cells_.tokens) == (72.0, 124.0, 2, 4)


def test_boilerplate(spark):
    rows = [(p, f"Apple Inc. | 2021 Form 10-K | {p}") for p in range(16, 24)] + [(p, f"text {'abcdefgh'[p - 16]}") for p in range(16, 24)]
    df = spark.createDataFrame([("c", "f", *r, "paragraph", None) for r in rows], "company string, file_name string, page_index int, text string, block_type string, level int")
    assert paragraphs.drop_repeated(df).count() == 16
    assert paragraphs.fix(df).count() == 8


def test_section_stack(spark):
    rows = [("heading", lv, f"h{k}") for k, lv in enumerate((2, 3, 4, 3, 2))]
    df = spark.createDataFrame([("c", "f", 1, k, *r) for k, r in enumerate(rows)], "company string, file_name string, page_index int, ord long, block_type string, level int, text string")
    got = {r.section_id: r.parent_id for r in sections.tree(df).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 0, 4: None}


def greedy(parts, size=1200, overlap=150):
    """The packing told step by step."""
    out, cur, n = [], [], 0
    for t in parts:
        if n + len(t) > size and cur:
            out.append(" ".join(cur).strip())
            tail = out[-1][-overlap:]
            cur, n = [tail], len(tail)
        cur.append(t)
        n += len(t)
    if cur:
        out.append(" ".join(cur).strip())
    return [c for c in out if len(c) >= 15]


def test_chunks(spark):
    parts = [f"Sentence {k} " + "x" * (37 * k % 400) + "." for k in range(60)]
    df = spark.createDataFrame([("c", k, t, k // 7) for k, t in enumerate(parts)], "company string, ord int, text string, page_index int")
    got = [r.text for r in CH.text_chunks(df, ["company"]).orderBy("chunk_seq").collect()]
    assert got == greedy(parts)
    long = " ".join(f"Here is sentence number {k} of many." for k in range(100))
    got = one(spark, long, CH.pieces)
    assert " ".join(got) == long and all(len(p) <= 1240 for p in got)


def test_recursive_splitter():
    text = "\n\n".join(" ".join(f"word{k}{j}" for j in range(40)) for k in range(30))
    got = CH.split_recursive(text, 1200, 200)
    assert all(len(c) <= 1200 for c in got) and set(" ".join(got).split()) == set(text.split())
    assert CH.split_recursive("a" * 3000, 1200, 200)[0] == "a" * 1200


def test_sources(spark, tmp_path):
    from pagewright.sources import readers, writers
    from pagewright.streaming.ingest import ingest

    (tmp_path / "pdf/ACME").mkdir(parents=True)
    (tmp_path / "pdf/ACME/a.pdf").write_bytes(b"good")
    (tmp_path / "pdf/ACME/b.pdf").write_bytes(b"bad")

    def parser(raw):
        if raw == b"bad":
            raise ValueError("broken")
        return [{"page_index": 1, "page_number": 1, "width": 1.0, "height": 2.0, "block_index": 0, "block_type": 0, "line_in_block": 0, "line_bbox": [0.0] * 4, "dir": [1.0, 0.0], "spans": [{"text": " Hi ", "font": "F", "size": 9.0, "flags": 0, "bbox": [0.0] * 4, "origin": [0.0, 0.0]}]}]

    got, failed = readers.parsed(readers.files(spark, str(tmp_path / "pdf")), parser)
    flat = lines.flatten(got)
    assert [r.text for r in flat.collect()] == ["Hi"] and failed.first().file_name == "b.pdf"
    cleaned = lines.clean_lines(flat).withColumn("d", lines.dominant_span(F.col("spans")))
    assert cleaned.first().d.size == 9.0
    writers.stage(flat, str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 1
    writers.json(flat.select("company", "file_name", "page_index", "line_index", "text"), str(tmp_path / "landing"))
    q = ingest(spark, str(tmp_path / "landing"), "company string, file_name string, page_index int, line_index int, text string", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    (tmp_path / "txt/x").mkdir(parents=True)
    (tmp_path / "txt/x/chunk_012.txt").write_text("one\ntwo")
    r = readers.chunk_files(spark, str(tmp_path / "txt")).first()
    assert (r.folder, r.chunk_no, r.text) == ("x", 12, "one\ntwo")
