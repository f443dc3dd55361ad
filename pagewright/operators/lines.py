"""Pages to cleaned lines. Line numbers are given before anything is emptied and never shift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import predicates as P
from pagewright.functions.clean import V2, clean, strip

DOC = ["company", "file_name"]
PAGE = [*DOC, "page_index"]


def by_page() -> object:
    return Window.partitionBy(*PAGE).orderBy("line_index")


def flatten(raw: DataFrame) -> DataFrame:
    """PR-02: lines of text blocks (type 0): span texts stripped, blank spans dropped, joined by a
    space; lines without any go; the rest are numbered in the order of the page. raw: one row a
    line with block_index, block_type, line_in_block, spans, line_bbox, dir."""
    spans = F.filter(F.transform("spans", lambda s: s.withField("text", strip(s["text"]))), lambda s: s["text"] != "")
    lines = raw.where("block_type = 0").withColumn("spans", spans).where(F.size("spans") > 0)
    order = Window.partitionBy(*PAGE).orderBy("block_index", "line_in_block")
    return lines.withColumns(
        {"text": F.array_join(F.transform("spans", lambda s: s["text"]), " "), "line_index": F.row_number().over(order) - 1, "bbox": F.col("line_bbox"), "direction": F.col("dir")}
    ).select(*PAGE, "page_number", "line_index", "text", "bbox", "direction", "spans")


def export_block_start(text: Column, following: list[Column]) -> Column:
    """Whether the five lines from here on are a browser's printed footer."""
    a, b, c, d = following
    return F.coalesce(P.is_byline(text) & P.is_timestamp(a) & P.is_document_word(b) & P.has_url(c) & P.is_fraction(d), F.lit(False))


def drop_export_blocks(lines: DataFrame) -> DataFrame:
    """W-13: without printed footers of five lines; lines are numbered anew. Two starts can't lie
    within five lines of each other, so a window of flags does what a greedy scan would."""
    w = by_page()
    start = export_block_start(F.col("text"), [F.lead("text", k).over(w) for k in range(1, 5)])
    flagged = lines.withColumn("_start", start)
    hit = F.max(F.col("_start").cast("int")).over(w.rowsBetween(-4, 0)) == 1
    kept = flagged.withColumn("_hit", hit).where("not _hit").drop("_start", "_hit")
    return kept.withColumn("line_index", F.row_number().over(w) - 1)


def clean_lines(lines: DataFrame) -> DataFrame:
    """PR-03: the text of lines and of their spans, cleaned on their own; none are dropped."""
    out = lines.withColumn("text", clean(F.col("text"), V2))
    if "spans" in lines.columns:
        out = out.withColumn("spans", F.transform("spans", lambda s: s.withField("text", clean(s["text"], V2))))
    return out


def dominant_span(spans: Column) -> Column:
    """The span with the longest stripped text, the first of such."""
    numbered = F.transform(spans, lambda s, i: F.struct((-F.length(strip(s["text"]))).alias("n"), i.alias("i"), s.alias("s")))
    return F.get(F.array_sort(F.transform(numbered, lambda x: F.struct(x["n"].alias("n"), x["i"].alias("i"), x["s"]["size"].alias("size"), x["s"]["flags"].alias("flags")))), F.lit(0))
