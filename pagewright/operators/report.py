"""Whole reports: page lines to headings, tables, sections and chunks (J-01..J-03, P-30, ST-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config
from pagewright.operators import chunks, headings, lines, paragraphs, sections, tables
from pagewright.operators.lines import DOC, PAGE


def analyse(raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Cleaned lines of raw ones (see lines.flatten) with all that is found of them in one wide row:
    cells, table candidacy, heading and level. Nothing has to be joined by page and line again."""
    x = lines.clean_lines(lines.drop_export_blocks(lines.flatten(raw)))
    x = tables.candidates(tables.with_cells(x), config)
    top = lines.dominant_span(F.col("spans"))
    x = x.withColumns({"size": F.coalesce(top["size"], F.lit(0.0)), "flags": F.coalesce(top["flags"], F.lit(0)), "is_table": F.col("cand4")})
    corner = {c: F.when(F.size("bbox") >= 4, F.get("bbox", F.lit(k))) for k, c in enumerate(("x0", "y0", "x1", "y1"))}
    return headings.detect(x.withColumns(corner), config)


def table_rows(analysed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The tables of the candidate lines."""
    return tables.parse(analysed.where("is_table"), config)


def blocks(analysed: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Headings and paragraphs without repeated boilerplate, with ord, their place in the report."""
    b = paragraphs.fix(paragraphs.assemble(analysed, config), config)
    return b.withColumn("ord", F.col("page_index").cast("long") * (1 << 24) + F.col("block_index"))


def to_chunks(raw: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(company, file_name, section_id, path, chunk_type, chunk_seq, text, page_numbers): what is
    searched. A section's paragraphs are packed; a table is a chunk of the section that is open
    when its page begins, dropped if none is or if too few rows have figures."""
    x = analyse(raw, config)
    b = blocks(x, config)
    placed = sections.place(b)
    key = [*DOC, "section_id"]
    texts = chunks.text_chunks(placed.where("section_id is not null and block_type = 'paragraph'"), key, config)
    t = table_rows(x, config)
    t = t.where(tables.real_table(F.col("rows"), config.real_table))
    owner = sections.tables_to_sections(t, b)
    t = chunks.table_chunks(t).join(owner, [*PAGE, "table_index"])
    t = t.select(*key, F.struct("page_index", "table_index").alias("chunk_at"), "chunk_type", "text", "page_numbers")
    t = t.select(*key, F.expr("chunk_at.page_index * 1000 + chunk_at.table_index").cast("int").alias("chunk_seq"), "chunk_type", "text", "page_numbers")
    paths = placed.where("section_id = ord").select(*key, "path")
    return texts.select(*key, "chunk_seq", "chunk_type", "text", "page_numbers").unionByName(t).join(paths, key).select(*key, "path", "chunk_type", "chunk_seq", "text", "page_numbers")
