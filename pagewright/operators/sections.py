"""The section tree as rows with paths (W-04, J-04, A-11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.operators.lines import DOC

LEVELS = (1, 2, 3, 4)


def place(blocks: DataFrame) -> DataFrame:
    """Adds to blocks (ord: position in the report): section_id, parent_id, path, path_ids.

    A level's last heading is open if it is later than those of all lower levels, for which one
    window is enough; the deepest open one owns the block. Headings without a level count as 2;
    those of level 0 are paragraphs. Blocks before the first heading belong to none."""
    w = Window.partitionBy(*DOC).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when((F.col("block_type") == "heading") & (F.coalesce("level", F.lit(2)) > 0), F.coalesce("level", F.lit(2)))
    x = blocks.withColumn("_level", level)
    last = {f"_h{k}": F.last(F.when(F.col("_level") == k, F.struct("ord", "text")), ignorenulls=True).over(w) for k in LEVELS}
    x = x.withColumns(last)

    def at(k: int) -> Column:
        return F.coalesce(F.col(f"_h{k}.ord"), F.lit(-1).cast("long"))

    open_ = []
    for k in LEVELS:
        lower = reduce(F.greatest, [at(j) for j in LEVELS if j < k], F.lit(-1).cast("long")) if k > 1 else F.lit(-1).cast("long")
        open_.append(F.when(at(k) > lower, F.col(f"_h{k}")))
    path = F.array_compact(F.array(*open_))
    x = x.withColumn("_path", path)
    x = x.withColumns({"path": F.transform("_path", lambda p: p["text"]), "path_ids": F.transform("_path", lambda p: p["ord"])})
    return x.withColumns({"section_id": F.get("path_ids", F.size("path_ids") - 1), "parent_id": F.get("path_ids", F.size("path_ids") - 2)}).drop("_path", *last)


def tree(blocks: DataFrame) -> DataFrame:
    """(doc, section_id, parent_id, level, title, path, page_start, page_end, paragraphs): a row a
    section; page_end is the last page of what the section itself holds."""
    x = place(blocks).where("section_id is not null")
    own = F.when(F.col("section_id") == F.col("ord"), F.struct("parent_id", F.col("_level").alias("level"), F.col("text").alias("title"), "path", F.col("page_index").alias("page_start")))
    held = x.groupBy(*DOC, "section_id").agg(F.first(own, ignorenulls=True).alias("_own"), F.max("page_index").alias("page_end"), F.count_if(F.col("_level").isNull()).alias("paragraphs"))
    return held.select(*DOC, "section_id", "_own.*", "page_end", "paragraphs")


def tables_to_sections(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """J-04: each table with the section that is open when its page begins (none: dropped). An
    as-of join by one sort: tables and blocks in one sequence, tables first on their page."""
    s = place(blocks).select(*DOC, "page_index", F.col("ord").alias("o"), "section_id", F.lit(1).alias("late"), F.lit(None).cast("int").alias("table_index"))
    t = tables.select(*DOC, "page_index", F.lit(-1).cast("long").alias("o"), F.lit(None).cast("long").alias("section_id"), F.lit(0).alias("late"), "table_index")
    w = Window.partitionBy(*DOC).orderBy("page_index", "late", "o").rowsBetween(Window.unboundedPreceding, -1)
    seen = s.unionByName(t).withColumn("owner", F.last("section_id", ignorenulls=True).over(w))
    return seen.where("late = 0 and owner is not null").select(*DOC, "page_index", "table_index", F.col("owner").alias("section_id"))


def counts(sections: DataFrame) -> DataFrame:
    """A-11: sections and paragraphs of each report, company, and all."""
    return sections.rollup(*DOC).agg(F.count(F.lit(1)).alias("sections"), F.sum("paragraphs").alias("paragraphs"))
