"""Lines to blocks of headings and paragraphs; repeated boilerplate (W-06, A-03..A-06, P-10, P-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config
from pagewright.functions.clean import repeat_key, strip
from pagewright.functions.predicates import is_fraction, is_fragment
from pagewright.operators.lines import DOC, PAGE, by_page


def is_break(top: Column, left: Column, prev_bottom: Column, prev_left: Column, config: Config = DEFAULT) -> Column:
    """P-15: a wide gap or another indent; unknown places don't break."""
    gap = (top - prev_bottom > config.paragraph_gap) | (F.abs(left - prev_left) > config.paragraph_indent)
    return F.coalesce(gap, F.lit(False))


def assemble(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """W-06, A-05, A-06: blocks of a page from lines with text, x0, y0, x1, y1, is_heading, level
    and is_table. Blank lines are passed over; table lines part paragraphs and aren't part of any;
    a heading is a block of its own."""
    w = by_page()
    x = lines.where(strip(F.col("text")) != "")
    kind = F.when(F.col("is_table"), "table").when(F.col("is_heading"), "heading").otherwise("paragraph")
    x = x.withColumn("_kind", kind)
    fresh = (F.col("_kind") != "paragraph") | ~F.lag("_kind").over(w).eqNullSafe(F.lit("paragraph"))
    fresh = fresh | is_break(F.col("y0"), F.col("x0"), F.lag("y1").over(w), F.lag("x0").over(w), config)
    x = x.withColumn("_fresh", fresh.cast("int"))
    x = x.withColumn("_group", F.sum("_fresh").over(w)).where("_kind <> 'table'")
    parts = F.array_sort(F.collect_list(F.struct("line_index", strip(F.col("text")).alias("t"))))
    b = x.groupBy(*PAGE, "_group", F.col("_kind").alias("block_type")).agg(
        F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"),
        F.max("level").alias("level"),
        *[F.min(c).alias(c) for c in ("x0", "y0")],
        *[F.max(c).alias(c) for c in ("x1", "y1")],
        F.count(F.lit(1)).cast("int").alias("line_count"),
    )
    order = Window.partitionBy(*PAGE).orderBy("_group")
    return b.withColumns({"block_index": F.row_number().over(order) - 1, "level": F.when(F.col("block_type") == "heading", F.col("level"))}).drop("_group")


def repeated(blocks: DataFrame, key: Column, config: Config = DEFAULT) -> DataFrame:
    """(doc, key): paragraph texts on at least max(5, 0.3 of the pages) pages of a report."""
    mark = F.when(F.col("block_type") == "paragraph", key).alias("_key")
    each = blocks.select(*DOC, "page_index", mark).distinct()  # one pass over the blocks for both
    pages = each.groupBy(*DOC).agg(F.count_distinct("page_index").alias("pages"))
    on = each.where("_key is not null").groupBy(*DOC, "_key").agg(F.count("page_index").alias("n"))
    least = F.greatest(F.lit(float(config.boilerplate_pages)), F.col("pages") * config.boilerplate_share)
    return on.join(pages, DOC).where(F.col("n") >= least).select(*DOC, "_key")


def _without(blocks: DataFrame, key: Column, config: Config) -> DataFrame:
    """Keyed on text and report, the join spreads even one report's paragraphs."""
    mark = F.when(F.col("block_type") == "paragraph", key)
    return blocks.withColumn("_key", mark).join(repeated(blocks, key, config), [*DOC, "_key"], "left_anti").select(*blocks.columns)


def drop_repeated(blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A-03: by exact text."""
    return _without(blocks, strip(F.col("text")), config)


def fix(blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A-04, P-10: repeats but for a trailing number go, and page fractions; then headings that
    read like the end of a sentence become paragraphs, too late to count as repeats."""
    kept = _without(blocks, repeat_key(strip(F.col("text"))), config)
    kept = kept.where(~((F.col("block_type") == "paragraph") & is_fraction(F.col("text"))))
    down = (F.col("block_type") == "heading") & is_fragment(F.col("text"))
    return kept.withColumns({"block_type": F.when(down, "paragraph").otherwise(F.col("block_type")), "level": F.when(~down, F.col("level"))})


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """A-13: blocks and headings of each report before and after."""

    def count(b: DataFrame, tag: str) -> DataFrame:
        return b.groupBy(*DOC).agg(F.count(F.lit(1)).alias(f"blocks_{tag}"), F.count_if(F.col("block_type") == "heading").alias(f"headings_{tag}"))

    return count(before, "before").join(count(after, "after"), DOC, "left").na.fill(0)
