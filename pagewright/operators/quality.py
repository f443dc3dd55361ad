"""Metadata and checks (W-03, W-05, A-12, P-21, P-27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.predicates import section


def fill_sections(chunks: DataFrame) -> DataFrame:
    """W-05: a chunk without a section of its own has that of the last one before it that has."""
    w = Window.partitionBy("company", "report").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, 0)
    own = section(F.col("text"))
    known = F.last(F.when(own != "Unknown", own), ignorenulls=True).over(w)
    return chunks.withColumn("section", F.coalesce(known, F.lit("Unknown")))


def page_sequence(pages: DataFrame) -> DataFrame:
    """W-03: per report, pages without a printed number and pages whose number doesn't rise."""
    w = Window.partitionBy("company", "file_name").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    x = pages.withColumn("_last", F.last("printed", ignorenulls=True).over(w))
    return x.groupBy("company", "file_name").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("printed").isNull()).alias("missing"), F.count_if(F.col("printed") <= F.col("_last")).alias("anomalies"))


def totals(chunks: DataFrame) -> DataFrame:
    """A-12: chunks and characters by company and type, each alone, and in all."""
    return chunks.cube("company", "chunk_type").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


def probe(text: Column, *needles: str, ignore_case: bool = False) -> Column:
    """P-27: whether a text has all of some strings."""
    t = F.lower(text) if ignore_case else text
    out = F.lit(True)
    for n in needles:
        out = out & F.contains(t, F.lit(n.lower() if ignore_case else n))
    return out


def preview(text: Column, n: int = 500) -> Column:
    """PR-11."""
    return F.translate(F.substring(text, 1, n), "\n", " ")
