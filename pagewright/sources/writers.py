"""Sinks (SNK-*): stage tables, readable dumps, chunk files, query logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.lines import DOC, PAGE


def stage(df: DataFrame, path: str) -> None:
    """SNK-01, SNK-05, SNK-06: a stage's table, a folder a company."""
    df.write.mode("overwrite").partitionBy("company").parquet(path)


def json(df: DataFrame, path: str) -> None:
    """SNK-01, SNK-07: JSON lines, non-ASCII characters kept, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def readable(lines: DataFrame) -> DataFrame:
    """SNK-02, SNK-03: (doc, text): pages under banners, blank lines left out."""
    kept = lines.where(F.trim("text") != "").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line_index", "text"))).alias("l"))
    bar = "=" * 70
    page = F.concat(F.lit(f"{bar}\nPAGE "), F.col("page_index").cast("string"), F.lit(f"\n{bar}\n"), F.array_join(F.transform("l", lambda x: x["text"]), "\n"))
    pages = kept.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("page_index", page.alias("t")))).alias("p"))
    return pages.select(*DOC, F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def text(df: DataFrame, path: str) -> None:
    """SNK-04: one text a row, a folder a company."""
    df.select("company", "text").write.mode("overwrite").partitionBy("company").text(path)
