"""Sources (SRC-*): directories of PDFs, JSON stages, text reports, chunk files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = (
    "company string, file_name string, page_index int, page_number int, width double, height double, block_index int, block_type int, line_in_block int, "
    "line_bbox array<double>, dir array<double>, spans array<struct<text:string,font:string,size:double,flags:int,bbox:array<double>,origin:array<double>>>"
)


def path_part(path: Column, back: int) -> Column:
    """A part of a path, counted from its end: 1 is the file."""
    return F.element_at(F.split(path, "/"), -back)


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, company, file_name, content) of one folder a company."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return f.select("path", path_part(F.col("path"), 2).alias("company"), path_part(F.col("path"), 1).alias("file_name"), "content")


def parsed(files: DataFrame, parser: Callable[[bytes], list[dict]]) -> tuple[DataFrame, DataFrame]:
    """SRC-02: (lines, failed) of files; `parser` gives a file's lines as dicts of RAW's fields after
    file_name. A file that it can't read is in `failed`, whole, with the reason."""
    schema = "company string, file_name string, error string, lines array<struct<" + ",".join(
        f"{n}:{t}" for n, t in (x.split(" ", 1) for x in RAW.split(", ")[2:])
    ) + ">>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c, n, b in zip(f.company, f.file_name, f.content):
                try:
                    rows.append((c, n, None, parser(b)))
                except Exception as e:  # noqa: BLE001 - whatever a parser may raise is that file's failure
                    rows.append((c, n, str(e) or type(e).__name__, []))
            yield pd.DataFrame(rows, columns=["company", "file_name", "error", "lines"])

    all_ = files.select("company", "file_name", "content").mapInPandas(run, schema)
    lines = all_.where("error is null").select("company", "file_name", F.explode("lines").alias("l")).select("company", "file_name", "l.*")
    return lines, all_.where("error is not null").select("company", "file_name", "error")


def only(files: DataFrame, wanted: DataFrame, companies: list[str]) -> DataFrame:
    """SRC-04, J-12: listed (company, file_name) pairs and all files of some companies."""
    return files.join(wanted, ["company", "file_name"], "left_semi").unionByName(files.where(F.col("company").isin(companies))).distinct()


def json_reports(spark: SparkSession, folder: str, schema: str, suffix: str = ".json") -> DataFrame:
    """SRC-05..07: JSON reports of one folder a company, with company and stem."""
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    path = F.col("_metadata.file_path")
    return df.withColumns({"company": path_part(path, 2), "stem": F.replace(path_part(path, 1), F.lit(suffix), F.lit(""))})


def text_reports(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-09, SRC-10: whole text files with their folder and name."""
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    path = F.col("_metadata.file_path")
    return df.select(path_part(path, 2).alias("folder"), path_part(path, 1).alias("file_name"), F.col("value").alias("text"))


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-11: chunk files with their number, which is what orders them."""
    t = text_reports(spark, folder)
    return t.withColumn("chunk_no", F.regexp_extract("file_name", r"(\d+)", 1).cast("int"))
