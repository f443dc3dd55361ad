"""Chunks: greedy packing with an overlap, the recursive splitter, table chunks (C-23, ST-05, ST-06)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagewright.config import DEFAULT, Config
from pagewright.functions.clean import sentences, strip
from pagewright.operators.tables import table_text

#: Where to cut, the best place first.
MARKS = tuple("\n\n|\n|. | |".split("|"))
_STATE = "struct<cur:string,out:array<string>>"


def pieces(text: Column, most: int = DEFAULT.chunk) -> Column:
    """A text as it is, if short; else its sentences joined up to about `most` characters. A single
    longer sentence is never cut."""

    def step(s: Column, x: Column) -> Column:
        full = (F.length(s["cur"]) + F.length(x) > most) & (s["cur"] != "")
        cur = F.when(full, x).otherwise(strip(F.concat(s["cur"], F.lit(" "), x)))
        return F.struct(cur.alias("cur"), F.when(full, F.array_append(s["out"], s["cur"])).otherwise(s["out"]).alias("out"))

    zero = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out")).cast(_STATE)
    done = F.aggregate(sentences(text), zero, step, lambda s: F.when(s["cur"] != "", F.array_append(s["out"], s["cur"])).otherwise(s["out"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(done)


def pack(parts: Iterator[tuple[str, int | None]], config: Config = DEFAULT) -> Iterator[tuple[str, list[int]]]:
    """ST-05: (text, pages) chunks of ordered (text, page) pieces. When a piece would exceed the
    size, what is held is given out and its last characters stay in front of the piece; the
    length that counts leaves out the spaces between pieces. Holds one chunk at a time."""
    held: list[str] = []
    size = 0
    pages: set[int] = set()
    for text, page in parts:
        if held and size + len(text) > config.chunk:
            chunk = " ".join(held).strip()
            if len(chunk) >= config.least_chunk:
                yield chunk, sorted(pages)
            tail = chunk[-config.overlap :] if config.overlap else ""
            held, size, pages = [tail], len(tail), set()
        held.append(text)
        size += len(text)
        if page is not None:
            pages.add(page)
    if held and len(chunk := " ".join(held).strip()) >= config.least_chunk:
        yield chunk, sorted(pages)


#: Rows of one slice that is read or leaves a Python worker.
_OUT = 1000
#: Texts of one slice that is read.
_TEXTS = 64


def text_chunks(paragraphs: DataFrame, group: list[str], config: Config = DEFAULT) -> DataFrame:
    """Chunks of the paragraphs (ord, text, page_index) of each group, a section. A group's pieces
    come in order in one task and are never gathered, so a group may be as large as it likes."""
    p = paragraphs.where(strip(F.col("text")) != "").withColumn("_pieces", pieces(F.col("text"), config.chunk))
    p = p.select(*group, "ord", F.col("page_index").cast("int").alias("page"), F.posexplode("_pieces").alias("k", "text"))
    p = p.repartition(*group).sortWithinPartitions(*group, "ord", "k", "text", "page").select(*group, "text", "page")
    kinds = [p.schema[c] for c in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for k in range(0, b.num_rows, _OUT):
                    yield from zip(*(c.to_pylist() for c in b.slice(k, _OUT).columns))

        def chunks() -> Iterator[tuple]:
            for key, own in groupby(rows(), lambda r: r[:-2]):
                for k, (text, pages) in enumerate(pack(((r[-2], r[-1]) for r in own), config)):
                    yield *key, k, text, pages

        kind = to_arrow_schema(target)
        every = chunks()
        while some := list(islice(every, _OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], schema=kind)

    target = StructType([*kinds, StructField("chunk_seq", IntegerType()), StructField("text", StringType()), StructField("page_numbers", ArrayType(IntegerType()))])
    out = p.mapInArrow(run, target)
    return out.select(*group, "chunk_seq", F.lit("text").alias("chunk_type"), "text", "page_numbers")


def table_chunks(tables: DataFrame) -> DataFrame:
    """PR-08."""
    return tables.withColumns({"chunk_type": F.lit("table"), "text": table_text(F.col("header"), F.col("rows")), "page_numbers": F.array("page_index")})


def split_recursive(text: str, size: int, overlap: int, marks: tuple[str, ...] = MARKS) -> list[str]:
    """ST-06: cut at the first mark that occurs; parts that are still too long are cut at the next
    ones; neighbours are joined up to `size`, repeating up to `overlap` characters. A mark stays
    at the start of what follows it."""
    mark = next((m for m in marks if m == "" or m in text), "")
    later = marks[marks.index(mark) + 1 :]
    if mark:
        first, *rest = text.split(mark)
        parts = [p for p in [first, *(mark + r for r in rest)] if p]
    else:
        parts = list(text)
    out: list[str] = []
    good: list[str] = []

    def join() -> None:
        held: list[str] = []
        total = 0
        for p in good:
            if held and total + len(p) > size:
                out.append("".join(held).strip())
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        if held:
            out.append("".join(held).strip())
        good.clear()

    for p in parts:
        if len(p) < size:
            good.append(p)
        else:
            join()
            out += split_recursive(p, size, overlap, later) if later else [p]
    join()
    return [x for x in out if x]


def recursive_chunks(docs: DataFrame, keys: list[str], text_col: str = "text", config: Config = DEFAULT) -> DataFrame:
    """(keys, chunk_no from 1, chunk_name, text). A worker holds the chunks of one text and a slice
    of rows, however many rows a batch has."""
    target = StructType([*(docs.schema[k] for k in keys), StructField("chunk_no", IntegerType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = to_arrow_schema(target)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for k in range(0, b.num_rows, _TEXTS):
                    for *key, text in zip(*(c.to_pylist() for c in b.slice(k, _TEXTS).columns)):
                        for n, x in enumerate(split_recursive(text or "", config.chunk, config.v1_overlap), 1):
                            yield *key, n, x

        every = rows()
        while some := list(islice(every, _OUT)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), kind)], schema=kind)

    out = docs.select(*keys, text_col).mapInArrow(run, target)
    return out.select(*keys, "chunk_no", F.format_string("chunk_%03d", F.col("chunk_no")).alias("chunk_name"), "text")
