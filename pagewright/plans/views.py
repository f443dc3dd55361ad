"""Views over the driver's tables that look like reports: in Spark, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PREFIXES = {
    0: "see https://www.example.org/a/b?c=1 now",
    1: "5/16/26, 9:56 AM",
    2: "aapl-20160924 x a10-k2016.htm y",
    3: "☐ yes ☒ no ✓",
    4: "“A” – ‘b’ … •",
    5: "a   b\tc  \t d",
    6: "page 25/84 and dates 6/6/14",
    7: "Table of Contents",
}
QUESTIONS = [
    (1, "What was src3 revenue in 2019?"),
    (2, "latest sales of src7"),
    (3, "most recent results"),
    (4, "src10 risk"),
    (5, "Who is the CEO of Microsoft?"),
    (6, "metal prices"),
    (7, "src5 in 1999"),
    (8, "unrelated"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Neighbouring ids that are numbered together.
_BLOCK = 512


def _numbered(d: DataFrame) -> DataFrame:
    """Adds _page, the row's number in its source by doc_id. A source may hold a large share of all
    rows: rows are numbered within blocks of ids, whose beginnings come from counts."""
    block = F.struct("source", F.coalesce(F.expr(f"doc_id div {_BLOCK}"), F.lit(-(2**62))).alias("n")).alias("_b")
    counts = d.select(block).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_b.source").orderBy("_b.n").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return d.withColumn("_b", block).join(counts, "_b").withColumn("_page", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("doc_id")))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (F.lit(2018) + F.expr("doc_id div 20") % 5).cast("int")
    d = _numbered(table(spark, sf_dir, "documents"))
    page = F.col("_page").cast("int")
    return d.select("doc_id", "text", F.col("source").alias("company"), F.concat("source", F.lit("_"), year.cast("string"), F.lit("_10K")).alias("file_name"), year.alias("year"), page.alias("page_index"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = docs(spark, sf_dir).select("doc_id", "company", "file_name", "page_index", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "text"))
    n, k = F.length("text"), F.col("line_index")
    y = F.lit(72) + 14 * k + 20 * F.expr("line_index div 4")
    return x.withColumns(
        {
            "x0": (F.lit(72) + F.when(n % 5 == 0, 30).otherwise(0)).cast("double"),
            "x1": F.lit(540.0),
            "y0": y.cast("double"),
            "y1": (y + 10).cast("double"),
            "size": F.when(n % 11 == 0, 14.0).when(n % 13 == 0, 8.0).otherwise(9.0),
            "flags": F.when(n % 7 == 0, 16).when(n % 5 == 0, 2).otherwise(0),
        }
    )


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.coalesce(*[F.when(F.col("doc_id") % 8 == k, F.lit(v)) for k, v in PREFIXES.items()])
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(p, F.lit(" "), "text").alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    d = docs(spark, sf_dir)
    return d.join(e, d["doc_id"] == e["vec_id"]).select(F.col("doc_id").alias("chunk_id"), "company", "year", "file_name", "text", "embedding")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as chunks without vectors, for what needs none."""
    return docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "company", "year", "file_name", "text")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as an extractor gives them: one text block a page, one span a line."""
    x = lines(spark, sf_dir)
    box = F.array("x0", "y0", "x1", "y1")
    span = F.struct("text", F.lit("F").alias("font"), "size", "flags", box.alias("bbox"), F.array("x0", "y1").alias("origin"))
    return x.select("company", "file_name", "page_index", F.col("page_index").alias("page_number"), F.lit(0).alias("block_index"), F.lit(0).alias("block_type"), F.col("line_index").alias("line_in_block"), box.alias("line_bbox"), F.array(F.lit(1.0), F.lit(0.0)).alias("dir"), F.array(span).alias("spans"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as questions with vectors."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, b["item_id"] == e["vec_id"]).select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), F.col("embedding").alias("q"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routed questions, each with the vector of its number."""
    q = spark.createDataFrame(QUESTIONS, "query_id long, question string")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return q.join(e, "query_id")


def with_boilerplate(x: DataFrame) -> DataFrame:
    """Paragraph blocks, one a line, and two repeated ones a page."""
    pages = x.select("company", "file_name", "page_index").distinct()
    own = x.select("company", "file_name", "page_index", "text", F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("level"))
    foot = pages.select("*", F.concat("company", F.lit(" Inc. | 2016 Form 10-K | "), F.col("page_index").cast("string")).alias("text"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("level"))
    same = pages.where("page_index % 3 <> 0").select("*", F.lit("Confidential draft").alias("text"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("level"))
    return own.unionByName(foot).unionByName(same)


def _sql_prefix() -> str:
    return "CASE doc_id % 8 " + " ".join("WHEN {} THEN {}".format(k, "'" + v.replace("'", "''").replace("\t", "' || chr(9) || '") + "'") for k, v in PREFIXES.items()) + " END"


SQL = {
    "v_docs": """SELECT doc_id, text, source AS company, concat(source, '_', 2018 + (doc_id // 20) % 5, '_10K') AS file_name,
        CAST(2018 + (doc_id // 20) % 5 AS INTEGER) AS year, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_index FROM documents""",
    "v_lines": """SELECT *, CAST(72 + CASE WHEN length(text) % 5 = 0 THEN 30 ELSE 0 END AS DOUBLE) AS x0, 540.0::DOUBLE AS x1,
        CAST(72 + 14 * line_index + 20 * (line_index // 4) AS DOUBLE) AS y0, CAST(82 + 14 * line_index + 20 * (line_index // 4) AS DOUBLE) AS y1,
        CASE WHEN length(text) % 11 = 0 THEN 14.0 WHEN length(text) % 13 = 0 THEN 8.0 ELSE 9.0 END::DOUBLE AS size,
        CASE WHEN length(text) % 7 = 0 THEN 16 WHEN length(text) % 5 = 0 THEN 2 ELSE 0 END AS flags
        FROM (SELECT doc_id, company, file_name, page_index, CAST(unnest(range(len(l))) AS INTEGER) AS line_index, unnest(l) AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM v_docs))""",
    "v_noisy": f"SELECT doc_id, concat({_sql_prefix()}, ' ', text) AS text FROM documents",
    "v_chunks": "SELECT doc_id AS chunk_id, company, year, file_name, text, embedding::DOUBLE[] AS embedding FROM v_docs JOIN embeddings ON vec_id = doc_id",
    "v_texts": "SELECT doc_id AS chunk_id, company, year, file_name, text FROM v_docs",
    "v_items": "SELECT item_id AS query_id, text AS question, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id",
    "v_questions": "SELECT v.query_id, v.question, embedding::DOUBLE[] AS q FROM (VALUES "
    + ", ".join(f"({k}, '{t}')" for k, t in QUESTIONS)
    + ") v(query_id, question) JOIN embeddings ON vec_id = v.query_id",
    "v_boiler": """SELECT company, file_name, page_index, text FROM v_lines
        UNION ALL SELECT DISTINCT company, file_name, page_index, concat(company, ' Inc. | 2016 Form 10-K | ', page_index) FROM v_docs
        UNION ALL SELECT DISTINCT company, file_name, page_index, 'Confidential draft' FROM v_docs WHERE page_index % 3 <> 0""",
}


def oracle(body: str, *more: tuple[str, str]) -> str:
    """SQL with the views that it names in front, and further named queries."""
    every = {**SQL, **dict(more)}
    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for k, v in every.items():
            if k in text and k not in need:
                need.add(k)
                todo.append(v)
    used = [f"{k} AS ({v})" for k, v in every.items() if k in need]
    return ("WITH " + ",\n".join(used) + "\n" if used else "") + body
