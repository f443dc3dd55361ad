"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import idfiles, linededup, mixing, nearjoin, packing, ppm, secrets, topk, warc, webp

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.classes(_table(spark, sf_dir, "documents")).drop("key")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.encode_and_read(_table(spark, sf_dir, "documents"), TOKENIZER)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(_table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.round_trip(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # it imports this subpackage itself

    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": corpus_pipeline.run}


def _quantised(alias: str) -> str:
    return f"list_transform({alias}, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT))"


OP6_SQL = f"""
WITH v AS (
  SELECT vec_id, {_quantised("embedding")} AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM d),
r AS (SELECT *, n >= 1000 AND page_id <> keeper AS again FROM k)
SELECT r.page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN keeper END AS refers_to, pages.url
FROM r JOIN pages ON pages.page_id = r.page_id
"""


def _secrets_sql() -> str:
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, m, g, w, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(x, '{pattern}') AS m, regexp_extract_all(x, '{pattern}', {rule.group}) AS g,
           string_split_regex(x, '{pattern}') AS w, {rule.least} AS least FROM t)""")
    base = len(secrets.BASE)
    spans = "coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank), '')"
    least = "CASE rank " + " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(secrets.RULES)) + " END"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, CAST(a + length(m[i]) AS BIGINT) AS z FROM (
    SELECT *, coalesce(list_sum(list_transform(w[1:i], lambda e: length(e))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda e: length(e))), 0) AS a FROM hits)
  WHERE length(g[i]) >= {least})
SELECT t.doc_id, {counts}, sha256({spans.replace("string_agg(", "string_agg(").replace("rank), '')", f"rank) FILTER (WHERE rank < {base}), '')")}) AS base_sha256,
       {spans.replace("rank), '')", "rank) FILTER (WHERE kind IS NOT NULL), '')")} AS spans
FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express; the other queries are tested against brute force."""
    return {"op6_topk": OP6_SQL, "op7_warc": OP7_SQL, "op9_secrets": _secrets_sql()}
