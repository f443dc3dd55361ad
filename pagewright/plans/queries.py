"""The registered queries of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.config import RECENCY, SECTIONS, UNKNOWN, V1_COMPANIES
from pagewright.functions import clean as C
from pagewright.functions import predicates as P
from pagewright.operators import chunks as CH
from pagewright.operators import embed, headings, lines, paragraphs, quality, sections, tables
from pagewright.operators import retrieval as R
from pagewright.plans import views as V
from pagewright.plans.views import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *more: tuple[str, str]) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = oracle(sql, *more)
        return f

    return add


# ---- dense search ----
_IP = "list_sum(list_transform(list_zip(embedding, q), lambda p: p[1] * p[2]))"
_L2 = "list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1] - p[2]) ** 2))"


def _top(score: str, k: int, source: str = "v_chunks, v_items", order: str = "DESC", where: str = "TRUE") -> str:
    return f"""SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, chunk_id) AS rank FROM (
        SELECT query_id, chunk_id, {score} AS score FROM {source} WHERE {where})) WHERE rank <= {k}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("dense_topk_ip", _top(_IP, 5))
def _(s, d):
    return _rounded(R.dense(V.chunks(s, d), V.items(s, d), 5))


@query("dense_topk_l2", _top(_L2, 5, order="ASC"))
def _(s, d):
    return _rounded(R.dense(V.chunks(s, d), V.items(s, d), 5, l2=True))


@query("dense_topk_filtered", _top(_IP, 5, where="company = 'src3' AND year = 2019"))
def _(s, d):
    return _rounded(R.dense(R.metadata_filter(V.chunks(s, d), "SRC3", 2019), V.items(s, d), 5))


@query(
    "dense_postfilter_pool100",
    "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s, chunk_id) AS rank, chunk_id, round(s, 6) AS score FROM pool JOIN v_chunks USING (chunk_id) WHERE company = 'src3' QUALIFY rank <= 10",
    ("pool", f"SELECT *, score AS s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS r FROM (SELECT query_id, chunk_id, {_L2} AS score FROM v_chunks, v_items)) WHERE r <= 100"),
)
def _(s, d):
    c = V.chunks(s, d)
    return _rounded(R.dense_post_filtered(c, V.items(s, d), R.metadata_filter(c, "src3"), 10))


@query("dense_batch_topk", _top(_IP, 3, source="v_chunks, v_questions"))
def _(s, d):
    return _rounded(R.dense(V.chunks(s, d), V.questions(s, d), 3))


@query("pairwise_cosine", "SELECT a.query_id AS a, b.query_id AS b, round(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(a.q, lambda p: p * p)) * list_sum(list_transform(b.q, lambda p: p * p))), 6) AS score FROM v_items a JOIN v_items b ON a.query_id < b.query_id")
def _(s, d):
    return _rounded(R.pairwise_cosine(V.items(s, d).select(F.col("query_id").alias("id"), F.col("q").alias("v"))))


# ---- BM25 and fusion ----
def _bm25(low: bool, k: int = 10, where: str = "TRUE") -> list[tuple[str, str]]:
    t = "lower(text)" if low else "text"
    q = "lower(question)" if low else "question"
    split = lambda x: rf"unnest(list_filter(regexp_split_to_array({x}, '\s+'), lambda e: e <> ''))"
    return [
        ("sub", f"SELECT * FROM v_texts WHERE {where}"),
        ("tok", f"SELECT chunk_id, {split(t)} AS term FROM sub"),
        ("post", "SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL"),
        ("dl", f"SELECT chunk_id, len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda e: e <> '')) AS dl FROM sub"),
        ("tot", "SELECT count(*) AS n, avg(dl) AS avgdl FROM dl"),
        ("raw", "SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, tot GROUP BY term"),
        ("idf", "SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw"),
        ("qt", f"SELECT query_id, term, count(*) AS times FROM (SELECT query_id, {split(q)} AS term FROM v_items) GROUP BY ALL"),
        ("hit", "SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), tot GROUP BY ALL"),
        ("best", f"SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, coalesce(score, 0) AS score FROM v_items CROSS JOIN (SELECT chunk_id FROM sub) LEFT JOIN hit USING (query_id, chunk_id))) WHERE rank <= {k}"),
    ]


_BEST = "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM best"


@query("bm25_topk", _BEST, *_bm25(False))
def _(s, d):
    return _rounded(R.bm25(V.texts(s, d), V.items(s, d), 10))


@query("bm25_lowercase", _BEST, *_bm25(True))
def _(s, d):
    return _rounded(R.bm25(V.texts(s, d), V.items(s, d), 10, lowercase=True))


@query("bm25_filtered_stats", _BEST, *_bm25(False, where="company = 'src1'"))
def _(s, d):
    return _rounded(R.bm25(R.metadata_filter(V.texts(s, d), "src1"), V.items(s, d), 10))


@query("bm25_corpus_stats", "SELECT term, df, round(idf, 6) AS idf FROM idf", *_bm25(False))
def _(s, d):
    _, totals, df = R.corpus_stats(V.texts(s, d))
    return df.join(R.idf(df, totals), "term").select("term", "df", F.round("idf", 6).alias("idf"))


_DENSE30 = ("dense30", _top(_L2, 30, order="ASC"))


@query(
    "rrf_hybrid",
    """SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, at_src, at_rank) AS rank FROM (
        SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score, min(src) AS at_src, arg_min(rank, src) AS at_rank FROM (
          SELECT query_id, chunk_id, rank, 0 AS src FROM best UNION ALL SELECT query_id, chunk_id, rank, 1 FROM dense30) GROUP BY ALL)) WHERE rank <= 10""",
    *_bm25(False, 30),
    _DENSE30,
)
def _(s, d):
    q = V.items(s, d)
    return _rounded(R.fuse(R.bm25(V.texts(s, d), q, 30), R.dense(V.chunks(s, d), q, 30, l2=True), 10))


@query(
    "naive_hybrid_merge",
    """SELECT query_id, rank, chunk_id, src FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, r) AS rank FROM (
      SELECT query_id, chunk_id, min(src) AS src, arg_min(rank, src) AS r FROM (
        SELECT query_id, chunk_id, rank, 0 AS src FROM dense30 WHERE rank <= 6 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM best) GROUP BY ALL)) WHERE rank <= 10""",
    *_bm25(False, 10),
    _DENSE30,
)
def _(s, d):
    q = V.items(s, d)
    return R.merge_by_priority(R.dense(V.chunks(s, d), q, 6, l2=True), R.bm25(V.texts(s, d), q, 10), 10)


# ---- routing ----
_ROUTE = [
    ("known", "SELECT DISTINCT company FROM v_texts"),
    ("latest", "SELECT company, max(year) AS latest FROM v_texts GROUP BY ROLLUP (company)"),
    ("listed", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}')" for k, n in enumerate(UNKNOWN)) + ") l(ord, name) WHERE NOT EXISTS (SELECT 1 FROM known WHERE contains(lower(company), name))"),
    ("named", "SELECT query_id, question, q, (SELECT min(company) FROM known WHERE contains(lower(question), lower(company))) AS company, (SELECT arg_min(name, ord) FROM listed WHERE contains(lower(question), name)) AS unknown FROM v_questions"),
    (
        "routed",
        rf"""SELECT n.query_id, question, q, unknown, n.company, CAST(coalesce(TRY_CAST(nullif(regexp_extract(question, '\b(?:19|20)\d\d\b'), '') AS INTEGER),
          CASE WHEN regexp_matches(question, '(?i){RECENCY}') THEN coalesce(l.latest, (SELECT latest FROM latest WHERE company IS NULL)) END) AS INTEGER) AS year
          FROM named n LEFT JOIN latest l ON l.company = n.company""",
    ),
    ("scored", "SELECT query_id, chunk_id, list_sum(list_transform(list_zip(embedding, q), lambda p: p[1] * p[2])) AS score FROM v_chunks c JOIN routed r ON unknown IS NULL AND (r.company IS NULL OR r.company = c.company) AND (r.year IS NULL OR r.year = c.year)"),
    ("hits", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5"),
    (
        "status",
        """SELECT r.query_id, r.company, r.year, CASE WHEN unknown IS NOT NULL THEN concat('No indexed data for ''', unknown, '''.')
          WHEN best IS NULL AND year IS NOT NULL THEN concat('No data found for year ', year, '.')
          WHEN best IS NULL OR best < 0.58 THEN 'No sufficiently relevant data found for this query.' END AS reason
          FROM routed r LEFT JOIN (SELECT query_id, max(score) AS best FROM hits GROUP BY 1) b USING (query_id)""",
    ),
]


@query("routed_search", "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits JOIN status USING (query_id) WHERE reason IS NULL", *_ROUTE)
def _(s, d):
    return _rounded(R.routed_search(V.chunks(s, d), V.questions(s, d), texts=V.texts(s, d))[0])


@query("confidence_gate", "SELECT query_id, company, year, reason IS NULL AS matched, reason FROM status", *_ROUTE)
def _(s, d):
    return R.routed_search(V.chunks(s, d), V.questions(s, d), texts=V.texts(s, d))[1]


def _plan(s, d):
    c = V.texts(s, d)
    return R.route(V.questions(s, d).drop("q"), R.known_companies(c), R.latest_years(c))


@query("guard_unknown_company", "SELECT query_id, question, unknown FROM routed WHERE unknown IS NOT NULL", *_ROUTE)
def _(s, d):
    return _plan(s, d).where("unknown is not null").select("query_id", "question", "unknown")


@query("recency_resolution", "SELECT query_id, company, year FROM routed", *_ROUTE)
def _(s, d):
    return _plan(s, d).select("query_id", "company", "year")


@query("latest_year", "SELECT company, latest FROM latest", *_ROUTE)
def _(s, d):
    return R.latest_years(V.texts(s, d))


@query("query_year", r"SELECT query_id, TRY_CAST(nullif(regexp_extract(question, '\b(?:19|20)\d\d\b'), '') AS INTEGER) AS v2, TRY_CAST(nullif(regexp_extract(question, '\b20\d\d\b'), '') AS INTEGER) AS v1 FROM v_questions")
def _(s, d):
    return V.questions(s, d).select("query_id", C.year_of_query(F.col("question")).alias("v2"), C.year_of_query(F.col("question"), v1=True).alias("v1"))


@query("query_company_v1", "SELECT query_id, CASE " + " ".join(f"WHEN contains(lower(question), '{x.lower()}') THEN '{x}'" for x in V1_COMPANIES) + " END AS company FROM v_questions")
def _(s, d):
    return V.questions(s, d).select("query_id", P.v1_company(F.col("question")).alias("company"))


@query("metadata_filter_ci", "SELECT chunk_id, company, year FROM v_texts WHERE lower(company) = 'src7' AND year = 2020")
def _(s, d):
    return R.metadata_filter(V.texts(s, d), "SRC7", "2020").select("chunk_id", "company", "year")


@query("metadata_filter_exact", "SELECT chunk_id, company, year FROM v_texts WHERE company = 'src7'")
def _(s, d):
    return R.metadata_filter(V.texts(s, d), "src7", ignore_case=False).select("chunk_id", "company", "year")


# ---- cleaning ----
def _step(name: str, steps: list[tuple[str, str]]) -> None:
    @query("clean_" + name, f"SELECT doc_id, {C.sql('text', steps)} AS text FROM v_noisy")
    def _(s, d):
        return V.noisy(s, d).select("doc_id", C.apply(F.col("text"), steps).alias("text"))


for _chain in (C.V2, C.V1):
    for _name, _steps in _chain.items():
        _step(_name, _steps)
for _name, _steps in C.V1_OLD.items():
    _step(_name + "_old", _steps)


def _chain_query(name: str, chain: dict) -> None:
    sql = "text"
    for steps in chain.values():
        sql = C.sql(sql, steps)

    @query(name, f"SELECT doc_id, {C.sql_strip(sql)} AS text FROM v_noisy")
    def _(s, d):
        return V.noisy(s, d).select("doc_id", C.clean(F.col("text"), chain).alias("text"))


_chain_query("clean_v2_text", C.V2)
_chain_query("clean_v1_text", C.V1)
_chain_query("clean_v1_old_text", C.V1 | C.V1_OLD)


@query("repeat_key", r"SELECT doc_id, regexp_replace(concat(text, ' ', doc_id), '\d+\s*$', '#') AS k FROM documents")
def _(s, d):
    return V.table(s, d, "documents").select("doc_id", C.repeat_key(F.concat("text", F.lit(" "), F.col("doc_id").cast("string"))).alias("k"))


@query("tokenise", r"SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda e: e <> '') AS t FROM v_noisy)")
def _(s, d):
    t = C.tokens(F.col("text"), True)
    return V.noisy(s, d).select("doc_id", F.size(t).alias("n"), F.array_join(t, "|").alias("tokens"))


@query("year_from_stem", "SELECT DISTINCT file_name, CAST(string_split(file_name, '_')[2] AS INTEGER) AS year, string_split(file_name, '_')[2] AS folder_year FROM v_docs")
def _(s, d):
    f = V.docs(s, d).select("file_name").distinct()
    return f.select("file_name", C.year_of_stem(F.col("file_name")).alias("year"), C.year_of_folder(F.col("file_name")).alias("folder_year"))


# ---- lines ----
def _footed(s: SparkSession, d: str) -> DataFrame:
    """Pages with a printed footer; on odd pages its third line is missing."""
    foot = ["Apple Inc. | 2016 Form 10-K | 22", "5/16/26, 9:56 AM", "Document", "https://www.sec.gov/x", "25/84"]
    extra = V.docs(s, d).select("company", "file_name", "page_index", F.explode(F.arrays_zip(F.lit(foot).alias("t"), F.lit(list(range(5))).alias("k"))).alias("e"))
    extra = extra.select("company", "file_name", "page_index", (F.lit(1_000_000) + F.col("e.k")).alias("line_index"), F.col("e.t").alias("text")).where("not (page_index % 2 = 1 and line_index = 1000002)")
    return V.lines(s, d).select("company", "file_name", "page_index", "line_index", "text").unionByName(extra)


_FOOT = (
    "foot",
    """SELECT company, file_name, page_index, line_index, text FROM v_lines UNION ALL
  SELECT company, file_name, page_index, 1000000 + k, t FROM v_docs, (VALUES (0, 'Apple Inc. | 2016 Form 10-K | 22'), (1, '5/16/26, 9:56 AM'), (2, 'Document'), (3, 'https://www.sec.gov/x'), (4, '25/84')) f(k, t) WHERE NOT (page_index % 2 = 1 AND k = 2)""",
)


@query(
    "footer_block_removed",
    "SELECT company, file_name, page_index, CAST(row_number() OVER (PARTITION BY company, file_name, page_index ORDER BY line_index) - 1 AS INTEGER) AS line_index, text FROM foot WHERE NOT (page_index % 2 = 0 AND line_index >= 1000000)",
    _FOOT,
)
def _(s, d):
    return lines.drop_export_blocks(_footed(s, d))


@query("page_fraction_lines", f"SELECT company, page_index, line_index, regexp_matches(trim(text), '{P.FRACTION}') AS fraction, lower(trim(text)) = 'document' AS word, regexp_matches(text, '{P.URL}') AS url FROM foot", _FOOT)
def _(s, d):
    t = F.col("text")
    return _footed(s, d).select("company", "page_index", "line_index", P.is_fraction(t).alias("fraction"), P.is_document_word(t).alias("word"), P.has_url(t).alias("url"))


# ---- headings ----
_W = lambda t: rf"len(list_filter(regexp_split_to_array({t}, '\s+'), lambda e: e <> ''))"
_HEAD = [
    ("plain", "SELECT company, file_name, size AS s, count(*) AS n, min(page_index * 16777216 + line_index) AS o FROM v_lines WHERE flags = 0 AND trim(text) <> '' GROUP BY ALL"),
    ("base", "SELECT company, file_name, arg_max(s, n * 1000000000000 - o) AS b FROM plain GROUP BY ALL"),
    ("feat", f"SELECT v_lines.*, trim(text) AS t, {_W('text')} AS n, size / coalesce(b, 9.0) AS rel, flags = 16 AS bold, flags = 2 AS ital, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS caps FROM v_lines LEFT JOIN base USING (company, file_name)"),
    (
        "scores",
        r"""SELECT *, CASE WHEN letters = 0 THEN 0
          WHEN n = 1 AND t LIKE '%.' AND NOT regexp_matches(rtrim(t, '.'), '^\d+$|^(?i:[IVXLCDM]+)$|^[A-Za-z]*\s*\d+$') THEN 0
          ELSE CASE WHEN bold THEN 3 WHEN ital THEN 2 ELSE 0 END + CASE WHEN rel >= 1.5 THEN 3 WHEN rel >= 1.15 THEN 2 WHEN rel >= 0.98 THEN 1 ELSE -2 END
            + CASE WHEN n <= 12 THEN 2 WHEN n <= 24 THEN 0 ELSE -3 END + CASE WHEN t LIKE '%.' AND n > 3 THEN -2 ELSE 0 END + CASE WHEN caps >= 0.9 * letters THEN 1 ELSE 0 END END AS score FROM feat""",
    ),
    ("lev", f"SELECT *, score >= 5 AS h0, CASE WHEN score < 5 THEN 0 WHEN rel >= 1.5 THEN 1 WHEN regexp_matches(t, '{P.MARKER}') THEN 2 WHEN ital AND rel < 1.15 THEN 4 WHEN bold THEN 3 ELSE 4 END AS lv FROM scores"),
    ("ev", "SELECT *, CASE WHEN bold AND NOT h0 AND n > 24 AND letters > 0 AND t NOT LIKE '%.' THEN 1 WHEN NOT bold OR t LIKE '%.' THEN 0 END AS e FROM lev"),
    ("run", "SELECT *, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY company, file_name, page_index ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND bold AND h0 AS out FROM ev"),
]


def _headed(s, d):
    return headings.detect(V.lines(s, d))


@query("font_baseline", "SELECT company, file_name, b AS baseline_body_size FROM base", *_HEAD)
def _(s, d):
    x = V.lines(s, d).withColumn("ord", F.col("page_index").cast("long") * 16777216 + F.col("line_index"))
    return headings.baseline_size(x)


@query("heading_score", "SELECT doc_id, line_index, score, lv AS level FROM lev", *_HEAD)
def _(s, d):
    x = headings.detect(V.lines(s, d))
    lev = F.when(F.col("score") >= 5, headings.level(F.col("text"), F.col("relative_size"), F.col("is_bold"), F.col("is_italic"))).otherwise(0)
    return x.select("doc_id", "line_index", "score", lev.alias("level"))


@query("heading_bold_run", "SELECT doc_id, line_index, h0 AND NOT out AS is_heading, CASE WHEN out THEN 0 ELSE lv END AS level, out AS suppressed FROM run", *_HEAD)
def _(s, d):
    return _headed(s, d).select("doc_id", "line_index", "is_heading", "level", F.array_contains("reasons", "continuation_of_bold_sentence").alias("suppressed"))


@query("heading_counts", "SELECT company, file_name, page_index, count(*) FILTER (WHERE h0 AND NOT out) AS heading_count FROM run GROUP BY ALL", *_HEAD)
def _(s, d):
    return _headed(s, d).groupBy("company", "file_name", "page_index").agg(F.count_if("is_heading").alias("heading_count"))


@query("v1_headings", rf"SELECT doc_id, line_index, text FROM v_lines WHERE length(trim(text)) >= 4 AND (regexp_matches(trim(text), '(?i)^Item\s+\d+[A-Z]?\.') OR (upper(trim(text)) = trim(text) AND regexp_matches(text, '\p{{Lu}}') AND length(trim(text)) < 80 AND {_W('text')} <= 8))")
def _(s, d):
    return V.lines(s, d).where(P.v1_heading(F.col("text"))).select("doc_id", "line_index", "text")


# ---- numbers ----
_CELLS = "SELECT l_orderkey AS page, l_linenumber AS line, unnest([concat(l_returnflag, l_linestatus), '$', '(' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) || ')', CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || '%', '$1.5 - $2', '—', '1e5', '2021']) AS cell FROM lineitem"


def _cells(s: SparkSession, d: str) -> DataFrame:
    x = V.table(s, d, "lineitem")
    whole = lambda c: F.floor(c).cast("long").cast("string")
    cells = F.array(F.concat("l_returnflag", "l_linestatus"), F.lit("$"), F.concat(F.lit("("), whole("l_extendedprice"), F.lit(")")), F.concat(whole("l_quantity"), F.lit("%")), F.lit("$1.5 - $2"), F.lit("—"), F.lit("1e5"), F.lit("2021"))
    return x.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.explode(cells).alias("cell"))


def _numeric(name: str, f: Callable[[Column], Column], sql: str) -> None:
    @query("numeric_" + name, f"SELECT page, line, count(*) FILTER (WHERE {sql}) AS n, count(*) AS cells FROM cells GROUP BY ALL", ("cells", _CELLS))
    def _(s, d):
        return _cells(s, d).groupBy("page", "line").agg(F.count_if(f(F.col("cell"))).alias("n"), F.count(F.lit(1)).alias("cells"))


_TOKEN = r"regexp_full_match(regexp_replace(cell, '[$,.\-+()%\s]', '', 'g'), '\d+')"
_numeric("token_analyzer", P.numeric_token, _TOKEN)
_numeric("token_parser", P.numeric_cell, f"cell NOT IN ('$', '-', '--', '—', '%', '(', ')') AND {_TOKEN}")
_numeric("token_chunker", P.numeric_value, r"regexp_full_match(regexp_replace(cell, '[,$%()]', '', 'g'), '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')")
_numeric("year", P.is_year, r"regexp_full_match(cell, '\d{4}') AND TRY_CAST(cell AS INTEGER) BETWEEN 1900 AND 2100")


# ---- table lines ----
def _geometry(s: SparkSession, d: str) -> DataFrame:
    """Lines as table lines: a pseudo ratio of figures from the length, one or two x places."""
    n = F.length("text")
    return V.lines(s, d).select(
        "company", "file_name", "page_index", "line_index", "text", F.col("y0").alias("y"), F.col("x0").alias("x"),
        F.when(n % 3 == 0, F.array(F.col("x0"), F.lit(300.0))).otherwise(F.array("x0")).alias("xs"),
        F.when(n % 4 == 0, 0.5).otherwise(0.0).alias("numeric_ratio"),
    )


_PAGE = "PARTITION BY company, file_name, page_index ORDER BY line_index"
_CAND = [
    ("geo", "SELECT company, file_name, page_index, line_index, trim(text) AS t, y0 AS y, x0 AS x, CASE WHEN length(text) % 3 = 0 THEN [x0, 300.0] ELSE [x0] END AS xs, CASE WHEN length(text) % 4 = 0 THEN 0.5 ELSE 0.0 END AS r FROM v_lines"),
    ("near", "SELECT *, " + " + ".join(f"CASE WHEN {f}(r, {k}) OVER ({_PAGE}) >= 0.3 AND abs({f}(y, {k}) OVER ({_PAGE}) - y) <= 80 THEN 1 ELSE 0 END" for f in ("lag", "lead") for k in (1, 2)) + " AS nb FROM geo"),
    ("p1", "SELECT *, r >= 0.3 AND (nb >= 1 OR len(list_distinct(xs)) >= 2) AS c1 FROM near"),
    ("p2", "SELECT *, c1 OR (t <> '' AND EXISTS (SELECT 1 FROM p1 b WHERE b.company = a.company AND b.file_name = a.file_name AND b.page_index = a.page_index AND b.c1 AND abs(b.y - a.y) <= 6)) AS c2 FROM p1 a"),
    ("p3", f"""SELECT *, c2 OR (t <> '' AND {_W('t')} <= 5 AND t NOT LIKE '%.'
      AND EXISTS (SELECT 1 FROM p2 b WHERE b.company = a.company AND b.file_name = a.file_name AND b.page_index = a.page_index AND b.c1 AND b.y - a.y > 0 AND b.y - a.y <= 150)
      AND EXISTS (SELECT 1 FROM p2 b WHERE b.company = a.company AND b.file_name = a.file_name AND b.page_index = a.page_index AND b.c2 AND len(list_filter(b.xs, lambda e: abs(e - a.x) <= 20)) > 0)) AS c3 FROM p2 a"""),
    ("p4e", f"SELECT *, CASE WHEN c3 THEN 1 WHEN NOT coalesce({_W('t')} BETWEEN 1 AND 15 AND abs(lead(y) OVER ({_PAGE}) - y) <= 40, FALSE) THEN 0 END AS e FROM p3"),
    ("p4", f"SELECT *, coalesce(first_value(e IGNORE NULLS) OVER ({_PAGE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) = 1 AS c4 FROM p4e"),
]
for _k in (1, 2, 3, 4):

    def _cand(k: int) -> None:
        @query(f"table_candidates_p{k}", f"SELECT company, file_name, page_index, line_index, c{k} AS candidate FROM p4", *_CAND)
        def _(s, d):
            return tables.candidates(_geometry(s, d)).select("company", "file_name", "page_index", "line_index", F.col(f"cand{k}").alias("candidate"))

    _cand(_k)


# ---- tables: a page an order, a row a line item ----
_ITEMS = ("item", "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_quantity, l_discount, l_returnflag, l_linestatus) AS n FROM lineitem")


def _table_lines(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"))
    x = V.table(s, d, "lineitem").withColumn("n", n)
    cell = lambda t, at, b=False: F.struct(t.alias("text"), at.cast("double").alias("x"), F.lit(b).alias("bold"))
    whole = lambda c: F.floor(c).cast("long").cast("string")
    cells = F.array(cell(F.concat("l_returnflag", "l_linestatus"), F.lit(72)), cell(F.lit("$"), F.lit(290)), cell(whole("l_extendedprice"), 300 + F.col("n") % 7), cell(whole("l_quantity"), F.lit(380)), cell(whole(F.col("l_discount") * 100), F.lit(460)))
    key = [F.lit("orders").alias("company"), F.lit("lineitem").alias("file_name"), F.col("l_orderkey").cast("int").alias("page_index")]
    body = x.select(*key, F.col("n").alias("line_index"), (F.lit(100.0) + 12 * F.col("n")).alias("y"), cells.alias("cells"))
    head = F.array(*[cell(F.lit(t), F.lit(p), True) for t, p in (("2021", 300), ("2020", 380), ("2019", 460))])
    top = x.select(*key).distinct().select("*", F.lit(0).alias("line_index"), F.lit(100.0).alias("y"), head.alias("cells"))
    return body.unionByName(top)


@query(
    "parse_page_tables",
    """SELECT CAST(l_orderkey AS INTEGER) AS page_index, '2021,2020,2019' AS header, 'year' AS column_type, CAST(count(*) AS INTEGER) AS row_count,
      string_agg(concat(l_returnflag, l_linestatus, ':', CAST(floor(l_extendedprice) AS BIGINT), ',', CAST(floor(l_quantity) AS BIGINT), ',', CAST(floor(l_discount * 100) AS BIGINT)), '|' ORDER BY n) AS rows FROM item GROUP BY l_orderkey""",
    _ITEMS,
)
def _(s, d):
    t = tables.parse(_table_lines(s, d))
    row = F.array_join(F.transform("rows", lambda r: F.concat(r["label"], F.lit(":"), F.array_join(F.transform(r["values"], lambda v: v["val"]), ","))), "|")
    return t.select("page_index", F.array_join("header", ",").alias("header"), "column_type", "row_count", row.alias("rows"))


@query(
    "table_text",
    """SELECT CAST(l_orderkey AS INTEGER) AS page_index, TRUE AS is_real, 'Columns: 2021, 2020, 2019' || chr(10) ||
      string_agg(concat(l_returnflag, l_linestatus, ' -- 2021: ', CAST(floor(l_extendedprice) AS BIGINT), ', 2020: ', CAST(floor(l_quantity) AS BIGINT), ', 2019: ', CAST(floor(l_discount * 100) AS BIGINT)), chr(10) ORDER BY n) AS text FROM item GROUP BY l_orderkey""",
    _ITEMS,
)
def _(s, d):
    t = tables.parse(_table_lines(s, d))
    return t.select("page_index", tables.real_table(F.col("rows")).alias("is_real"), tables.table_text(F.col("header"), F.col("rows")).alias("text"))


# ---- pages of three tables: years with wrapped labels, bold titles and words as values; a header of
# stacked words; and bare rows ----
def _mixed_lines(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    n = F.row_number().over(w.orderBy("l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"))
    x = V.table(s, d, "lineitem").withColumns({"n": n, "m": F.count(F.lit(1)).over(w)})
    cell = lambda t, at, b=False: F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(float(at)).alias("x"), F.lit(b).alias("bold"))
    whole = lambda c: F.floor(c).cast("long").cast("string")
    line = lambda y, *cells: F.struct(y.cast("double").alias("y"), F.array(*cells).alias("cells"))
    top, low = 100 + 40 * F.col("n"), 320 + 40 * F.col("m")
    price, count = whole("l_extendedprice"), whole("l_quantity")
    body = F.array(
        line(top, cell("REVENUE", 72, True)),
        line(top + 10, cell("Net", 72)),
        line(top + 20, cell(F.concat(F.lit("sales, "), "l_returnflag"), 72), cell("$", 288), cell(price, 300), cell(F.when(F.col("l_returnflag") == "N", "N/A").otherwise(count), 384)),
        line(low + 30 + 10 * F.col("n"), cell(F.concat(F.lit("period "), F.col("n").cast("string")), 72), cell(count, 340), cell(price, 410), cell(F.when(F.col("n") % 2 == 1, "note").otherwise("$"), 600)),
    )
    once = F.array(
        line(F.lit(100), cell("2021", 300, True), cell("2020", 380, True)),
        line(low, cell("Periods", 72, True), cell("Total", 300, True), cell("Average", 380, True), cell("(unaudited)", 600, True)),
        line(low + 10, cell("Number", 305, True), cell("$", 345, True), cell("Price", 385, True)),
        line(low + 330 + 10 * F.col("m"), cell("alpha", 72), cell("beta", 200)),
        line(low + 340 + 10 * F.col("m"), cell("gamma", 72), cell("delta", 200)),
    )
    lines_ = x.select(F.col("l_orderkey").cast("int").alias("page_index"), F.explode(F.when(F.col("n") == 1, F.concat(once, body)).otherwise(body)).alias("e"))
    at = (F.col("e.y") * 10).cast("int")
    y, last = F.col("e.y"), F.array_max(F.transform("e.cells", lambda c: c["x"]))
    box = F.array(F.col("e.cells")[0]["x"], y, last + 10, y + 8)
    return lines_.select(F.lit("orders").alias("company"), F.lit("lineitem").alias("file_name"), "page_index", at.alias("line_index"), y.alias("y"), F.col("e.cells").alias("cells"), box.alias("bbox"))


@query(
    "parse_mixed_tables",
    """SELECT page_index, table_index, header, column_type, rows, top, bottom FROM (
      SELECT CAST(l_orderkey AS INTEGER) AS page_index, 0 AS table_index, '2021,2020' AS header, 'year' AS column_type,
        string_agg(concat('REVENUE:~,~|Net sales, ', l_returnflag, ':', CAST(floor(l_extendedprice) AS BIGINT), ',', CASE WHEN l_returnflag = 'N' THEN 'N/A' ELSE CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) END), '|' ORDER BY n) AS rows,
        100.0::DOUBLE AS top, CAST(128 + 40 * count(*) AS DOUBLE) AS bottom FROM item GROUP BY l_orderkey
      UNION ALL SELECT CAST(l_orderkey AS INTEGER), 1, 'Total Number,Average Price,(unaudited)', 'text_label',
        string_agg(concat('period ', n, ':', CAST(floor(l_quantity) AS BIGINT), ',', CAST(floor(l_extendedprice) AS BIGINT), ',', CASE WHEN n % 2 = 1 THEN 'note' ELSE '~' END), '|' ORDER BY n),
        CAST(320 + 40 * count(*) AS DOUBLE), CAST(358 + 50 * count(*) AS DOUBLE) FROM item GROUP BY l_orderkey
      UNION ALL SELECT CAST(l_orderkey AS INTEGER), 2, '', NULL, 'alpha/beta|gamma/delta', CAST(650 + 50 * count(*) AS DOUBLE), CAST(668 + 50 * count(*) AS DOUBLE) FROM item GROUP BY l_orderkey)""",
    _ITEMS,
)
def _(s, d):
    t = tables.parse(_mixed_lines(s, d))
    values = lambda r: F.concat(r["label"], F.lit(":"), F.array_join(F.transform(r["values"], lambda v: v["val"]), ",", "~"))
    row = F.transform("rows", lambda r: F.when(r["values"].isNotNull(), values(r)).otherwise(F.array_join(F.transform(r["cells"], lambda c: c["text"]), "/")))
    return t.select("page_index", "table_index", F.array_join("header", ",").alias("header"), "column_type", F.array_join(row, "|").alias("rows"), F.col("bbox")[1].alias("top"), F.col("bbox")[3].alias("bottom"))


# ---- paragraphs ----
_PARA = [
    ("src", "SELECT *, CASE WHEN length(text) % 17 = 0 THEN 'table' WHEN h0 AND NOT out THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN out THEN 0 ELSE lv END AS level FROM run WHERE trim(text) <> ''"),
    ("brk", f"SELECT *, CASE WHEN kind <> 'paragraph' OR lag(kind) OVER ({_PAGE}) IS DISTINCT FROM 'paragraph' OR coalesce(y0 - lag(y1) OVER ({_PAGE}) > 14 OR abs(x0 - lag(x0) OVER ({_PAGE})) > 25, FALSE) THEN 1 ELSE 0 END AS f FROM src"),
    ("grp", f"SELECT *, sum(f) OVER ({_PAGE}) AS g FROM brk"),
    ("blk", "SELECT company, file_name, page_index, g, kind AS block_type, string_agg(t, ' ' ORDER BY line_index) AS text, max(CASE WHEN kind = 'heading' THEN level END) AS level, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS INTEGER) AS line_count FROM grp WHERE kind <> 'table' GROUP BY ALL"),
    ("blocks", "SELECT *, CAST(row_number() OVER (PARTITION BY company, file_name, page_index ORDER BY g) - 1 AS INTEGER) AS block_index FROM blk"),
]


def _blocks(s, d):
    return paragraphs.assemble(_headed(s, d).withColumn("is_table", F.length("text") % 17 == 0))


@query("paragraph_islands", "SELECT company, file_name, page_index, block_index, block_type, text, level, line_count FROM blocks", *_HEAD, *_PARA)
def _(s, d):
    return _blocks(s, d).select("company", "file_name", "page_index", "block_index", "block_type", "text", "level", "line_count")


@query("bbox_union", "SELECT company, file_name, page_index, block_index, x0, y0, x1, y1 FROM blocks", *_HEAD, *_PARA)
def _(s, d):
    return _blocks(s, d).select("company", "file_name", "page_index", "block_index", "x0", "y0", "x1", "y1")


def _boiler(key: str) -> list[tuple[str, str]]:
    return [
        ("bl", "SELECT company, file_name, page_index, trim(text) AS text FROM v_boiler"),
        ("bp", "SELECT company, file_name, count(DISTINCT page_index) AS p FROM bl GROUP BY ALL"),
        ("rep", f"SELECT company, file_name, {key} AS k FROM bl JOIN bp USING (company, file_name) GROUP BY ALL HAVING count(DISTINCT page_index) >= greatest(5.0, 0.3 * any_value(p))"),
    ]


_KEY = r"regexp_replace(text, '\d+\s*$', '#')"


@query("boilerplate_exact", "SELECT company, file_name, page_index, text FROM bl WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.company = bl.company AND rep.file_name = bl.file_name AND k = text)", *_boiler("text"))
def _(s, d):
    x = V.with_boilerplate(V.lines(s, d)).withColumn("text", C.strip(F.col("text")))
    return paragraphs.drop_repeated(x).select("company", "file_name", "page_index", "text")


@query("boilerplate_normalised", f"SELECT company, file_name, page_index, text FROM bl WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.company = bl.company AND rep.file_name = bl.file_name AND k = {_KEY})", *_boiler(_KEY))
def _(s, d):
    x = V.with_boilerplate(V.lines(s, d)).withColumn("text", C.strip(F.col("text")))
    return paragraphs.fix(x).select("company", "file_name", "page_index", "text")


_FRAG = rf"{_W('t')} <= 4 AND t LIKE '%.' AND NOT regexp_matches(t, '{P.FRAGMENT}')"


@query("fragment_downgrade", f"SELECT doc_id, line_index, CASE WHEN {_FRAG} THEN 'paragraph' ELSE 'heading' END AS block_type FROM (SELECT doc_id, line_index, trim(text) AS t FROM v_lines)")
def _(s, d):
    return V.lines(s, d).select("doc_id", "line_index", F.when(P.is_fragment(F.col("text")), "paragraph").otherwise("heading").alias("block_type"))


# ---- sections: blocks of a report in order ----
def _ordered(s, d):
    return _blocks(s, d).withColumn("ord", F.col("page_index").cast("long") * 1_000_000 + F.col("block_index"))


_TREE = [
    ("ob", "SELECT *, page_index::BIGINT * 1000000 + block_index AS ord, CASE WHEN block_type = 'heading' AND level > 0 THEN level END AS l FROM blocks"),
    ("hs", "SELECT *, " + ", ".join(f"coalesce(max(CASE WHEN l = {k} THEN ord END) OVER (PARTITION BY company, file_name ORDER BY ord), -1) AS h{k}" for k in (1, 2, 3, 4)) + " FROM ob"),
    ("open", "SELECT *, list_filter([CASE WHEN h1 > -1 THEN h1 END, CASE WHEN h2 > h1 THEN h2 END, CASE WHEN h3 > greatest(h1, h2) THEN h3 END, CASE WHEN h4 > greatest(h1, h2, h3) THEN h4 END], lambda e: e IS NOT NULL) AS ids FROM hs"),
    ("sec", "SELECT o.company, o.file_name, o.ord AS section_id, o.ids[-2] AS parent_id, o.l AS level, o.text AS title, len(o.ids) AS depth, o.page_index AS page_start, m.page_end, m.paragraphs FROM open o JOIN (SELECT company, file_name, ids[-1] AS sid, max(page_index) AS page_end, count(*) FILTER (WHERE l IS NULL) AS paragraphs FROM open WHERE len(ids) > 0 GROUP BY ALL) m ON o.company = m.company AND o.file_name = m.file_name AND m.sid = o.ord"),
]


@query("section_tree", "SELECT * FROM sec", *_HEAD, *_PARA, *_TREE)
def _(s, d):
    return sections.tree(_ordered(s, d)).withColumn("depth", F.size("path")).drop("path")


@query("sections_rollup", "SELECT company, file_name, count(*) AS sections, CAST(sum(paragraphs) AS BIGINT) AS paragraphs FROM sec GROUP BY ROLLUP (company, file_name)", *_HEAD, *_PARA, *_TREE)
def _(s, d):
    return sections.counts(sections.tree(_ordered(s, d)))


@query(
    "tables_asof_section",
    "SELECT t.company, t.file_name, t.page_index, 0 AS table_index, arg_max(o.ids[-1], o.ord) AS section_id FROM v_docs t JOIN open o ON o.company = t.company AND o.file_name = t.file_name AND o.page_index < t.page_index AND len(o.ids) > 0 GROUP BY ALL",
    *_HEAD, *_PARA, *_TREE,
)
def _(s, d):
    t = V.docs(s, d).select("company", "file_name", "page_index", F.lit(0).alias("table_index"))
    return sections.tables_to_sections(t, _ordered(s, d))


@query("boilerplate_changes")
def _(s, d):
    b = _blocks(s, d)
    return paragraphs.changes(b, paragraphs.fix(b))


# ---- chunks ----
@query("chunk_pack")
def _(s, d):
    p = V.docs(s, d).withColumnRenamed("doc_id", "ord")
    return CH.text_chunks(p, ["company", "file_name"]).withColumn("page_numbers", F.array_join("page_numbers", ","))


@query("sentence_split_pack")
def _(s, d):
    x = V.table(s, d, "documents").select("doc_id", F.posexplode(CH.pieces(F.col("text"))).alias("k", "text"))
    return x


@query("recursive_split")
def _(s, d):
    return CH.recursive_chunks(V.table(s, d, "documents").select("doc_id", "text"), ["doc_id"])


@query("tiny_chunk_filter", "SELECT doc_id, line_index, text FROM v_lines WHERE length(trim(text)) >= 15")
def _(s, d):
    return V.lines(s, d).where(F.length(C.strip(F.col("text"))) >= 15).select("doc_id", "line_index", "text")


# ---- metadata and quality ----
_SECT = "CASE " + " ".join("WHEN " + " OR ".join("contains(lower(x), '{}')".format(k.replace("'", "''")) for k in ks) + f" THEN '{n}'" for n, ks in SECTIONS.items()) + " END"
_HINTS = ["risk factors", "our products", "net sales", "", "total assets", "", "", "cash flows", "", "item 8", "advertising"]
_HINT_SQL = "concat(CASE doc_id % 11 " + " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(_HINTS)) + " END, ' ', text)"


def _hinted(s, d):
    hint = F.coalesce(*[F.when(F.col("doc_id") % 11 == k, F.lit(h)) for k, h in enumerate(_HINTS)])
    return V.docs(s, d).select("company", F.col("file_name").alias("report"), F.col("doc_id").alias("chunk_no"), F.concat(hint, F.lit(" "), "text").alias("text"))


@query("section_classify", f"SELECT chunk_no, coalesce({_SECT}, 'Unknown') AS section FROM (SELECT doc_id AS chunk_no, {_HINT_SQL} AS x FROM v_docs)")
def _(s, d):
    return _hinted(s, d).select("chunk_no", P.section(F.col("text")).alias("section"))


@query("section_ffill", f"SELECT chunk_no, coalesce(last_value(sec IGNORE NULLS) OVER (PARTITION BY company, file_name ORDER BY chunk_no), 'Unknown') AS section FROM (SELECT *, {_SECT} AS sec FROM (SELECT company, file_name, doc_id AS chunk_no, {_HINT_SQL} AS x FROM v_docs))")
def _(s, d):
    return quality.fill_sections(_hinted(s, d)).select("chunk_no", "section")


@query(
    "page_sequence_check",
    "SELECT company, file_name, count(*) AS pages, count(*) FILTER (WHERE printed IS NULL) AS missing, count(*) FILTER (WHERE printed <= prev) AS anomalies FROM (SELECT *, last_value(printed IGNORE NULLS) OVER (PARTITION BY company, file_name ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT *, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 1 ELSE page_index END AS printed FROM v_docs)) GROUP BY ALL",
)
def _(s, d):
    p = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).when(F.col("doc_id") % 17 == 0, 1).otherwise(F.col("page_index"))
    return quality.page_sequence(V.docs(s, d).withColumn("printed", p))


@query("run_totals", "SELECT company, chunk_type, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT company, CASE WHEN chunk_id % 3 = 0 THEN 'table' ELSE 'text' END AS chunk_type, text FROM v_texts) GROUP BY CUBE (company, chunk_type)")
def _(s, d):
    return quality.totals(V.texts(s, d).withColumn("chunk_type", F.when(F.col("chunk_id") % 3 == 0, "table").otherwise("text")))


@query("contains_probe", "SELECT doc_id, contains(text, 'the') AND contains(text, 'and') AS both, contains(lower(text), 'tion') AS any_case, replace(left(text, 200), chr(10), ' ') AS preview FROM documents")
def _(s, d):
    t = F.col("text")
    return V.table(s, d, "documents").select("doc_id", quality.probe(t, "the", "and").alias("both"), quality.probe(t, "TION", ignore_case=True).alias("any_case"), quality.preview(t, 200).alias("preview"))


@query("reextract_semi", "SELECT DISTINCT company, file_name FROM v_docs WHERE (company, file_name) IN (('src1', 'src1_2019_10K'), ('src2', 'src2_2020_10K')) OR company = 'src5'")
def _(s, d):
    from pagewright.sources.readers import only

    f = V.docs(s, d).select("company", "file_name").distinct()
    return only(f, s.createDataFrame([("src1", "src1_2019_10K"), ("src2", "src2_2020_10K")], "company string, file_name string"), ["src5"])


@query("text_export", "SELECT company, file_name, string_agg(pg, chr(10) || chr(10) ORDER BY page_index) AS text FROM (SELECT company, file_name, page_index, concat(repeat('=', 70), chr(10), 'PAGE ', page_index, chr(10), repeat('=', 70), chr(10), body) AS pg FROM (SELECT company, file_name, page_index, string_agg(text, chr(10) ORDER BY line_index) AS body FROM v_lines WHERE trim(text) <> '' GROUP BY ALL)) GROUP BY ALL")
def _(s, d):
    from pagewright.sources.writers import readable

    return readable(V.lines(s, d))


@query("chunk_file_numbering", "SELECT doc_id, format('chunk_{:03d}', row_number() OVER (PARTITION BY company, file_name ORDER BY doc_id)) AS name FROM v_docs")
def _(s, d):
    n = F.row_number().over(Window.partitionBy("company", "file_name").orderBy("doc_id"))
    return V.docs(s, d).select("doc_id", F.format_string("chunk_%03d", n).alias("name"))


@query("report_chain")
def _(s, d):
    from pagewright.operators import report

    return report.to_chunks(V.raw_lines(s, d)).select("company", "file_name", "section_id", F.array_join("path", " > ").alias("path"), "chunk_type", "chunk_seq", "text")


@query("embed_hash")
def _(s, d):
    e = embed.embed_passages(V.table(s, d, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.size("embedding").alias("dims"), F.round(F.sqrt(R.dot("embedding", "embedding")), 4).alias("norm"))


@query("word2vec_shape")
def _(s, d):
    return embed.word2vec(V.table(s, d, "documents").na.fill({"text": ""})).select("word", F.lit(100).alias("dims"))
