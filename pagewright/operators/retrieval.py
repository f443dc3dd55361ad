"""Search: dense, BM25, reciprocal-rank fusion, and the routed query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, UNKNOWN, Config
from pagewright.functions.clean import tokens, year_of_query
from pagewright.functions.predicates import recent


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def metadata_filter(chunks: DataFrame, company: str | None = None, year: int | str | None = None, section: str | None = None, ignore_case: bool = True) -> DataFrame:
    """P-18, P-19: each argument that is given is a condition, pushed to the scan."""
    same = (lambda c, v: F.lower(c) == v.lower()) if ignore_case else (lambda c, v: F.col(c) == v)
    for c, v in (("company", company), ("section", section)):
        if v is not None:
            chunks = chunks.where(same(c, v))
    return chunks if year is None else chunks.where(F.col("year") == int(year))


def rank_per_query(scored: DataFrame, k: int, by: Column | str = "score", descending: bool = True) -> DataFrame:
    """The k best of each query, ties to the smaller chunk; Spark prunes before the shuffle."""
    by = F.col(by) if isinstance(by, str) else by
    w = Window.partitionBy("query_id").orderBy(by.desc() if descending else by.asc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows of one block of chunks, and of one chunk of queries, that a dense search pairs.
_ROWS, _ASKED = 20_000, 256


def paired(chunks: DataFrame, queries: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Each chunk with each of a stated set of queries, or with those that agree with it in `on`.

    Chunks are cut into hash blocks of about 20,000, so their number follows the data, and queries
    into groups of about 256; a group meets a block in one key of the join. Columns in `on` are
    part of the key, so rows that don't agree never meet."""
    n, asked = chunks.count(), queries.count()
    blocks, groups = max(1, -(-n // _ROWS)), max(1, -(-asked // _ASKED))
    numbers = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    c = chunks.withColumn("_block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")).withColumn("_group", numbers(groups))
    q = queries.withColumn("_group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("_block", numbers(blocks))
    return c.join(q, ["_block", "_group", *(on or [])])


def dense(chunks: DataFrame, queries: DataFrame, k: int, l2: bool = False, on: list[str] | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, score) by inner product, or by squared distance.

    queries: a stated set of (query_id, q), paired with all chunks, or with those that agree in
    the columns `on` (see paired)."""
    score = squared_l2("embedding", "q") if l2 else dot("embedding", "q")
    scored = paired(chunks, queries, on).select("query_id", "chunk_id", score.alias("score"))
    return rank_per_query(scored, k, descending=not l2).select("query_id", "rank", "chunk_id", "score")


def dense_post_filtered(chunks: DataFrame, queries: DataFrame, allowed: DataFrame, k: int, config: Config = DEFAULT) -> DataFrame:
    """T-03: the pool is cut before the filter, so fewer than k hits may be left."""
    pool = dense(chunks, queries, config.pool, l2=True).join(allowed.select("chunk_id"), "chunk_id", "left_semi")
    return rank_per_query(pool.drop("rank"), k, descending=False).select("query_id", "rank", "chunk_id", "score")


def terms(chunks: DataFrame, lowercase: bool = False) -> DataFrame:
    """(chunk_id, dl, term, tf): postings, with the chunk's length."""
    t = chunks.select("chunk_id", tokens(F.col("text"), lowercase).alias("_t"))
    t = t.select("chunk_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    return t.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame, lowercase: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lengths, totals, term frequencies): (chunk_id, dl), (n, avgdl) and (term, df)."""
    lengths = chunks.select("chunk_id", F.size(tokens(F.col("text"), lowercase)).alias("dl"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    each = chunks.select(F.explode(F.array_distinct(tokens(F.col("text"), lowercase))).alias("term"))
    return lengths, totals, each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(df: DataFrame, totals: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(term, idf); a negative one becomes epsilon times the mean over all terms."""
    raw = df.join(F.broadcast(totals)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg((F.avg("idf") * config.epsilon).alias("eps"))
    return raw.join(F.broadcast(mean)).select("term", F.when(F.col("idf") < 0, F.col("eps")).otherwise(F.col("idf")).alias("idf"))


def bm25_scores(chunks: DataFrame, query_terms: DataFrame, lowercase: bool = False, config: Config = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, score) of chunks with a term of the query; query_terms: (query_id, term)
    with a row for each time a query has it. Statistics are those of the chunks given."""
    _, totals, df = corpus_stats(chunks, lowercase)
    qt = query_terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    hit = terms(chunks, lowercase).join(qt, "term").join(idf(df, totals, config), "term").join(F.broadcast(totals))
    tf = F.col("tf").cast("double")
    part = F.col("times") * F.col("idf") * tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))


def bm25(chunks: DataFrame, queries: DataFrame, k: int, lowercase: bool = False, config: Config = DEFAULT) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k best of all chunks; those without a term score 0.

    Only chunks that score, and the k first chunks by id that might fill up with zeros, are ranked.
    Scores are ranked by nine digits: parts are added up in any order, so those of equal texts
    differ in their last bits, and only rounded do they tie."""
    nine = F.round("score", 9)
    qt = queries.select("query_id", F.explode(tokens(F.col("question"), lowercase)).alias("term"))
    scored = bm25_scores(chunks, qt, lowercase, config)
    best = rank_per_query(scored, k, nine).drop("rank")
    # zeros: the first ids that the query doesn't score; rank k needs at most k + its scored ids before
    firsts = chunks.select("chunk_id").orderBy("chunk_id").limit(k)
    fill = queries.select("query_id").crossJoin(F.broadcast(firsts)).join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    both = best.unionByName(fill.withColumn("score", F.lit(0.0)))
    return rank_per_query(both, k, nine).select("query_id", "rank", "chunk_id", "score")


def fuse(first: DataFrame, second: DataFrame, k: int, config: Config = DEFAULT) -> DataFrame:
    """T-05: reciprocal ranks added up; ties to what came first, the first list's before."""
    both = first.select("query_id", "chunk_id", "rank", F.lit(0).alias("src")).unionByName(second.select("query_id", "chunk_id", "rank", F.lit(1).alias("src")))
    s = both.groupBy("query_id", "chunk_id").agg(F.sum(1 / (config.fuse_k + F.col("rank"))).alias("score"), F.min(F.struct("src", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "at.src", "at.rank")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "score")


def merge_by_priority(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """U-01: the first list, then what the second adds."""
    both = first.select("query_id", "chunk_id", "rank", F.lit(0).alias("src")).unionByName(second.select("query_id", "chunk_id", "rank", F.lit(1).alias("src")))
    s = both.groupBy("query_id", "chunk_id").agg(F.min(F.struct("src", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", F.col("at.src").alias("src"))


def known_companies(chunks: DataFrame) -> DataFrame:
    return chunks.select("company").where("company is not null").distinct()


def latest_years(chunks: DataFrame) -> DataFrame:
    """(company, latest): per company, and over all with a null company."""
    return chunks.rollup("company").agg(F.max("year").alias("latest"))


def route(queries: DataFrame, companies: DataFrame, latest: DataFrame) -> DataFrame:
    """ML-08, ML-09: (query_id, question, unknown, company, year) of each query.

    Companies are matched by substring, which no key can do: Spark pairs all queries with all
    distinct names, and is left to choose which side is small enough to be sent around. unknown:
    the first of the listed names that the query has and no known company contains."""
    low = F.lower("question")
    named = queries.join(companies.select(F.col("company").alias("c")), F.contains(low, F.lower("c")), "left").groupBy("query_id", "question").agg(F.min("c").alias("company"))
    # which listed names a company has: one pass over the companies, at most one row a listed name
    has = companies.select(F.explode(F.filter(F.array(*map(F.lit, UNKNOWN)), lambda n: F.contains(F.lower("company"), n))).alias("name")).distinct()
    listed = queries.sparkSession.createDataFrame(list(enumerate(UNKNOWN)), "ord int, name string")
    strange = listed.join(has, "name", "left_anti")
    first = queries.join(F.broadcast(strange), F.contains(low, F.col("name"))).groupBy("query_id").agg(F.min_by("name", "ord").alias("unknown"))
    every = latest.where("company is null").select(F.col("latest").alias("newest"))
    r = named.join(first, "query_id", "left").join(latest.where("company is not null"), "company", "left").join(F.broadcast(every))
    asked = year_of_query(F.col("question"))
    year = F.when(asked.isNotNull(), asked).when(recent(F.col("question")), F.coalesce("latest", "newest"))
    return r.select("query_id", "question", "unknown", "company", year.alias("year"))


def routed_search(chunks: DataFrame, queries: DataFrame, k: int | None = None, config: Config = DEFAULT, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, status) of a batch of queries with vectors `q`: guard, company, year, filter, top k, floor.

    Companies and years are known from `texts`, by default the chunks. Queries that name a company
    or a year only meet the chunks that agree: four searches, one for each of what may be named."""
    k = k or config.top_k
    known = chunks if texts is None else texts
    plan = route(queries.select("query_id", "question"), known_companies(known), latest_years(known))
    asked = plan.join(queries.select("query_id", "q"), "query_id").where("unknown is null").select("query_id", "q", "company", "year")
    c = chunks.select("chunk_id", "company", "year", "embedding")
    scored = None
    for on in ([], ["company"], ["year"], ["company", "year"]):
        named = asked
        for name in ("company", "year"):
            named = named.where(F.col(name).isNotNull() if name in on else F.col(name).isNull())
        some = paired(c, named.select("query_id", "q", *on), on).select("query_id", "chunk_id", dot("embedding", "q").alias("score"))
        scored = some if scored is None else scored.unionByName(some)
    hits = rank_per_query(scored, k).select("query_id", "rank", "chunk_id", "score")
    best = hits.groupBy("query_id").agg(F.max("score").alias("best"))
    has = known.select("company").distinct().withColumnRenamed("company", "c")
    s = plan.join(best, "query_id", "left").join(has, F.col("company") == F.col("c"), "left")
    reason = (
        F.when(F.col("unknown").isNotNull(), F.format_string("No indexed data for '%s'.", F.col("unknown")))
        .when(F.col("company").isNotNull() & F.col("c").isNull(), F.format_string("No data found for company '%s'.", F.col("company")))
        .when(F.col("best").isNull() & F.col("year").isNotNull(), F.format_string("No data found for year %d.", F.col("year")))
        .when(F.col("best").isNull() | (F.col("best") < config.floor), F.lit("No sufficiently relevant data found for this query."))
    )
    status = s.select("query_id", "company", "year", reason.isNull().alias("matched"), reason.alias("reason"))
    return hits.join(status.where("matched").select("query_id"), "query_id", "left_semi"), status


def pairwise_cosine(vectors: DataFrame) -> DataFrame:
    """ML-10: (a, b, score) over a stated small set, whose result grows as its square. Spark chooses
    how both sides meet."""
    x, y = vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", cosine("va", "vb").alias("score"))
