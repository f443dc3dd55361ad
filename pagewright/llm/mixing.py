"""Mixing sources to target weights (op 1): blocks, multinomial shards, index permutations.

DataFrame functions only. The words of a source, its documents laid end to end, are cut into
blocks of a fixed length. The mix is a row of slots in shards; each slot draws its source, takes
the source's next ordinal, and the ordinal is mapped through a pseudorandom permutation of the
source's block indexes. So a source passes over its blocks as often as its target asks, each
pass in the same shuffled order, and the last pass stops at the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import bound, materialise, nested, release_shuffles, running_total, unnested

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
_ROUNDS = 20
_CELLS = 4096


def permuted(x: Column, n: Column, seed: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1 by swap-or-not rounds: each pairs x with k - x mod n,
    k drawn for the round, and a hash of the greater of both decides whether they are swapped.
    Every round is its own inverse and works for any n > 0."""
    rounds = F.sequence(F.lit(0), F.lit(_ROUNDS - 1))

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, seed, F.lit(11)), n) - at, n)
        return F.when(F.xxhash64(r, seed, F.greatest(at, other)).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.reverse(rounds) if inverse else rounds, x.cast("long"), step)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(src, source_size, target): words and target of each source.

    Sources in order of code points, null last, have the weights in turn and share the words of
    all; a target stops at `most` times its source's size, and what is over is shared again by
    weight. With sources sorted by most * size / weight, those that stop come first, and the
    level that the others reach is the greatest of the levels that result from stopping the
    first 0, 1, 2, ... of them. The windows are over one row a source."""
    s = sized.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("src", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _quotas(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds what a source's slots need: blocks, length of the last, passes over all blocks, words
    of the last pass, slots, and where the short last block comes in a pass."""
    c = F.col
    s = sources.where("source_size > 0").withColumns({"seed": F.xxhash64(F.lit(seed), "src"), "words": F.least(F.round("target").cast("long"), c("source_size") * 3)})
    s = s.withColumn("nb", F.ceil(c("source_size") / block).cast("long"))
    s = s.withColumns({"last": c("source_size") - (c("nb") - 1) * block, "passes": F.expr("words div source_size"), "rest": F.expr("words % source_size")})
    s = s.withColumn("short_at", permuted(c("nb") - 1, c("nb"), c("seed"), inverse=True))
    picks = F.when(c("rest") <= c("short_at") * block, F.ceil(c("rest") / block)).otherwise(
        F.greatest(c("short_at") + 1, F.ceil((c("rest") + block - c("last")) / block))
    )
    return s.withColumn("slots", c("passes") * c("nb") + F.when(c("rest") > 0, picks).otherwise(0))


def slots(quotas: DataFrame, block: int, shard: int, seed: int) -> DataFrame:
    """(shard, slot, src, pass, block, words): the mix, one row a slot.

    Each slot draws its source with probabilities in proportion to the sources' slots, so the
    counts of a shard are multinomial. Ordinals are counted per shard and then over shards. What
    a source drew beyond its slots is drawn again for those that fell short, so totals are met."""
    spark = quotas.sparkSession
    n = quotas.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    quotas = quotas.withColumn("hi", F.sum("slots").over(Window.orderBy("src"))).withColumn("lo", F.col("hi") - F.col("slots"))
    wide = max(1, -(-n // _CELLS))
    cells = quotas.where("slots > 0").select("src", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {wide}"), F.expr(f"(hi - 1) div {wide}"))).alias("cell"))
    drawn = spark.range(n).select(F.col("id").alias("slot"), F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, n))).alias("u"))
    drawn = drawn.withColumn("cell", F.expr(f"u div {wide}")).join(cells, "cell").where("u >= lo and u < hi").select("shard", "slot", "src")
    drawn = materialise(drawn)
    counts = drawn.groupBy("shard", "src").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    q = quotas.join(got, "src", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    over = F.greatest(F.col("got") - F.col("slots"), F.lit(0))
    q = q.withColumn("over_at", F.sum(over).over(Window.orderBy("src")) - over)
    lack = F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    q = q.withColumn("lack", lack).withColumn("lack_at", F.sum(lack).over(Window.orderBy("src")) - lack)
    shards = counts.select("shard", "src", before.alias("before")).join(q.select("src", F.col("slots").alias("quota"), "over_at"), "src")
    at = F.row_number().over(Window.partitionBy("shard", "src").orderBy("slot")) - 1
    placed = drawn.withColumn("at", at).join(shards, ["shard", "src"]).withColumn("ordinal", F.col("before") + F.col("at"))
    kept = placed.where("ordinal < quota").select("shard", "slot", "src", "ordinal")
    again = placed.where("ordinal >= quota").select("shard", "slot", (F.col("over_at") + F.col("ordinal") - F.col("quota")).alias("k"))
    open_ = q.where("lack > 0").select("src", F.col("got").alias("from"), "lack_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("i"))
    open_ = open_.select((F.col("lack_at") + F.col("i")).alias("k"), "src", (F.col("from") + F.col("i")).alias("ordinal"))
    every = kept.unionByName(again.join(open_, "k").select("shard", "slot", "src", "ordinal"))
    c = F.col
    every = every.join(q.select("src", "seed", "nb", "last", "passes", "rest", "short_at"), "src")
    every = every.withColumns({"pass": F.expr("ordinal div nb"), "at": F.expr("ordinal % nb")}).withColumn("block", permuted(c("at"), c("nb"), c("seed")))
    long = F.when(c("block") == c("nb") - 1, c("last")).otherwise(F.lit(block).cast("long"))
    left = c("rest") - (c("at") * block - F.when(c("short_at") < c("at"), F.lit(block) - c("last")).otherwise(0))
    words = F.when(c("pass") < c("passes"), long).otherwise(F.least(long, F.greatest(left, F.lit(0))))
    return every.select("shard", "slot", "src", "pass", "block", words.alias("words"), (words == long).alias("whole"))


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """The stretch of each block that a document has: a row for each block that it touches."""
    last = F.expr(f"(start + size - 1) div {block}")
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), last))
    p = rows.withColumn("block", F.explode_outer(blocks))
    return p.withColumns(
        {
            "a": F.greatest(F.col("start") - F.col("block") * block, F.lit(0)),
            "z": F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block).cast("long")),
        }
    )


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = 64, shard: int = 16_384, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows, times). rows: `sized` with start (words of the source before), source_size, target
    and passes; times: (src, block, whole, part): how often the mix takes a whole block, and
    of how many first words its one cut slot is, if it has one. sized: a written table of
    key (long), src, source, size."""
    sources = materialise(source_targets(sized, weights))
    quotas = materialise(_quotas(sources, block, seed))
    mix = slots(quotas, block, shard, seed)
    times = mix.groupBy("src", "block").agg(
        F.count_if("whole").alias("whole"), F.coalesce(F.max(F.when(~F.col("whole"), F.col("words"))), F.lit(0)).alias("part")
    )
    times = materialise(times)
    release_shuffles(sized.sparkSession)
    rows = running_total(sized.withColumn("_spread", F.xxhash64("key")), ["src"], ["key", "size"], "size", "start")
    known = sources.join(quotas.select("src", "passes"), "src", "left").withColumn("passes", F.coalesce("passes", F.lit(0)))
    return rows.join(known, "src"), times


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """(key, src, source, size, ...): words of each document; key orders the documents of a source."""
    return docs.select(
        F.xxhash64(id_col, text_col).alias("key"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *more,
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    taken adds up to the rounded target over each source, and no document is taken more than
    three times. Null text has size 0, a null source is one like any other, null and repeated
    ids are carried along; a corpus without words takes nothing; no rows give none; other
    columns are ignored. Results depend on the rows alone, not on how they are spread."""
    sized = materialise(sizes(docs, id_col, text_col, source_col, F.col(id_col).alias("doc_id")))
    block = kw.get("block", 64)
    rows, times = plan(sized, **kw)
    p = _pieces(rows, block).join(times, ["src", "block"], "left")
    taken = F.col("whole") * (F.col("z") - F.col("a")) + F.greatest(F.least("z", "part") - F.col("a"), F.lit(0))
    return (
        p.groupBy("src", "_bucket", "_at")
        .agg(*[F.first(k).alias(k) for k in ("doc_id", "size", "source_size", "target")], F.coalesce(F.sum(taken), F.lit(0)).cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", **kw) -> DataFrame:
    """The mix itself with the columns of `docs`: a document comes whole once for each full pass
    over its source, and once more with the words that the last pass takes of it, cut between
    words; its source's share decides. Documents without words, and those that the mix doesn't
    take, go. length_col, if there, is the new text's length."""
    block = kw.get("block", 64)
    same = Window.partitionBy("key")
    sized = sizes(docs, id_col, text_col, source_col)
    sized = materialise(sized.withColumns({"n": F.row_number().over(same.orderBy("src", "size")), "copies": F.count(F.lit(1)).over(same)}))
    rows, times = plan(sized, **kw)
    p = _pieces(rows, block).join(times, ["src", "block"])
    upto = F.when(F.col("whole") > F.col("passes"), F.col("z")).otherwise(F.least("z", "part"))
    at = F.col("block") * block + F.col("a") - F.col("start")
    seg = F.when(upto > F.col("a"), F.struct(at.alias("at"), (upto - F.col("a")).alias("n")))
    parts = p.groupBy("key", "n").agg(*[F.first(k).alias(k) for k in ("copies", "passes", "size")], F.array_sort(F.collect_list(seg)).alias("segs"))
    src = docs.select(nested(docs), F.xxhash64(id_col, text_col).alias("k"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"), F.col(text_col).alias("text"))
    # repeated rows alone are numbered
    one = src.join(parts.where("copies = 1"), F.col("k") == F.col("key")).select("d", "text", "passes", "size", "segs")
    again = parts.where("copies > 1")
    some = src.join(again.select(F.col("key").alias("again")).distinct(), F.col("k") == F.col("again"), "left_semi")
    long = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    some = some.withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("src", long)))
    more = some.join(again, (F.col("k") == F.col("key")) & (F.col("i") == F.col("n"))).select("d", "text", "passes", "size", "segs")
    joined = one.unionByName(more)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = bound(words, lambda w: F.array_join(F.flatten(F.transform("segs", lambda s: F.slice(w, (s["at"] + 1).cast("int"), s["n"].cast("int")))), ""))
    total = F.aggregate("segs", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    last = F.when(total == F.col("size"), F.array("text")).when(total > 0, F.array(F.ltrim(cut))).otherwise(F.array().cast("array<string>"))
    out = joined.select("d", F.explode(F.concat(F.array_repeat("text", F.col("passes").cast("int")), last)).alias("text"))
    return unnested(out, docs, {text_col: F.col("text"), length_col: F.length("text")})
