"""N-gram Jaccard self-join of documents by a MinHash LSH forest (op 3). DataFrame functions only."""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bound, components, delete, materialise, nested, release_shuffles, skew_safe_lookup, unnested

#: Trees and the values of a signature. Signatures have _GROUP values for each level but the last;
#: a tree takes one of each group, and no two trees share more than one of their first three.
TREES, DEPTH, _BASES, _BLOCK, _GROUP = 64, 4, 8, 32, 32


@lru_cache
def layout(trees: int, depth: int) -> list[tuple[int, ...]]:
    """The positions in the signature that each tree sorts by, level by level."""
    out = []
    for t in range(trees):
        s, i = divmod(t, _GROUP)
        first = [k * _GROUP + (i + k * s) % _GROUP for k in range(max(1, depth - 1))]
        out.append(tuple((first + [(i + 7 + 3 * s) % _GROUP])[:depth]))
    return out


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(ws: Column, n: int) -> Column:
    """64-bit hashes of the runs of n words, from a hash a word; of all words, if there are fewer."""
    run = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    return bound(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: run(h, i)))


def _signature(rows: DataFrame, values: int) -> DataFrame:
    """MinHash values of each key from its exploded grams `g`.

    Value m is the least of hash_m(g) xor c_m. Hashes are random, so each xor orders them at
    random; a few base hashes with many constants each give as many orders, one operation a
    gram; the values of a tree have different base hashes. Tasks reduce the grams of a document
    to one row before the shuffle."""
    r = random.Random(17)
    bases = [f"_h{k}" for k in range(_BASES)]
    rows = rows.select("key", *[F.xxhash64("g", F.lit(k)).alias(b) for k, b in enumerate(bases)])
    base = lambda m: F.col(bases[(m % _GROUP + (0, 3, 5, 6)[m // _GROUP % 4]) % _BASES])
    least = [F.min(base(m).bitwiseXOR(F.lit(r.getrandbits(64) - (1 << 63)))).alias(f"_m{m}") for m in range(values)]
    return rows.groupBy("key").agg(*least).select("key", F.array(*[F.col(f"_m{m}").bitwiseAND(0x7FFFFFFF).cast("int") for m in range(values)]).alias("sig"))


@lru_cache
def chance(j: float, depth: int, trees: int, deepest: int = DEPTH, trials: int = 20_000) -> float:
    """That two sets of Jaccard similarity j share a prefix of that depth in one tree at least, by
    trials, as trees share values."""
    r = random.Random(5)
    wanted = [sum(1 << p for p in positions[:depth]) for positions in layout(trees, deepest)]
    values = 1 + max(p for positions in layout(trees, deepest) for p in positions)
    hits = 0
    for _ in range(trials):
        same = sum(1 << p for p in range(values) if r.random() < j)
        hits += any(same & w == w for w in wanted)
    return hits / trials


def floor_depth(threshold: float, trees: int, depth: int, target: float) -> int:
    """The deepest prefixes at which pairs just at the threshold are found often enough."""
    return next((d for d in range(depth, 1, -1) if chance(threshold, d, trees, depth) >= target), 1)


def _coded(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(anchor, id, size, low, base, delta) of (anchor, id): a set as what it lacks of its anchor's
    set and has beside it. Two sets with deltas from one anchor have low + low - base grams in
    common, and one more for each gram of both deltas."""
    own = members.join(sets.select("id", F.col("grams").alias("own")), "id")
    both = own.join(sets.select(F.col("id").alias("anchor"), F.col("grams").alias("all")), "anchor")
    both = both.select("anchor", "id", F.size("own").alias("size"), F.size("all").alias("base"), F.array_except("all", "own").alias("less"), F.array_except("own", "all").alias("more"))
    return both.select("anchor", "id", "size", (F.col("base") - F.size("less")).alias("low"), "base", F.concat("less", "more").alias("delta"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose exact Jaccard similarity reaches the threshold.

    Documents near each other are put into blocks of 32 by their least partner, so that a set is
    sent once for each block that it meets and not once a pair. There a set is its difference
    from that partner's: the parts that near copies all have are compared once a document, not
    once a pair, and a pair whose differences can't undo the link isn't compared at all."""
    spark = pairs.sparkSession
    least = pairs.groupBy("b").agg(F.min("a").alias("anchor")).withColumnRenamed("b", "id")
    ids = pairs.select(F.col("a").alias("id")).distinct().join(least, "id", "left")
    ids = ids.select("id", F.coalesce("anchor", "id").alias("anchor"))
    # a block: the ids of an anchor that fall into one of its hash buckets of about 32
    many = ids.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.join(many, "anchor").withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / _BLOCK)))
    ids = materialise(ids.select("id", "anchor", "part"))
    lists = materialise(pairs.join(ids, pairs["a"] == ids["id"]).groupBy("anchor", "part", "b").agg(F.collect_list("a").alias("with")))
    coded = materialise(_coded(ids.select("anchor", "id").union(lists.select("anchor", "b")).distinct(), sets))
    release_shuffles(spark)
    packed = ids.join(coded, ["anchor", "id"]).groupBy("anchor", "part").agg(F.collect_list(F.struct("id", "size", "low", "delta")).alias("block"))
    rows = lists.join(coded.withColumnRenamed("id", "b"), ["anchor", "b"]).join(packed, ["anchor", "part"])
    rows = rows.withColumn("block", F.filter("block", lambda x: F.array_contains("with", x["id"])))
    # a row a pair, as generated code intersects arrays of numbers faster than lambdas do
    met = rows.select("b", "size", "low", "base", "delta", F.explode("block").alias("x"))
    both = F.col("size") + F.col("x.size")
    about = F.floor(both * (threshold / (1 + threshold))).cast("int")
    reaches = lambda common: common / (both - common) >= threshold
    need = F.when(reaches(about), about).when(reaches(about + 1), about + 1).otherwise(about + 2)
    need = need - (F.col("low") + F.col("x.low") - F.col("base"))  # of grams that both deltas have
    most = F.col("base") - F.greatest("low", "x.low") + F.least(F.col("size") - F.col("low"), F.col("x.size") - F.col("x.low"))
    found = met.where((need <= 0) | ((need <= most) & (F.size(F.array_intersect("x.delta", "delta")) >= need))).select(F.col("x.id").alias("a"), "b")
    found = materialise(found)
    for used in (ids, lists, coded):
        delete(used, spark)
    return found


def _united(links: DataFrame, ends: DataFrame) -> DataFrame:
    """components of the links; ends: (id, least), the least text linked with each. Families of near
    copies have links by the square of their size, but few pairs of least texts."""
    up = ends.select("id", F.least("id", "least").alias("up"))
    a, b = up.select(F.col("id").alias("a"), F.col("up").alias("ua")), up.select(F.col("id").alias("b"), F.col("up").alias("ub"))
    across = links.join(a, "a").join(b, "b").where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct()
    return components(across.unionAll(up.select(F.col("id").alias("a"), F.col("up").alias("b"))))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.5, target: float = 0.97, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, key, class_id, n_links) of every row.

    Texts are compared as runs of letters and digits in lower case; equal ones are one text, of
    class key `key`. Different texts are linked if the Jaccard similarity of their sets of
    n-word grams reaches `threshold`; n_links counts the links of a document's text, and class_id
    is the least id over the connected texts.

    The forest: each tree orders the texts by `depth` MinHash values of their signatures, and a
    text's partners are those that share a prefix, shortened down to the depth at which even
    pairs just at the threshold have the chance `target` to be found. An estimate over all links
    can't end this earlier: a large group of near copies has nearly all links, and they are found
    at once. So all prefixes shorten that far, and are joined once at that depth: who shares a
    longer one shares it too. No pair is dropped for the size of its group; verification is exact.

    Null texts and texts without a letter or digit are compared with nothing: class_id is their
    own id. Null and repeated ids are carried along; no rows give none; other columns are ignored."""
    spark = docs.sparkSession
    ws = words(F.col(text_col))
    key = F.when(F.size(ws) > 0, F.unhex(F.md5(F.array_join(ws, " ").cast("binary"))))
    keys = materialise(docs.select(F.col(id_col).alias("doc_id"), key.alias("key")))
    texts = keys.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # the key is computed below the explode, once a document
    exploded = docs.select(key.alias("key"), ws.alias("ws")).where("key is not null").select("key", F.explode(grams(F.col("ws"), n)).alias("g"))
    values = 1 + max(p for positions in layout(trees, depth) for p in positions)
    sigs = materialise(_signature(exploded, values).join(texts, "key").withColumn("id", F.monotonically_increasing_id()))
    release_shuffles(spark)

    low = floor_depth(threshold, trees, depth, target)
    node = lambda t, at: F.xxhash64(F.lit(t), *[F.col("sig")[p] for p in at[:low]])
    nodes = sigs.select("id", F.explode(F.array(*[node(t, at) for t, at in enumerate(layout(trees, depth))])).alias("p"))
    company = nodes.groupBy("p").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("p")
    # hashed, not sorted: most prefixes have no company and only pass by
    nodes = materialise(nodes.join(company.hint("shuffle_hash"), "p"))
    near = nodes.select("id").distinct().join(sigs.select("id", "key", "rep"), "id")
    src = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    mine = src.join(near, (src["key"] == near["key"]) & src["doc_id"].eqNullSafe(near["rep"])).select("id", "text")
    sets = materialise(mine.groupBy("id").agg(F.any_value("text").alias("text")).select("id", F.array_distinct(grams(words(F.col("text")), n)).alias("grams")))
    release_shuffles(spark)

    a, b = nodes.select(F.col("id").alias("a"), "p"), nodes.select(F.col("id").alias("b"), "p")
    pairs = materialise(a.join(b, "p").where("a < b").select("a", "b").distinct())
    release_shuffles(spark)
    links = _verified(pairs, sets, threshold)
    release_shuffles(spark)
    for used in (sets, nodes, pairs):
        delete(used, spark)

    each = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("of")), F.struct(F.col("b").alias("id"), F.col("a").alias("of")))).alias("e"))
    ends = materialise(each.groupBy(F.col("e.id").alias("id")).agg(F.count(F.lit(1)).alias("n_links"), F.min("e.of").alias("least")))
    roots = _united(links, ends)
    ends = ends.select("id", "n_links")
    tree = roots.join(sigs.select("id", "rep"), roots["node"] == sigs["id"])
    least = tree.groupBy("root").agg(F.min("rep").alias("least"))
    of_id = roots.join(least, "root").select(F.col("node").alias("id"), "least")
    known = sigs.select("id", "key", "rep", "n").join(of_id, "id", "left").join(ends, "id", "left")
    known = known.select("key", "n", F.coalesce("least", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    known = materialise(known)
    out = skew_safe_lookup(keys.where("key is not null"), known, "key", "n").select("doc_id", "key", "class_id", "n_links")
    rest = keys.where("key is null").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(rest)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One document of each class, that with the least id, with the columns of `docs`; a row of it,
    if it is repeated. Documents without a letter or digit stay."""
    got = classes(docs, id_col, text_col, **kw)
    stay = materialise(got.where(F.col("key").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")))
    ws = words(F.col(text_col))
    key = F.when(F.size(ws) > 0, F.unhex(F.md5(F.array_join(ws, " ").cast("binary"))))
    src = docs.select(nested(docs), key.alias("k"), F.col(id_col).alias("id"))
    kept = src.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("k").eqNullSafe(F.col("key")))
    once = kept.where(F.col("n").eqNullSafe(1) | F.col("k").isNull()).select("d")
    many = kept.where((F.col("n") > 1) & F.col("k").isNotNull()).dropDuplicates(["id", "k"]).select("d")
    return unnested(once.unionByName(many), docs, {})
