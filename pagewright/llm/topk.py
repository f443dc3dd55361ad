"""Exact top-k inner products by an impact-ordered index, score at a time (op 6)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import bucket_count, materialise, release_shuffles

LEVELS, BATCHES = 24, 8


def scaled(vector: Column, scale: int = 1024) -> Column:
    """scale * x of each component, x as double, of which the floor is the quantised component;
    null for a vector that is null or has a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(x, lambda v: v * scale))


class Index:
    """Posting segments of a block of vectors: for each dimension, the rows sorted by component
    and cut into LEVELS stretches of quantised impact."""

    def __init__(self, m: np.ndarray):
        self.m = m
        n, dims = m.shape
        self.order = np.argsort(m, axis=0, kind="stable").T.copy()
        self.cuts = np.unique(np.linspace(0, n, min(LEVELS, n) + 1).astype(np.int64))
        self.level = np.empty((dims, n), dtype=np.uint8)  # segment of each row
        np.put_along_axis(self.level, self.order, np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts)).astype(np.uint8)[None, :], 1)
        self.lo = np.take_along_axis(m.T, self.order[:, self.cuts[:-1]], 1)  # least of each segment
        self.hi = np.take_along_axis(m.T, self.order[:, self.cuts[1:] - 1], 1)

    def search(self, q: np.ndarray, k: int, skip: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows outside `skip`, by score and then by key.

        A segment's impact is the most that it can add to a score above the least possible in its
        dimension. Segments are processed by falling impact, in batches; what a row has
        collected is a lower bound, and the impacts still open are the most that any dimension
        can add, so what they leave possible is an upper bound. The search stops once all rows
        but the possible members are proven to be below the k-th lower bound; these are scored
        exactly."""
        n, dims = self.m.shape
        if n <= 4 * k or not dims:  # nothing to gain from an index
            rows = np.delete(np.arange(n), skip)
            score = self.m[rows] @ q
            best = np.lexsort((keys[rows], -score))[:k]
            return rows[best], score[best]
        a, b = q[:, None] * self.lo, q[:, None] * self.hi
        base = np.minimum(a, b).min(1)  # least contribution of each dimension
        most, least = np.maximum(a, b) - base[:, None], np.minimum(a, b) - base[:, None]
        order = np.argsort(-most, axis=None, kind="stable")
        acc, gap = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        alive = np.ones(n, dtype=bool)
        alive[skip] = False
        want = min(k, int(alive.sum()))
        if not want:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        segments, width = most.shape[1], np.diff(self.cuts)
        done = np.zeros_like(most, dtype=bool)
        parts = np.array_split(order, min(BATCHES, len(order)))
        for turn, part in enumerate(parts):
            d, j = np.divmod(part, segments)
            rows = np.concatenate([self.order[x, self.cuts[y] : self.cuts[y + 1]] for x, y in zip(d.tolist(), j.tolist())])
            np.add.at(acc, rows, np.repeat(least[d, j], width[j]))
            np.add.at(gap, rows, np.repeat(most[d, j] - least[d, j], width[j]))
            done[d, j] = True
            if turn < len(parts) // 2 and turn + 1 < len(parts):
                continue  # too early for a proof, which costs as much as a batch
            # next open impact of each dimension; less of it for rows that were met there
            open_ = np.where(done, 0, most).max(1)
            left = np.full(n, open_.sum(), dtype=np.int64)
            for x in np.flatnonzero(open_):
                left -= (done[x] * open_[x])[self.level[x]]
            some = acc[alive]
            low = np.partition(some, len(some) - want)[len(some) - want]
            member = alive & (acc + gap + left >= low)
            if member.sum() <= max(4 * want, n // 8):
                break
        rows = np.flatnonzero(member)
        score = self.m[rows] @ q
        best = np.lexsort((keys[rows], -score))[:k]
        return rows[best], score[best]


def exact(m: np.ndarray, q: np.ndarray, k: int, skip: np.ndarray, keys: np.ndarray) -> list[tuple[int, int]]:
    """(row, score) of the k best rows in Python's unbounded integers, for components whose
    products may not fit 64 bits. m and q: whole numbers as doubles."""
    want = [int(x) for x in q]
    scores = [(-sum(int(x) * y for x, y in zip(row, want)), int(keys[i]), i) for i, row in enumerate(m.tolist())]
    gone = set(skip.tolist())
    return [(i, -s) for s, _, i in heapq.nsmallest(k, (x for x in scores if x[2] not in gone))]


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, block: int = 8192, chunk: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k other
    rows with the highest integer inner product of the quantised vectors, ties to smaller ids.

    Rows are put into blocks of about `block` by hash, and queries into chunks; a task answers
    the queries of a chunk from one block's index, so neither is held whole anywhere, and k rows
    a query and block are merged. Vectors that are null or have null or non-finite components
    take no part, nor do rows without an id; shorter vectors count as filled with zeros. Blocks
    with components so large that sums might not fit 64 bits are scored in unbounded integers;
    a score of the result that doesn't fit is an error. A
    repeated id is a row of its own on either side, and each query row gets its own ranks. No
    rows give none; other columns are ignored."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("v")).where("vec_id is not null and v is not null")
    v = materialise(v.withColumn("rid", F.monotonically_increasing_id()))
    n = v.count()
    blocks, chunks = bucket_count(n, block), bucket_count(v.where(F.col("vec_id") % every == 0).count(), chunk)
    side = v.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
    asked = v.where(F.col("vec_id") % every == 0).withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(chunks)).cast("int"))
    per_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    per_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = side.withColumn("chunk", per_chunk).withColumn("query", F.lit(False)).unionByName(
        asked.withColumn("block", per_block).withColumn("query", F.lit(True))
    )
    rows = rows.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "query")

    def answers(held: list[tuple]) -> list[tuple]:
        data, ask = [r for r in held if not r[3]], [r for r in held if r[3]]
        if not data or not ask:
            return []
        dims = max(len(r[1]) for r in held)
        filled = lambda rows: np.array([np.append(np.floor(r[1]), np.zeros(dims - len(r[1]))) for r in rows]).reshape(len(rows), dims)
        m, asked = filled(data), filled(ask)
        keys, rids = np.array([r[0] for r in data]), np.array([r[2] for r in data])
        most = lambda x: float(np.abs(x).max(initial=0.0))
        fits = most(m) < 2**52 and most(asked) < 2**52 and 4 * dims * (most(m) + 1) * (most(asked) + 1) < 2**62
        index, out = Index(m.astype(np.int64)) if fits else None, []
        for (key, _, rid, _), q in zip(ask, asked):
            own = np.flatnonzero(rids == rid)
            if index:
                at, score = index.search(q.astype(np.int64), k, own, keys)
                best = [(int(i), int(s)) for i, s in zip(at, score)]
            else:
                best = exact(m, q, k, own, keys)
            out += [(rid, key, int(keys[i]), s) for i, s in best]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def flush() -> Iterator[pa.RecordBatch]:
            if got := answers(held):
                if max(abs(x[3]) for x in got) >> 63:
                    raise OverflowError("an inner product doesn't fit 64 bits")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["rid", "query_id", "vec_id", "score"])

        for batch in batches:
            c = {x: batch.column(i) for i, x in enumerate(batch.schema.names)}
            vals, offs = c["v"].values.to_numpy(), c["v"].offsets.to_numpy()
            for i, (b, ch, key, rid, query) in enumerate(zip(*(c[x].to_pylist() for x in ("block", "chunk", "vec_id", "rid", "query")))):
                if at != (b, ch):
                    yield from flush()
                    held, at = [], (b, ch)
                held.append((key, vals[offs[i] : offs[i + 1]], rid, query))
        yield from flush()

    part = rows.select("block", "chunk", "vec_id", "rid", "query", "v").mapInArrow(run, "rid long, query_id long, vec_id long, score long")
    part = materialise(part)
    release_shuffles(spark)
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
