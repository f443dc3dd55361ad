"""Packing documents into windows of a fixed length by Karmarkar-Karp differencing (op 4)."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagewright.llm.tokens import encoder, slices


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Splits items into k sets of near-equal sums by multiway differencing.

    Each item starts as a partial partition (its size and k-1 zeros). The two partitions with
    the widest spread are merged again and again, the largest sums of one with the smallest of
    the other, until one is left. Returns the items of each set; k >= 1; ties go to the item
    or partition that came first."""
    if not sizes:
        return [[] for _ in range(k)]
    # members are numbers of items, and beyond those of pairs of members; -1 is none
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    pairs: list[tuple[int, int]] = []
    for i, s in enumerate(sizes):
        sums, members = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[0], members[0] = s, i
        heap.append((-s if k > 1 else 0, i, sums, members))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, am = heapq.heappop(heap)
        _, _, b, bm = heap[0]
        sums, bm = a + b[::-1], bm[::-1]
        members = np.maximum(am, bm)
        both = np.flatnonzero(np.minimum(am, bm) >= 0)
        if len(both):
            new = len(sizes) + len(pairs)
            pairs += zip(am[both].tolist(), bm[both].tolist())
            members[both] = np.arange(new, new + len(both))
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heapreplace(heap, (-int(sums[0]), made, sums, members[order]))
        made += 1
    out = []
    for m in heap[0][3].tolist():
        items, stack = [], [m]
        while stack:
            x = stack.pop()
            if x >= len(sizes):
                stack += pairs[x - len(sizes)]
            elif x >= 0:
                items.append(x)
        out.append(sorted(items))
    return out


def windows(sizes: list[int], capacity: int, piece: int = 256) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) pieces with sums of at most `capacity`; sizes are positive.

    Items are cut into pieces of at most `piece`, alike in size, so that there are enough of them
    in a window for Karmarkar-Karp differencing to make near-equal windows. Their count starts
    at the least that could do and rises for as long as a window exceeds the capacity."""
    parts = []
    for i, n in enumerate(sizes):
        k = -(-n // min(piece, capacity))
        cuts = [n * j // k for j in range(k + 1)]
        parts += [(i, a, z - a) for a, z in zip(cuts, cuts[1:])]
    lengths = [n for _, _, n in parts]
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        sets = difference(lengths, k)
        if max(sum(lengths[x] for x in s) for s in sets) <= capacity:
            break
        k += 1
    out = []
    for s in sets:
        joined: list[tuple[int, int, int]] = []
        for i, a, n in sorted(parts[x] for x in s):
            if joined and joined[-1][0] == i and sum(joined[-1][1:]) == a:  # neighbours met again
                joined[-1] = (i, joined[-1][1], joined[-1][2] + n)
            else:
                joined.append((i, a, n))
        out.append(joined)
    return [s for s in out if s]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, group: int = 256, with_ids: bool = False) -> DataFrame:
    """Pieces of documents, placed in sequences of at most `capacity` ids.

    A document is the ids of its whole text and `end_id`. Stretches of `capacity` ids are
    sequences of their own; the rests are packed, `group` at a time in the order in which a task
    reads them, by `windows`. There is no shuffle: a task packs what it reads, holding the ids of
    one group; groups only bound what a task holds, as any number of them leaves little room. sequence_id has the task's number in its upper bits, so reruns over the same
    files agree.

    Null texts are empty: one piece with `end_id` alone. Null and repeated ids of any type are carried
    along. No rows give no pieces. Other columns are ignored. with_ids adds the piece's ids."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        base, made = TaskContext.get().partitionId() << 36, 0
        key_type: pa.DataType | None = None
        rests: list[tuple] = []  # (key, start, ids, doc_tokens)

        def emit(pieces: list[tuple]) -> pa.RecordBatch:
            keys, start, ids, total, seq, off = zip(*pieces)
            cols = [
                pa.array(keys, key_type),
                pa.array(start, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                pa.array(total, pa.int64()),
                pa.array(seq, pa.int64()),
                pa.array(off, pa.int64()),
            ]
            if with_ids:
                cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(cols, schema.names)

        def place() -> list[tuple]:
            nonlocal made
            out = []
            for s in windows([len(r[2]) for r in rests], capacity):
                off = 0
                for i, at, n in s:
                    key, start, ids, total = rests[i]
                    out.append((key, start + at, ids[at : at + n], total, base + made, off))
                    off += n
                made += 1
            rests.clear()
            return out

        for batch in batches:
            key_type = batch.column(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts, 1 << 20):
                done: list[tuple] = []
                for key, ids in zip(keys[a:b], enc.encode(texts.slice(a, b - a))):
                    ids = np.append(ids, np.uint16(end_id))
                    n = len(ids)
                    for at in range(0, n - n % capacity, capacity):
                        done.append((key, at, ids[at : at + capacity], n, base + made, 0))
                        made += 1
                    if n % capacity:
                        rests.append((key, n - n % capacity, ids[n - n % capacity :].copy(), n))
                    if len(rests) >= group:
                        done += place()
                if done:
                    yield emit(done)
                pa.default_memory_pool().release_unused()  # else it stays beside what the encoder remembers
        if rests:
            yield emit(place())

    return docs.select(id_col, text_col).mapInArrow(run, schema)
