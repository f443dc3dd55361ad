"""Vectors of words whose number the driver's memory needn't hold (ML-11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of one shard, words whose changes are added up before they count, and words drawn for them.
SHARD, BATCH, DRAWN = 3_000_000, 256, 48
RATE, NEGATIVE = 0.025, 5


def start(words: list[str], dims: int, seed: int) -> np.ndarray:
    """The vectors that training starts from: noise that depends on the word alone, so that all shards
    start from the same."""
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    out = np.empty((len(words), dims), np.float32)
    with np.errstate(over="ignore"):
        for k in range(dims):
            z = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out[:, k] = ((z ^ (z >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
    return (out - np.float32(0.5)) / np.float32(dims)


def _add(to: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """to[ids] += rows, where ids repeat."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    to[ids[first]] += np.add.reduceat(rows[order], first, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(codes: np.ndarray, texts: np.ndarray, vectors: np.ndarray, window: int, seed: int) -> None:
    """Train `vectors` in place on the words `codes` of the texts numbered in `texts`: the mean of a
    word's neighbours, at most a random reach up to `window` away, tells it from drawn words (CBOW
    with negative samples, drawn by frequency to the power 0.75; the rate falls to 0)."""
    n, dims = len(codes), vectors.shape[1]
    rng = np.random.default_rng(seed)
    share = np.bincount(codes, minlength=len(vectors)) ** 0.75
    bounds = np.cumsum(share / share.sum())
    bounds[-1] = 1.0
    out = np.zeros_like(vectors)
    codes = np.pad(codes, window)
    texts = np.pad(texts, window, constant_values=-1)
    batch = max(1, min(BATCH, n // 64))  # a short shard takes steps too
    full = np.zeros((batch, batch + 2 * window), np.float32)
    for a in range(0, n, batch):
        size = min(batch, n - a)
        rate = np.float32(RATE * max(1e-4, 1 - a / n))
        ids, of = codes[a : a + size + 2 * window], texts[a : a + size + 2 * window]
        mine, at = ids[window : window + size], of[window : window + size]
        reach = rng.integers(1, window + 1, size)
        near, row = full[:size, : size + 2 * window], np.arange(size)
        for s in range(1, window + 1):
            near[row, row + window - s] = (of[window - s : window - s + size] == at) & (reach >= s)
            near[row, row + window + s] = (of[window + s : window + s + size] == at) & (reach >= s)
        number = near.sum(1, keepdims=True)
        mean = near @ vectors[ids] / np.maximum(number, 1)
        seen = out[mine]
        drawn = np.searchsorted(bounds, rng.random(DRAWN))
        other = out[drawn]
        up = rate * (1 - _sigmoid(np.einsum("ij,ij->i", mean, seen)))[:, None] * (number > 0)
        down = -rate * np.float32(NEGATIVE / DRAWN) * _sigmoid(mean @ other.T) * (drawn != mine[:, None]) * (number > 0)
        change = up * seen + down @ other
        _add(out, np.concatenate((mine, drawn)), np.concatenate((up * mean, down.T @ mean)))
        _add(vectors, ids, near.T @ change)
        near[row[:, None], row[:, None] + np.arange(2 * window + 1)] = 0


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.Array]]:
    """Lists of words in shards of about `most` words; a text is never parted."""
    held: list[pa.Array] = []
    n = 0
    for b in batches:
        lists = b.column(0)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        k = 0
        while k < len(lists):
            before = ends[k - 1] if k else 0
            to = min(len(lists), int(np.searchsorted(ends, before + most - n)) + 1)
            held.append(lists.slice(k, to - k))
            n += int(ends[to - 1] - before)
            k = to
            if n >= most:
                yield held
                held, n = [], 0
    if n:
        yield held


def _rows(values: pa.Array, dims: int) -> np.ndarray:
    """Binary values as rows of numbers."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float16).reshape(len(values), dims).astype(np.float32)


def _frequent(docs: DataFrame, least: int) -> DataFrame:
    """Lists of words without those that occur less than `least` times."""
    x = docs.withColumn("_d", F.monotonically_increasing_id()).select("_d", F.posexplode("_words").alias("k", "word"))
    often = x.groupBy("word").count().where(F.col("count") >= least).select("word")
    x = x.join(often, "word").groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"))
    return x.select(F.transform("w", lambda e: e["word"]).alias("_words"))


def fit(words: Column, docs: DataFrame, dims: int = 100, window: int = 5, least: int = 1, seed: int = 1, shard: int = SHARD) -> DataFrame:
    """(word, vector) of all words in the lists `words` that occur `least` times or more.

    Each shard is trained alone from the same start, in memory bounded by its words; a word's changes
    are averaged over the shards that have it. Nothing of the vocabulary is on the driver. Changes
    travel in half precision, which keeps 11 bits of each."""
    lists = docs.select(words.alias("_words"))
    if least > 1:
        lists = _frequent(lists, least)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _shards(batches, shard):
            length = np.concatenate([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in held])
            coded = pa.concat_arrays([c.flatten() for c in held]).dictionary_encode()
            held.clear()
            vocabulary = coded.dictionary
            vectors = start(vocabulary.to_pylist(), dims, seed)
            train(coded.indices.to_numpy(), np.repeat(np.arange(len(length), dtype=np.int32), length), vectors, window, seed)
            for k in range(0, len(vocabulary), 10_000):
                some = vocabulary.slice(k, 10_000)
                change = (vectors[k : k + 10_000] - start(some.to_pylist(), dims, seed)).astype(np.float16)
                offsets = np.arange(0, len(some) + 1, dtype=np.int32) * (2 * dims)
                change = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(change)])
                yield pa.RecordBatch.from_arrays([some, change], ["word", "change"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by word; the last word of a batch may go on in the next."""

        def out(w: list[str], sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            vectors = (start(w, dims, seed) + sums / n[:, None]).astype(np.float32)
            flat = pa.ListArray.from_arrays(np.arange(0, len(w) + 1, dtype=np.int32) * dims, pa.array(vectors.ravel()))
            return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), flat], ["word", "vector"])

        word, total, n = None, np.zeros(dims, np.float32), 0
        for b in batches:
            if not b.num_rows:
                continue
            w, rows = b.column(0), _rows(b.column(1), dims)
            fresh = pc.not_equal(w.slice(1), w.slice(0, len(w) - 1)).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], fresh)))
            sums, counts = np.add.reduceat(rows, first, axis=0), np.diff(np.append(first, len(w)))
            names = w.take(pa.array(first)).to_pylist()
            if names[0] == word:
                sums[0] += total
                counts[0] += n
            elif word is not None:
                yield out([word], total[None], np.array([n]))
            word, total, n = names[-1], sums[-1].copy(), int(counts[-1])
            if len(names) > 1:
                yield out(names[:-1], sums[:-1], counts[:-1])
        if word is not None:
            yield out([word], total[None], np.array([n]))

    parts = lists.mapInArrow(part, "word string, change binary").repartition("word").sortWithinPartitions("word")
    return parts.mapInArrow(mean, "word string, vector array<float>")
