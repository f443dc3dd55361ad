"""Embeddings behind one interface; no model is at hand, so words are hashed (ML-01, ML-02, ML-11, ML-12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.config import QUERY_PREFIX
from pagewright.functions.clean import tokens
from pagewright.operators.word2vec import fit


def hashing(dims: int = 64, grams: int | None = None) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors of hashed words, or of their character n-grams."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for i, t in enumerate(texts):
            words = t.lower().split()
            if grams:
                words = [f"<{w}>"[k : k + grams] for w in words for k in range(max(1, len(w) + 3 - grams))]
            for w in words:
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dims] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return embed


def embed_passages(chunks: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]] = hashing, text_col: str = "text", batch: int = 32) -> DataFrame:
    """Adds `embedding`. `model` makes the embedder once a worker's iterator; batches are Arrow's."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = model()
        for s in parts:
            texts = s.fillna("").tolist()
            yield pd.Series([v.tolist() for k in range(0, len(texts), batch) for v in f(texts[k : k + batch])])

    return chunks.withColumn("embedding", run(F.col(text_col)))


def embed_queries(queries: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]] = hashing, text_col: str = "question") -> DataFrame:
    """Adds `q`; the question is embedded behind the instruction that the model expects."""
    x = queries.withColumn("_t", F.concat(F.lit(QUERY_PREFIX), F.col(text_col)))
    return embed_passages(x, model, "_t").withColumnRenamed("embedding", "q").drop("_t")


def word2vec(docs: DataFrame, text_col: str = "text", dims: int = 100, window: int = 5, least: int = 1) -> DataFrame:
    """ML-11: (word, vector) of all words."""
    return fit(tokens(F.col(text_col), True), docs, dims, window, least, seed=1)
