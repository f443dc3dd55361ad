"""What only shows on larger or odd tables."""

import numpy as np
from pyspark.sql import functions as F


def test_word2vec_in_shards(spark):
    """a distributed table of words, each of which many shards may have; nothing on the driver."""
    from pagewright.operators import embed, word2vec

    texts = [" ".join(["red", "blue", "green"][k % 3 :] + ["one", "two", "three"][: k % 3 + 1] + [f"only{k}"]) for k in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts] + [("",)], "text string").repartition(3)
    got = embed.word2vec(docs)
    assert got.columns == ["word", "vector"]
    vectors = {r.word: r.vector for r in got.collect()}
    assert set(vectors) == {w for t in texts for w in t.split()} and got.count() == len(vectors)
    assert all(len(v) == 100 and np.isfinite(v).all() for v in vectors.values())
    words = F.split("text", " ")
    several = word2vec.fit(words, docs.where("text <> ''"), dims=8, least=2, shard=40)
    rows = several.collect()
    assert sorted(r.word for r in rows) == ["blue", "green", "one", "red", "three", "two"]
    # vectors are trained, not what they start from, and the mean of the shards
    began = word2vec.start([r.word for r in rows], 8, 1)
    assert all(np.abs(np.array(r.vector) - s).max() > 1e-6 for r, s in zip(rows, began))


def test_word2vec_tells_neighbours_apart():
    from pagewright.operators import word2vec

    rng = np.random.default_rng(0)
    groups = [list(range(0, 10)), list(range(10, 20))]
    codes = np.concatenate([rng.choice(groups[k % 2], 20) for k in range(4000)]).astype(np.int32)
    vectors = word2vec.start([f"w{k}" for k in range(20)], 20, 1)
    word2vec.train(codes, np.repeat(np.arange(4000, dtype=np.int32), 20), vectors, 5, 1)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    like = unit @ unit.T
    assert like[:10, :10].mean() > like[:10, 10:].mean() + 0.3


def test_bm25_ties_by_nine_digits(spark, monkeypatch):
    """F5 to F9: equal texts get scores that differ in the last bits, by the order of addition."""
    from pagewright.operators import retrieval as R

    scored = spark.createDataFrame([(7, 1, 0.3), (7, 2, 0.1 + 0.2), (7, 3, 0.5)], "query_id long, chunk_id long, score double")
    monkeypatch.setattr(R, "bm25_scores", lambda *a: scored)
    chunks = spark.createDataFrame([(k, "a") for k in range(5)], "chunk_id long, text string")
    queries = spark.createDataFrame([(7, "a")], "query_id long, question string")
    assert [r.chunk_id for r in R.bm25(chunks, queries, 4).orderBy("rank").collect()] == [3, 1, 2, 0]
    assert [r.chunk_id for r in R.bm25(chunks, queries, 2).orderBy("rank").collect()] == [3, 1]


def test_corpus_stats_count_a_chunk_once(spark):
    from pagewright.operators import retrieval as R

    chunks = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "")], "chunk_id long, text string")
    _, totals, df = R.corpus_stats(chunks)
    assert {r.term: r.df for r in df.collect()} == {"a": 2, "b": 1, "c": 1} and totals.first().n == 3
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1  # no shuffle by chunk and term


def test_one_large_section(spark):
    """a section of many paragraphs is packed in one pass, not gathered in a row."""
    import time

    from pagewright.operators import chunks as CH
    from tests.test_golden import greedy

    n = 30_000
    text = F.concat(F.lit("Paragraph "), F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("word "), (F.col("id") * 7 % 90).cast("int")), F.lit("end."))
    df = spark.range(n).select(F.lit("c").alias("company"), F.col("id").alias("ord"), text.alias("text"), (F.col("id") / 10).cast("int").alias("page_index"))
    began = time.time()
    got = CH.text_chunks(df, ["company"]).orderBy("chunk_seq").collect()
    assert time.time() - began < 60
    assert [r.text for r in got] == greedy([f"Paragraph {k} " + "word " * (k * 7 % 90) + "end." for k in range(n)])
    assert [r.chunk_seq for r in got] == list(range(len(got))) and got[-1].page_numbers[-1] == (n - 1) // 10


def test_recursive_chunks_leave_in_slices(spark):
    """a worker holds a slice of rows, not all chunks of a batch of texts."""
    from pagewright.operators import chunks as CH

    texts = ["", None, "a" * 3000, " ".join(f"w{k}" for k in range(2000))] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = CH.recursive_chunks(df, ["doc_id"])
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in out.orderBy("doc_id", "chunk_no").collect():
        assert r.chunk_name == f"chunk_{r.chunk_no:03d}"
        got.setdefault(r.doc_id, []).append(r.text)
    assert got == {k: CH.split_recursive(t, 1200, 200) for k, t in enumerate(texts) if t}


def test_pages_numbered_in_blocks(spark, tmp_path):
    """F12 and others: page numbers of a source don't come from one sort of its texts."""
    from pagewright.plans import views as V

    rows = [(k * 7 % 4001 - 1500, f"t{k}", None if k % 5 == 0 else f"s{k % 2}", "en", 2) for k in range(4001)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = V.docs(spark, str(tmp_path))
    want = {}
    for source in {r[2] for r in rows}:
        want |= {i: k for k, i in enumerate(sorted(r[0] for r in rows if r[2] == source), 1)}
    assert {r.doc_id: r.page_index for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("text" not in line for line in plan.split("\n") if "Window" in line and "source" in line and "row_number" in line and "_b" not in line)


def test_pages_of_tables_in_slices(spark, monkeypatch):
    """a worker makes objects of a slice of pages; unknown places and boxes survive."""
    import pyarrow as pa

    from pagewright.operators import tables

    cell = pa.struct([("text", pa.string()), ("x", pa.float64()), ("bold", pa.bool_())])
    line = pa.struct([("line_index", pa.int32()), ("y", pa.float64()), ("cells", pa.list_(cell)), ("box", pa.list_(pa.float64()))])
    one = {"text": "a", "x": 1.0, "bold": True}
    lines = [[{"line_index": 0, "y": None, "cells": [one], "box": None}], [], [{"line_index": 0, "y": 2.0, "cells": [], "box": [1.0, 2.0, 3.0, 4.0]}, {"line_index": 1, "y": 3.0, "cells": [one, one], "box": None}]]
    b = pa.RecordBatch.from_arrays([pa.array(["c"] * 3), pa.array(["f"] * 3), pa.array([1, 2, 3], pa.int32()), pa.array([None, 7, 8], pa.int32()), pa.array(lines, pa.list_(line))], ["company", "file_name", "page_index", "page_number", "lines"])
    plain = [[{k: v for k, v in x.items() if k != "line_index"} for x in page] for page in lines]
    assert [list(p) for p in tables._pages(b)] == [["c", "f", k + 1, n, p] for k, (n, p) in enumerate(zip((None, 7, 8), plain))]
    assert [list(p)[-1] for p in tables._pages(b.slice(1))] == plain[1:]
    # the same tables whatever the slice
    cells = F.expr("array(named_struct('text', concat('r', id), 'x', 72D, 'bold', false), named_struct('text', cast(id as string), 'x', 300D, 'bold', false))")
    rows = spark.range(3000).select(F.lit("c").alias("company"), F.lit("f").alias("file_name"), (F.col("id") / 3).cast("int").alias("page_index"), (F.col("id") % 3).alias("line_index"), (F.col("id") % 3 * 12.0).alias("y"), cells.alias("cells"))
    got = tables.parse(rows)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString() and got.count() == 1000
    assert got.where("page_index = 5").first().rows[2].cells[1].text == "17"
