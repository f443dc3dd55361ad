"""Files of token ids: frequency-ranked ids in a byte-aligned code with separate control bytes (op 5)."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import delete, materialise, release_shuffles, shared_dir
from pagewright.llm.tokens import encoder, slices

MAGIC = b"PWIDS001"
_HEAD = struct.Struct("<8sQQQ")  # magic, documents, ids, data bytes
#: Bytes of each of the four numbers that a control byte describes, two bits each.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)
_MASK = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def encode_numbers(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of uint32 numbers: 1 to 4 bytes each, little-endian."""
    v = np.ascontiguousarray(values, dtype="<u4")
    code = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    padded[: len(v)] = code
    q = padded.reshape(-1, 4)
    control = (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8)
    raw = v.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) <= code[:, None]].tobytes()


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of encode_numbers, by table lookup of the control bytes."""
    lens = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    at = np.cumsum(lens) - lens
    buf = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    word = buf[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = lens > k
        if more.any():
            word[more] |= buf[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return word & _MASK[lens - 1]


def block(keys: np.ndarray, valid: np.ndarray, lens: np.ndarray, ranks: np.ndarray) -> bytes:
    """One block of a file: header, ids of documents, their validity and lengths, control, data."""
    control, data = encode_numbers(ranks)
    head = _HEAD.pack(MAGIC, len(keys), len(ranks), len(data))
    return head + keys.astype("<i8").tobytes() + valid.astype("u1").tobytes() + lens.astype("<i8").tobytes() + control + data


def blocks(f) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, valid, lens, ranks) of each block of an open file."""
    while head := f.read(_HEAD.size):
        magic, docs, n, size = _HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a file of ids")
        keys = np.frombuffer(f.read(8 * docs), dtype="<i8")
        valid = np.frombuffer(f.read(docs), dtype="u1").astype(bool)
        lens = np.frombuffer(f.read(8 * docs), dtype="<i8")
        control = f.read(-(-n // 4))
        yield keys, valid, lens, decode_numbers(control, f.read(size), n)


def tokenise(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(key, tie, ids): whole texts as little-endian uint16 ids with the end id; tie: their CRC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                raw = [x.tobytes() + end for x in enc.encode(texts.slice(a, b - a))]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    ["key", "tie", "ids"],
                )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "key long, tie long, ids binary")


def flat_ids(col: pa.Array, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The ids of a column of uint16 ids in bytes, one row after the other, at most `most` at a time."""
    _, ends, data = col.buffers()
    wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    if len(col):
        a, z = (int(np.frombuffer(ends, wide)[col.offset + k]) for k in (0, len(col)))
        for k in range(a, z, 2 * most):
            yield np.frombuffer(data, "<u2", min(most, (z - k) // 2), k)


def ranking(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency over all documents, ties to the smaller id. At most 65,536 rows
    reach the driver: one an id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for x in flat_ids(batch.column(0)):
                total += np.bincount(x, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], dtype=np.int64)


def write_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, file_ids: int = 8_000_000, block_ids: int = 1_000_000) -> DataFrame:
    """Writes ids below `path` in ascending order of `id_col` and returns the files' table:
    (file, name, documents, ids, bytes), file numbers in that order.

    Texts are tokenised once into a table of the shared folder; id frequencies come from all of
    it; ids of documents are integers, others are refused; a range partitioning by (id, checksum), so that not even one repeated id is hot, gives
    each task one file of about `file_ids` ids, written in blocks of `block_ids` under a name of
    its own and then renamed, so a repeated task leaves a whole file. Null texts are empty
    documents; null ids come first; rows with equal ids are ordered by checksum. No rows give
    no files."""
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is no integer, as the files' format asks for")
    tokens = materialise(tokenise(docs, tokenizer, id_col, text_col, end_id))
    ids = ranking(tokens)
    rank = np.zeros(1 << 16, dtype=np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    where, root = fs.FileSystem.from_uri(path)
    where.create_dir(root, recursive=True)
    with where.open_output_stream(f"{root}/ranks") as f:
        f.write(ids.astype("<u4").tobytes())
    total = tokens.select(F.sum(F.octet_length("ids")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // 2 // file_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(path)
        name, own = f"part-{number:08d}.ids", f"{base}/.{uuid.uuid4().hex}"
        n_docs = n_ids = n_bytes = 0
        held: list[tuple[int | None, bytes]] = []
        size = 0
        with store.open_output_stream(own) as f:

            def flush() -> None:
                nonlocal held, size, n_docs, n_ids, n_bytes
                keys = np.array([k or 0 for k, _ in held], dtype=np.int64)
                valid = np.array([k is not None for k, _ in held])
                lens = np.array([len(x) // 2 for _, x in held], dtype=np.int64)
                out = block(keys, valid, lens, rank[np.frombuffer(b"".join(x for _, x in held), dtype="<u2")])
                f.write(out)
                n_docs, n_ids, n_bytes = n_docs + len(held), n_ids + int(lens.sum()), n_bytes + len(out)
                held, size = [], 0

            for batch in batches:
                for k, x in zip(batch.column(0), batch.column(1)):
                    held.append((k.as_py(), x.as_py()))
                    size += len(held[-1][1]) // 2
                    if size >= block_ids:
                        flush()
            if held:
                flush()
        if n_docs:
            store.move(own, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, name, n_docs, n_ids, n_bytes)], ["file", "name", "documents", "ids", "bytes"])
        else:
            store.delete_file(own)

    files = (
        tokens.repartitionByRange(parts, F.col("key").asc_nulls_first(), "tie")
        .sortWithinPartitions(F.col("key").asc_nulls_first(), "tie")
        .select("key", "ids")
        .mapInArrow(run, "file long, name string, documents long, ids long, bytes long")
    )
    files = materialise(files)
    delete(tokens, spark)
    release_shuffles(spark)
    return files


def read_files(spark: SparkSession, files: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, file) of every document, from the files' bytes.

    start counts the ids of all files and documents before; the sum over files is a window over
    one row a file."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    todo = files.withColumn("before", before).select("file", "name", "before")
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        with store.open_input_file(f"{base}/ranks") as f:
            ids = np.frombuffer(f.read(), dtype="<u4")
        for batch in batches:
            for number, name, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{base}/{name}") as f:
                    for keys, valid, lens, ranks in blocks(f):
                        got = ids[ranks].astype("<u4")
                        ends = np.cumsum(lens)
                        crc = [zlib.crc32(got[e - n : e].tobytes()) for e, n in zip(ends, lens)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, pa.int64(), mask=~valid), pa.array(start + ends - lens, pa.int64()), pa.array(lens, pa.int64()), pa.array(crc, pa.int64()), pa.array([number] * len(keys), pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                        )
                        start += int(ends[-1])

    return todo.repartition(n, "file").mapInArrow(run, T._parse_datatype_string("doc_id long, start long, n_tokens long, ids_crc32 long, file long"))


def encode_and_read(docs: DataFrame, tokenizer: str, path: str | None = None, **kw) -> DataFrame:
    """write_files, then read_files; `path` defaults to a new folder in the shared folder."""
    path = path or shared_dir(docs.sparkSession)
    return read_files(docs.sparkSession, write_files(docs, path, tokenizer, **kw), path)
