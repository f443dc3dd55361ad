"""WARC archives: a writer with revisit records and a splittable reader (op 7)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, shared_dir, skew_safe_lookup

MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2020-01-01T00:00:00Z"


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """A record as one gzip member; a revisit, if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Has-URI: {int(url is not None)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _headers(lines: list[bytes]) -> dict[str, str]:
    """Header lines by lower-case name, the first of each; a line that begins with white space
    continues the one before."""
    out: dict[str, str] = {}
    name = None
    for x in lines:
        if x[:1] in (b" ", b"\t") and name:
            out[name] += " " + x.strip().decode("utf-8", "replace")
            continue
        head, _, value = x.partition(b":")
        name = head.strip().decode("utf-8", "replace").lower()
        if name in out:
            name = None
        else:
            out[name] = value.strip().decode("utf-8", "replace")
    return out


def _hex_digest(label: str | None) -> str | None:
    """A digest label as bare hex; Base32 SHA-1, as most archives have it, is turned into hex."""
    if not label:
        return None
    kind, _, value = label.rpartition(":")
    if kind.lower() in ("", "sha1") and len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() if kind.lower() in ("", "sha1") else label


def _number(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


def parse(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, record_id, refers_to_id, payload (None for a revisit),
    payload_bytes and payload_digest of a decoded record, of any archive and type.

    The payload of an HTTP response or request is what follows its headers, that of any other
    record its block; bytes and digest come from it, those of a revisit from its headers. What a
    record doesn't say is null: only this module's archives have page ids."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(top.split(b"\r\n")[1:])
    block = rest[: int(h["content-length"])]
    url = h.get("warc-target-uri")
    out = {
        "page_id": _number(h.get("x-page-id")),
        "url": None if h.get("x-has-uri") == "0" else url.strip("<>") if url and "x-has-uri" not in h else url,
        "record_type": h.get("warc-type"),
        "refers_to": _number(h.get("x-refers-to-page")),
        "record_id": h.get("warc-record-id"),
        "refers_to_id": h.get("warc-refers-to"),
    }
    payload = block
    http = {}
    if h.get("content-type", "").lower().startswith("application/http"):
        lines, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(lines.split(b"\r\n")[1:])
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": _number(http.get("content-length")), "payload_digest": _hex_digest(h.get("warc-payload-digest"))}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


class _Window:
    """A moving window over a file: bytes from `at` on, more of them when asked."""

    def __init__(self, f, at: int, size: int, step: int):
        self.f, self.at, self.size, self.step, self.buf = f, at, size, step, b""
        f.seek(at)

    def more(self) -> bool:
        got = self.f.read(self.step)
        self.buf += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.buf = self.buf[n:]
        self.at += n


def _member(w: _Window) -> tuple[bytes, int] | None:
    """The decoded member at the window's start and its length, or None where there is none:
    its first bytes must decode to a record's first line, the whole must pass its checksum, and
    another member or the end of the file must follow."""
    z, out, fed, first = zlib.decompressobj(31), [], 0, b""
    while not z.eof:
        if fed >= len(w.buf) and not w.more():
            return None
        part = w.buf[fed : fed + (1 << 16)]
        fed += len(part)
        try:
            out.append(z.decompress(part))
        except zlib.error:
            return None
        if len(first) < 7:
            first = b"".join(out)[:7]
            if not b"WARC/1.".startswith(first):
                return None
    if first != b"WARC/1.":
        return None
    n = fed - len(z.unused_data)
    while len(w.buf) < n + 3 and w.more():
        pass
    tail = w.buf[n : n + 3]
    if tail and tail != MAGIC[: len(tail)]:
        return None
    return b"".join(out), n


def scan(f, start: int, end: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes | None]]:
    """(offset, decoded record) of the records that begin in [start, end) of an open file.

    From a split's start the bytes are searched for the gzip magic; a candidate counts only if
    it decodes to a record (see _member), else the search goes on a byte later. From there
    records follow each other, the last one maybe beyond the end of the split. Where another must
    follow (the file's start, the end of a record, even if that is another split's) and none
    can be decoded, the file is damaged: (offset, None) is given once, and the search goes on."""
    w = _Window(f, start, size, step)
    due = start == 0  # whether a record must begin here
    while w.at < size:
        if not due:
            while (k := w.buf.find(MAGIC)) < 0:
                w.drop(len(w.buf) - min(2, len(w.buf)))
                if w.at >= end or not w.more():
                    return
            w.drop(k)
            if w.at >= end:
                return
        got = _member(w)
        if got is None:
            if due:
                yield w.at, None
            if w.at >= end:
                return
            due = False
            if w.buf or w.more():
                w.drop(1)
            continue
        if w.at >= end:  # it is there, and another split's
            return
        yield w.at, got[0]
        w.drop(got[1])
        due = True


def plan(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what each page's record will be.

    Payloads of at least `least` bytes are grouped by digest; counts and largest ids are summed
    before they are shuffled, and digests that hold much of all rows are looked up by broadcast
    (see skew_safe_lookup), so that a page copied millions of times is no one task's work."""
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    copies = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy("digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    copies = materialise(copies)
    joined = skew_safe_lookup(rows, copies, "digest", "n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, level: int = 6) -> DataFrame:
    """Writes one archive a task below `path`; returns (name, records, bytes) of each.

    A file is written under a name of its own and renamed when whole, so tasks can be repeated.
    Null html is an empty payload; null ids and urls are kept; a null id never is the response
    that others refer to while another id is there. Repeated rows with the largest id all are
    responses. Pages whose payload is shorter than `least` bytes always are. No rows give no
    archives. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        name, own = f"part-{TaskContext.get().partitionId():08d}.warc.gz", f"{base}/.{uuid.uuid4().hex}"
        records = size = 0
        with store.open_output_stream(own) as f:
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(5))):
                    out = member(*(x.as_py() for x in row), level=level)
                    f.write(out)
                    records, size = records + 1, size + len(out)
        if records:
            store.move(own, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, records, size)], ["name", "records", "bytes"])
        else:
            store.delete_file(own)

    return materialise(plan(pages, id_col, url_col, html_col, least).mapInArrow(run, "name string, records long, bytes long"))


def read_archives(spark: SparkSession, files: DataFrame, path: str, split: int = 8 << 20, with_payload: bool = False, with_ids: bool = False, damage: str = "raise") -> DataFrame:
    """Records of archives, this module's or others', of all types: page_id, payload_bytes,
    payload_digest, record_type, refers_to and url (see parse), record_id and refers_to_id or
    the payload if asked for. files: (name, bytes). Each task scans byte ranges of `split` bytes
    and owns the records that begin there, so one big file is read by many tasks.

    damage: what comes of places where a record should begin and none can be decoded, as in
    truncated or altered files: "raise" makes them an error with file and offset, "report" a row
    of record_type `damaged` whose url is file:offset; the records behind them are read."""
    if damage not in ("raise", "report"):
        raise ValueError(damage)
    todo = files.select("name", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("at"))
    n = max(1, todo.count())
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", record_id string, refers_to_id string" * with_ids + ", payload binary" * with_payload
    fields = [x.split() for x in schema.split(", ")]
    names = [k for k, _ in fields]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t] for _, t in fields]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, size, at in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                with store.open_input_file(f"{base}/{name}") as f:
                    for offset, raw in scan(f, at, min(at + split, size), size):
                        if raw is None:
                            if damage == "raise":
                                raise ValueError(f"{name}: no record at byte {offset}")
                            rows.append({"record_type": "damaged", "url": f"{name}:{offset}"})
                            continue
                        rows.append(parse(raw))
                        held += len(raw) if with_payload else 200
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return todo.repartition(n, "name", "at").mapInArrow(run, schema)


def write_and_read(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """write_archives, then read_archives; `path` defaults to a new folder in the shared folder."""
    path = path or shared_dir(pages.sparkSession)
    return read_archives(pages.sparkSession, write_archives(pages, path, **kw), path)
