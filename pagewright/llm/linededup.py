"""Fuzzy line deduplication by MinHash (op 2)."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bound, components, delete, materialise, nested, release_shuffles, unnested
from pagewright.llm.tokens import forget, slices

BINS, BANDS, ROWS, SHINGLE = 64, 30, 7, 5
#: Bits of a band's number in a key; pairs looked at together.
SHIFT, PAIRS = 5, 1 << 18
#: Characters of lines, counted once a band, that one group of candidates holds; blocks of a
#: larger band hold half as many.
GROUP = 1 << 22


def _shingles(points: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every run of n code points."""
    p = points.astype(np.uint64)
    m = max(0, len(p) - n + 1)
    h = p[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            h *= np.uint64(0x100000001B3)
            h += p[k : k + m]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def signatures(lines: list[str], n: int = SHINGLE) -> np.ndarray:
    """(lines, BINS) MinHash values by one-permutation hashing: the top bits of a shingle's hash
    choose its bin, and an empty bin takes the value of the next one that isn't, marked by the
    distance. Lines shorter than n characters have no shingle and get all ones."""
    none = np.uint64(2**64 - 1)
    out = np.full(len(lines) * BINS, none, dtype=np.uint64)
    if lines:
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        h = _shingles(points, n)
        size = np.array([len(x) for x in lines], dtype=np.int64)
        bins = (h >> np.uint64(58)).astype(np.int64)
        bins += np.repeat(np.arange(len(lines)) * BINS, size)[: len(h)]
        ends = np.cumsum(size)
        for k in range(1, n):  # shingles that run into the next line
            at = ends - k
            h[at[(at >= 0) & (at < len(h))]] = none
        np.minimum.at(out, bins, h)
    out = out.reshape(len(lines), BINS)
    empty = out == none
    rows = np.flatnonzero(empty.any(1) & ~empty.all(1))
    some, empty = out[rows], empty[rows]
    # for each bin, the next one that isn't empty, counted on past the last bin
    at = np.where(empty, 2 * BINS, np.arange(BINS)).astype(np.uint8)
    at = np.concatenate([at, np.where(empty, 2 * BINS, np.arange(BINS, 2 * BINS)).astype(np.uint8)], axis=1)
    at = np.minimum.accumulate(at[:, ::-1], axis=1)[:, : BINS - 1 : -1]
    line, k = np.nonzero(empty)
    to = at[line, k]
    with np.errstate(over="ignore"):
        some[line, k] = some[line, to % BINS] + (to - k).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)
    out[rows] = some
    return out


def _layout() -> list[list[int]]:
    """The bins of each band: neighbours first, as what fills empty bins comes from neighbours, then
    random ones. A pair right at 0.8 shares a band with probability 0.99, one at 0.3 with 0.007."""
    r = random.Random(1)
    out = [list(range(k, k + ROWS)) for k in range(0, BINS - ROWS + 1, ROWS)]
    while len(out) < BANDS:
        mixed = r.sample(range(BINS), BINS)
        out += [mixed[k : k + ROWS] for k in range(0, BINS - ROWS + 1, ROWS)]
    return out[:BANDS]


LAYOUT = _layout()


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(lines, BANDS) hashes, of 32 bits, of ROWS values each. Bands that are equal by accident only
    cost a verification."""
    with np.errstate(over="ignore"):
        sig = np.ascontiguousarray(sig.T)
        h = np.empty((sig.shape[1], BANDS), dtype=np.uint32)
        for b, bins in enumerate(LAYOUT):
            x = np.full(len(h), b + 1, dtype=np.uint64)
            for k in bins:
                x ^= sig[k]
                x *= np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
            h[:, b] = x >> np.uint64(32)
    return h.view(np.int32)


def _bytes(bands: np.ndarray, some: np.ndarray) -> pa.Array:
    """A column of bytes: the next row of `bands` where `some` holds, nothing elsewhere. As lists of
    numbers, they would cost a parquet value and an Arrow one for each."""
    ends = np.concatenate([[0], np.cumsum(np.where(some, bands.itemsize * BANDS, 0))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bands))])


def _numbers(col: pa.Array) -> np.ndarray:
    """(rows, BANDS) numbers of a column that _bytes made, of rows that all have some."""
    if not len(col):
        return np.empty((0, BANDS), dtype=np.int32)
    _, ends, data = col.buffers()
    wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    start = np.frombuffer(ends, wide)[col.offset]
    return np.frombuffer(data, np.int32, len(col) * BANDS, int(start)).reshape(-1, BANDS)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, h, chars, bands) of the lines that aren't blank; docs has doc_id, row,
    text. A document with lines has one more row, of line_no -1, whose h stands for the document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            texts = batch.column(2)
            for a, z in slices(texts, 1 << 18):
                of, no, lines, digests = [], [], [], []
                rows = batch.column(1).slice(a, z - a).to_pylist()
                for k, t in enumerate(texts.slice(a, z - a).to_pylist()):
                    if t and t.strip():
                        of.append(a + k)
                        no.append(-1)
                        lines.append("")
                        digests.append(xxhash.xxh3_128_digest(rows[k].to_bytes(8, "little", signed=True), seed=1))
                    for i, x in enumerate((t or "").split("\n")):
                        if x.strip():
                            of.append(a + k)
                            no.append(i)
                            lines.append(x)
                            digests.append(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")))
                low = [x.lower() for x in lines]
                size = np.array([len(x) for x in low], dtype=np.int64)
                bands = band_hashes(signatures(low))[size >= SHINGLE]
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(no, pa.int32()), pa.array(digests, pa.binary()), pa.array(size), _bytes(bands, size >= SHINGLE)],
                    ["doc_id", "row", "line_no", "h", "chars", "bands"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, row long, line_no int, h binary, chars long, bands binary")


def _packed(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (id, chars, bands): (part, base, entries), the bands of neighbouring lines
    by part of the bands' values, as arrays in bytes: values, ids from base on, logarithms of chars
    rounded up, bands' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            every = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(every >> 16, prepend=-1, append=-1)).tolist()
            for at, to in zip(cut, cut[1:]):
                ids, n = every[at:to], to - at
                log = np.ceil(8 * np.log2(batch.column(1).slice(at, n).to_numpy())).astype(np.uint8)
                value = _numbers(batch.column(2).slice(at, n)).view(np.uint32).T.reshape(-1)
                part = value % np.uint32(parts)
                order = np.argsort(part, kind="stable")
                line, band, value, part = order % n, (order // n).astype(np.uint8), value[order], part[order]
                low, log = (ids & 0xFFFF).astype(np.uint16)[line], log[line]
                ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
                rows = [(int(part[a]), b"".join(x[a:z].tobytes() for x in (value, low, log, band))) for a, z in zip(np.append(0, ends[:-1]), ends)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([int(ids[0]) >> 16 << 16] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["part", "base", "entries"])

    return run


def _shared(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """(id, chars, band, least) of the bands in `held` that at least two lines have."""
    columns = []
    for base, entries in held:
        n = len(entries) // 8
        low, log, band = np.frombuffer(entries, np.uint16, n, 4 * n), np.frombuffer(entries, np.uint8, n, 6 * n), np.frombuffer(entries, np.uint8, n, 7 * n)
        columns.append(((np.frombuffer(entries, np.uint32, n).astype(np.int64) << SHIFT) | band, base + low.astype(np.int64), log))
    key, ids, log = (np.concatenate(x) for x in zip(*columns))
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    many = ~(new & np.append(new[1:], True))
    key, order, new = key[many], order[many], new[many]
    ids, chars = ids[order], np.exp2(log[order] / 8).astype(np.int64)
    starts = np.flatnonzero(new)
    least = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(ids)))) if len(ids) else ids
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, chars, key, least)], ["id", "chars", "band", "least"])


def _members(texts: DataFrame) -> DataFrame:
    """(id, chars, band, least): the bands that at least two lines have, with their least line. Most
    bands have one line: they are told apart as arrays, not as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple[int, bytes]] = []
        part = None
        for batch in batches:
            for p, base, entries in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part and held:
                    yield _shared(held)
                    held = []
                part = p
                held.append((base, entries))
        if held:
            yield _shared(held)

    parts = 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.where(F.octet_length("bands") > 0).select("id", "chars", "bands").mapInArrow(_packed(parts), "part int, base long, entries binary")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "id long, chars long, band long, least long")


def _groups(texts: DataFrame) -> DataFrame:
    """(id, g, x, y, side, mask): the groups in which a line meets those that share a band with it.

    All lines of a band meet in the band's home: the least line that its members know of, a
    member knowing the least lines of all its bands. So the bands of a family of lines mostly
    have one home, and a line is sent there once. mask: which of its bands have that home. A
    home with too many characters falls apart by the least lines of its bands, what is still too
    large into its bands, and a large band into pairs (x, y) of hash blocks, where the line is on
    the left (side 1), the right (2) or both (3)."""
    # a band's number is in its lowest bits
    members = materialise(_members(texts))
    known = members.groupBy("id").agg(F.min("least").alias("known"))
    home = members.join(known, "id").groupBy("band").agg(F.min("known").alias("home"))
    rest = materialise(members.join(home, "band"))
    delete(members, texts.sparkSession)
    mask = F.expr(f"shiftleft(1, cast(band & {(1 << SHIFT) - 1} as int))")
    bit = F.bit_or(mask).alias("mask")
    out = []
    for level, key in enumerate(("home", "least", "band")):
        large = materialise(rest.groupBy(key).agg(F.sum("chars").alias("total")).where(F.col("total") > GROUP).select(key))
        whole = large.isEmpty()
        own = (rest if whole else rest.join(large, key, "left_anti")).groupBy("id", F.col(key).alias("g")).agg(bit)
        out.append(own.select("id", "g", F.lit(level - 3).alias("x"), F.lit(-1).alias("y"), F.lit(3).alias("side"), "mask"))
        if whole:
            return reduce(DataFrame.unionByName, out)
        rest = materialise(rest.join(large, key))
    parts = rest.groupBy("band").agg(F.ceil(F.sum("chars") * 2 / GROUP).cast("int").alias("parts"))
    rest = rest.join(parts, "band").withColumn("part", F.pmod(F.xxhash64("id", "band"), F.col("parts")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("part") < F.col("other"), 1).when(F.col("part") > F.col("other"), 2).otherwise(3)
    out.append(rest.select("id", F.col("band").alias("g"), F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), side.alias("side"), mask.alias("mask")))
    return reduce(DataFrame.unionByName, out)


def _narrow(lines: list[str]) -> bool:
    """Whether _sets can number the lines' characters in 12 bits."""
    points = np.frombuffer("".join(lines).lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return not len(points) or int(points.max()) >> 12 == 0 or len(np.unique(points)) >> 12 == 0


def _sets(lines: list[str]) -> Callable[[int], np.ndarray | frozenset[str]]:
    """A function that makes the set of shingles of a line, once: sorted numbers that hold a
    shingle's characters themselves, in 12 bits each, after the group's characters are numbered if
    need be; of text with more than 4,096 different characters, a set of strings."""
    low = [x.lower() for x in lines]
    points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4") for x in low]
    alphabet = None
    if max(int(p.max()) for p in points) >> 12:
        alphabet = np.unique(np.concatenate(points))
    made: dict[int, np.ndarray | frozenset[str]] = {}

    def of(k: int) -> np.ndarray | frozenset[str]:
        if k not in made:
            if alphabet is not None and len(alphabet) >> 12:
                made[k] = frozenset(low[k][j : j + SHINGLE] for j in range(len(low[k]) - SHINGLE + 1))
            else:
                p = (points[k] if alphabet is None else np.searchsorted(alphabet, points[k])).astype(np.uint64)
                m = len(p) - SHINGLE + 1
                x = p[:m].copy()
                for j in range(1, SHINGLE):
                    x <<= np.uint64(12)
                    x |= p[j : j + m]
                x.sort()
                made[k] = x[np.append(True, x[1:] != x[:-1])]
        return made[k]

    return of


def _common(x: np.ndarray | frozenset[str], y: np.ndarray | frozenset[str]) -> int:
    if isinstance(x, frozenset):
        return len(x & y)
    both = np.concatenate((x, y))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _pairs(gid: np.ndarray, side: np.ndarray, mask: np.ndarray, bands: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(p, q), about PAIRS at a time: the rows that meet, by the first band that they share."""
    row, band = np.nonzero((mask[:, None] >> np.arange(BANDS)) & 1)
    value = bands[row, band]
    order = np.lexsort((row, value, band, gid[row]))
    row, band, value = row[order], band[order], value[order]
    new = np.append(True, (gid[row[1:]] != gid[row[:-1]]) | (band[1:] != band[:-1]) | (value[1:] != value[:-1]))
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(row)))
    end = np.repeat(starts + size, size)
    at, far, held, n = np.arange(len(row)), 0, [], 0
    while len(at):
        far += 1
        at = at[at + far < end[at]]
        for k in range(0, len(at), PAIRS):
            held.append((at[k : k + PAIRS], far))
            n += len(held[-1][0])
            if n >= PAIRS:
                yield _first(held, row, band, side, bands)
                held, n = [], 0
    if held:
        yield _first(held, row, band, side, bands)


def _first(held: list[tuple[np.ndarray, int]], row: np.ndarray, band: np.ndarray, side: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, to = np.concatenate([a for a, _ in held]), np.concatenate([a + far for a, far in held])
    p, q, of = row[at], row[to], band[at]
    met = (side[p] | side[q]) == 3
    p, q, of = p[met], q[met], of[met]
    first = (bands[p] == bands[q]).argmax(1) == of
    return p[first], q[first]


def _shares(p: np.ndarray, q: np.ndarray, of: Callable[[int], np.ndarray | frozenset[str]]) -> np.ndarray:
    """How many shingles the lines of each pair have in common. Where few lines make many pairs,
    from one bit for each shingle that at least two of them have."""
    rows = np.unique(np.concatenate((p, q)))
    if len(p) < 8 * len(rows) or isinstance(of(int(rows[0])), frozenset):
        return np.array([_common(of(a), of(b)) for a, b in zip(p.tolist(), q.tolist())], dtype=np.int64)
    sets = [of(k) for k in rows.tolist()]
    _, nth, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    line = np.repeat(np.arange(len(rows)), [len(x) for x in sets])
    some = n[nth] > 1
    line, nth = line[some], rank[nth[some]]
    p, q, out = np.searchsorted(rows, p), np.searchsorted(rows, q), np.zeros(len(p), dtype=np.int64)
    wide = max(1, (1 << 22) // len(rows)) * 64  # of the table of bits, a stripe at a time
    for a in range(0, int(rank[-1]) + 1, wide):
        own = (nth >= a) & (nth < a + wide)
        bits = np.zeros((len(rows), -(-min(wide, int(rank[-1]) + 1 - a) // 64)), dtype=np.uint64)
        np.bitwise_or.at(bits, (line[own], (nth[own] - a) >> 6), np.uint64(1) << ((nth[own] - a) & 63).astype(np.uint64))
        step = max(1, (1 << 21) // bits.shape[1])
        for k in range(0, len(p), step):
            out[k : k + step] += np.bitwise_count(bits[p[k : k + step]] & bits[q[k : k + step]]).sum(1, dtype=np.int64)
    return out


def _links(gid: np.ndarray, ids: np.ndarray, side: np.ndarray, mask: np.ndarray, bands: np.ndarray, lines: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, root, links) of the linked lines of some groups, by the groups' numbers `gid`.

    A pair counts in the first band that it shares, so in one group only. root is the least line
    that the group's links lead to."""
    of = _sets(lines)
    up, count = np.arange(len(lines)), np.zeros(len(lines), dtype=np.int64)

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    size = np.zeros(len(lines), dtype=np.int64)
    for p, q in _pairs(gid, side, mask, bands):
        for k in np.unique(np.concatenate((p, q))).tolist():
            size[k] = size[k] or len(of(k))
        near = np.minimum(size[p], size[q]) >= threshold * np.maximum(size[p], size[q])
        p, q = p[near], q[near]
        if not len(p):
            continue
        common = _shares(p, q, of)
        linked = common >= threshold * (size[p] + size[q] - common)
        p, q = p[linked], q[linked]
        count += np.bincount(p, minlength=len(count)) + np.bincount(q, minlength=len(count))
        a, b = up[p], up[q]  # roots, or were before this loop
        for a, b in np.unique(np.stack((a, b), 1)[a != b], axis=0).tolist():
            a, b = sorted((find(a), find(b)))
            up[b] = a
        while (up[up] != up).any():
            up = up[up]
    some = np.flatnonzero(count)
    return ids[some], ids[up[some]], count[some]


def _verify(tasks: DataFrame, threshold: float) -> DataFrame:
    """(id, root, n): links found in each group; tasks: (g, x, y, id, side, mask, bands, line), a
    group's rows together and sorted by id. Repeated rows of a line in a group count once."""

    def found(held: list[tuple], lines: list[str]) -> Iterator[pa.RecordBatch]:
        gid, ids, side, mask, bands = (np.concatenate(x) for x in zip(*held))
        of = np.searchsorted(np.unique(gid), gid)
        # a wide alphabet is a matter of one group
        cut = [0, len(lines)] if not lines or _narrow(lines) else [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(lines)]
        for a, z in zip(cut, cut[1:]):
            got = _links(of[a:z], ids[a:z], side[a:z], mask[a:z], bands[a:z], lines[a:z], threshold)
            if len(got[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["id", "root", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[tuple] = []
        lines: list[str] = []
        group, number, last, chars = None, -1, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = dict(zip(batch.schema.names, batch.columns))
            at = [c[k].to_numpy() for k in ("g", "x", "y", "id")]
            bands = _numbers(c["bands"])
            n = batch.num_rows
            start = np.append(True, reduce(np.logical_or, (x[1:] != x[:-1] for x in at[:3]), np.zeros(n - 1, dtype=bool)))
            start[0] = group != tuple(x[0] for x in at[:3])
            again = np.append(at[3][:1] == last, at[3][1:] == at[3][:-1]) & ~start
            gid = number + np.cumsum(start)
            group, number, last = tuple(x[-1] for x in at[:3]), int(gid[-1]), at[3][-1]
            # whole groups are handed on once there are enough characters
            size, cut = np.cumsum(pc.utf8_length(c["line"]).to_numpy()), 0
            for k in [*np.flatnonzero(start).tolist(), n]:
                if k == n or chars + (int(size[k - 1]) if k else 0) - (int(size[cut - 1]) if cut else 0) >= 1 << 19:
                    own = np.flatnonzero(~again[cut:k]) + cut
                    if len(own):
                        held.append((gid[own], at[3][own], c["side"].to_numpy()[own], c["mask"].to_numpy()[own], bands[own]))
                        lines += c["line"].take(pa.array(own)).to_pylist()
                    chars += (int(size[k - 1]) if k else 0) - (int(size[cut - 1]) if cut else 0)
                    cut = k
                    if k < n and held:
                        yield from found(held, lines)
                        held, lines, chars = [], [], 0
        if held:
            yield from found(held, lines)

    return tasks.mapInArrow(run, "id long, root long, n long")


def analyse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, row, kept, n_fuzzy, n_links), one row for each document that keeps a line or would
    have been the first to have one: the numbers of its lines that stay, how many first
    occurrences of a text go because a similar line stays, and the links of those texts.

    Lines are what line feeds part; a blank line is none. Equal lines are one text; different
    texts are linked if the Jaccard similarity of their sets of 5-character shingles, in lower
    case, reaches the threshold. Of each connected group the line stays that comes first by
    document id, then by a hash of the document, then by line number.

    Candidates share one of 30 bands of 7 of 64 MinHash values: a pair right at the threshold is
    found with probability 0.99. Lines that share bands are sent to common groups (see _groups), whose
    size is bounded; every pair that shares a band is verified once; only a forest of the links
    and their numbers leave a group. Copies are merged, partly before the shuffle, so a line that
    half of all documents have is one row. Lines of fewer than 5 characters only equal each
    other."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    where = F.struct("doc_id", "row", "line_no")
    texts = line_table(src).groupBy("h").agg(F.min(where).alias("at"), F.any_value("chars").alias("chars"), F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    texts = materialise(texts.select(F.monotonically_increasing_id().alias("id"), "at.*", "chars", "bands", "copies"))
    release_shuffles(spark)
    repeated = texts.where("line_no < 0 and copies > 1").select("row").distinct().withColumn("again", F.lit(True))
    texts = texts.where("line_no >= 0")
    groups = _groups(texts).groupBy("id").agg(F.collect_list(F.struct("g", "x", "y", "side", "mask")).alias("groups"))
    # only the candidates' texts are fetched, each document once; a repeated row sends its lines again
    need = groups.join(texts, "id").groupBy("doc_id", "row").agg(F.collect_list(F.struct("id", "line_no", "bands", "groups")).alias("want"))
    need = materialise(need.join(repeated, "row", "left"))
    release_shuffles(spark)

    def fetched(need: DataFrame) -> DataFrame:
        n = need.select(F.col("doc_id").alias("of"), F.col("row").alias("key"), "want").hint("shuffle_hash")
        got = src.join(n, (F.col("row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of")))
        line = bound(F.split("text", "\n", -1), lambda x: F.transform("want", lambda w: F.struct(w["id"].alias("id"), w["bands"].alias("bands"), w["groups"].alias("groups"), F.get(x, w["line_no"]).alias("line"))))
        return got.select(F.explode(line).alias("w")).select("w.*")

    lines = fetched(need.where("again is null")).unionByName(fetched(need.where("again")).dropDuplicates(["id"]))
    tasks = lines.select("id", "bands", "line", F.explode("groups").alias("t")).select("t.*", "id", "bands", "line")
    tasks = tasks.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "id")
    found = materialise(_verify(tasks, threshold))
    delete(need, spark)
    release_shuffles(spark)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of = roots.join(texts.select("id", where.alias("at")), roots["node"] == F.col("id")).select("root", "id", "at")
    keeper = of.groupBy("root").agg(F.min(F.struct("at", "id"))["id"].alias("keeper"))
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    linked = of.join(keeper, "root").join(links, "id").select("at.*", (F.col("id") != F.col("keeper")).alias("goes"), "links")
    every = texts.select("doc_id", "row", "line_no", F.lit(None).cast("boolean").alias("goes"), F.lit(0).cast("long").alias("links")).unionByName(linked)
    first, gone = F.collect_list(F.when(F.col("goes").isNull(), F.col("line_no"))), F.collect_list(F.when(F.col("goes"), F.col("line_no")))
    return every.groupBy("doc_id", "row").agg(F.array_except(first, gone).alias("kept"), F.count_if("goes").alias("n_fuzzy"), F.sum("links").alias("n_links"))


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """(d, text, n_lines, n_kept, n_fuzzy, n_links): each row of `docs` as a struct, with the lines
    of its text that stay (see analyse). Blank lines stay where they are. Null text stays null and
    has no lines; rows that repeat with their id and text are one document and all keep the same
    lines; null ids are ids like any other; no rows give none."""
    got = analyse(docs, id_col, text_col, **kw).select(F.col("doc_id").alias("of"), F.col("row").alias("key"), "kept", "n_fuzzy", "n_links")
    src = docs.select(nested(docs), F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"))
    # hashed, not sorted: the side with the texts is only streamed and spills nothing
    j = src.join(got.hint("shuffle_hash"), (F.col("row") == F.col("key")) & F.col("id").eqNullSafe(F.col("of")), "left").withColumn("whole", F.col("d").getField(text_col))
    # as Python's strip sees it, only for deciding which lines count
    blank = r"^[\s\x1c-\x1f\x85\p{Z}]*$"
    none = F.array().cast("array<int>")
    j = j.withColumns({"lines": F.split("whole", "\n", -1), "kept": F.coalesce("kept", none)})
    some = F.size("kept") < F.size("lines")  # else all lines stay and none is blank
    j = j.withColumn("blank", F.when(some, F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(blank), i)), lambda i: i.isNotNull())).otherwise(none))
    stay = F.transform(F.array_sort(F.array_union("kept", "blank")), lambda i: F.get("lines", i))
    n = F.coalesce(F.size("lines") - F.size("blank"), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    return j.select(
        "d",
        F.when(some, F.array_join(stay, "\n")).otherwise(F.col("whole")).alias("text"),
        F.when(F.col("whole").isNull(), zero).otherwise(n).alias("n_lines"),
        F.size("kept").cast("long").alias("n_kept"),
        F.coalesce("n_fuzzy", zero).alias("n_fuzzy"),
        F.coalesce("n_links", zero).alias("n_links"),
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, text, n_lines, n_kept, n_fuzzy, n_links) of every row; text: the lines that stay."""
    out = _deduplicated(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", **kw)
    return out.select("d.doc_id", "text", "n_lines", "n_kept", "n_fuzzy", "n_links")


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **kw) -> DataFrame:
    """The columns of `docs` with the lines that stay. A document of which no line stays goes;
    length_col, if there, is the new text's length."""
    out = _deduplicated(docs, id_col, text_col, **kw).where("n_kept > 0")
    return unnested(out, docs, {text_col: F.col("text"), length_col: F.length("text")})
