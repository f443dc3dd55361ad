"""Lossless WebP: a decoder of the whole format, an encoder that chooses by size, media columns (op 10)."""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import materialise
from pagewright.llm.tokens import slices

WIDTH = 576
MAX_SIDE = 1 << 14
#: The order in which lengths of the code-length code are stored.
_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: (x, y) steps of the 120 short distances, by rising distance as the format lists them.
_NEAR = """0 1,1 0,1 1,-1 1,0 2,2 0,1 2,-1 2,2 1,-2 1,2 2,-2 2,0 3,3 0,1 3,-1 3,3 1,-3 1,2 3,-2 3,3 2,-3 2,0 4,4 0,1 4,-1 4,4 1,-4 1,3 3,-3 3,2 4,-2 4,4 2,-4 2,0 5,3 4,-3 4,4 3,-4 3,5 0,1 5,-1 5,5 1,-5 1,2 5,-2 5,5 2,-5 2,4 4,-4 4,3 5,-3 5,5 3,-5 3,0 6,6 0,1 6,-1 6,6 1,-6 1,2 6,-2 6,6 2,-6 2,4 5,-4 5,5 4,-5 4,3 6,-3 6,6 3,-6 3,0 7,7 0,1 7,-1 7,5 5,-5 5,7 1,-7 1,4 6,-4 6,6 4,-6 4,2 7,-2 7,7 2,-7 2,3 7,-3 7,7 3,-7 3,5 6,-5 6,6 5,-6 5,8 0,4 7,-4 7,7 4,-7 4,8 1,8 2,6 6,-6 6,8 3,5 7,-5 7,7 5,-7 5,8 4,6 7,-6 7,7 6,-7 6,8 5,7 7,-7 7,8 6,8 7"""
NEAR = [tuple(map(int, s.split())) for s in _NEAR.split(",")]
_HASH = 0x1E35A7BD


class Bits:
    """Reads numbers of least-significant-first bits."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream ends too early")
        a = self.at >> 3
        v = int.from_bytes(self.data[a : a + (n >> 3) + 2], "little") >> (self.at & 7)
        self.at += n
        return v & ((1 << n) - 1)


class Writer:
    """Writes numbers as least-significant-first bits."""

    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def write(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def canonical(lengths) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of a canonical prefix code."""
    out, code, last = [], 0, 0
    for n, s in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out.append((s, n, int(f"{code:0{n}b}"[::-1], 2)))
        code += 1
    return out


class Code:
    """A prefix code as a lookup table of its longest code's width."""

    def __init__(self, lengths):
        used = [(s, n) for s, n in enumerate(lengths) if n]
        self._lists = None
        if len(used) == 1:
            self.width, self.only = 0, used[0][0]
            return
        if not used or sum(2.0**-n for _, n in used) != 1:
            raise ValueError("not a complete prefix code")
        self.only = None
        self.width = max(n for _, n in used)
        self.symbols = np.empty(1 << self.width, dtype=np.int32)
        self.lens = np.empty(1 << self.width, dtype=np.uint8)
        for s, n, code in canonical(lengths):
            self.symbols[code :: 1 << n] = s
            self.lens[code :: 1 << n] = n

    def read(self, b: Bits) -> int:
        if not self.width:
            return self.only
        if self._lists is None:
            self._lists = self.symbols.tolist(), self.lens.tolist()
        a = b.at >> 3
        k = int.from_bytes(b.data[a : a + 3], "little") >> (b.at & 7) & ((1 << self.width) - 1)
        b.at += self._lists[1][k]
        if b.at > b.end:
            raise ValueError("the stream ends too early")
        return self._lists[0][k]


def read_code(b: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if b.read(1):
        two = b.read(1)
        lengths[b.read(8 if b.read(1) else 1)] = 1
        if two:
            lengths[b.read(8)] = 1
        return Code(lengths)
    first = [0] * 19
    for k in range(4 + b.read(4)):
        first[_ORDER[k]] = b.read(3)
    code, left = Code(first), alphabet
    if b.read(1):
        left = 2 + b.read(2 + 2 * b.read(3))
    k, last = 0, 8
    while k < alphabet and left:
        left -= 1
        s = code.read(b)
        if s < 16:
            lengths[k] = s
            last = s or last
            k += 1
        else:
            n = 3 + b.read(2) if s == 16 else 3 + b.read(3) if s == 17 else 11 + b.read(7)
            if k + n > alphabet:
                raise ValueError("too many code lengths")
            lengths[k : k + n] = [last if s == 16 else 0] * n
            k += n
    return Code(lengths)


def _number(b: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + b.read(extra) + 1


def _distance(d: int, w: int) -> int:
    """The distance in pixels that a distance number stands for."""
    if d > 120:
        return d - 120
    x, y = NEAR[d - 1]
    return max(1, x + y * w)


def _fast(b: Bits, green: Code, dist: Code, n: int, w: int) -> np.ndarray:
    """n green samples of an image whose other samples are constant. The code is looked up at
    every bit of a stretch at once; then the lengths are followed from literal to literal, and a
    back-reference ends the walk, is copied, and begins the next."""
    stop = 1 << 40
    symbols, lens = green.symbols, green.lens
    jump = np.where(symbols > 255, stop, lens.astype(np.int64))
    raw = np.frombuffer(b.data + b"\0\0\0", dtype=np.uint8)
    mask, out, done, at = np.uint32((1 << green.width) - 1), np.empty(n, dtype=np.uint8), 0, b.at
    shifts = np.arange(8, dtype=np.uint32)
    while done < n:
        a = at >> 3
        z = min(len(raw) - 2, a + (1 << 15))
        if z <= a:
            raise ValueError("the stream ends too early")
        x = raw[a : z + 2].astype(np.uint32)
        word = x[: z - a] | x[1 : z - a + 1] << np.uint32(8) | x[2 : z - a + 2] << np.uint32(16)
        keys = ((word[:, None] >> shifts) & mask).reshape(-1)
        step, p, end = jump[keys].tolist(), at - 8 * a, 8 * (z - a)
        while p < end and done < n:
            where: list[int] = []
            add = where.append
            for _ in range(n - done):
                if p >= end:
                    break
                add(p)
                p += step[p]
            last = where.pop() if p >= stop else None
            got = symbols[keys[np.array(where, dtype=np.int64)]]
            out[done : done + len(got)] = got
            done += len(got)
            if last is not None:
                b.at = 8 * a + last + int(lens[keys[last]])
                length = _number(b, int(symbols[keys[last]]) - 256)
                d = _distance(_number(b, dist.read(b)), w)
                if d > done or done + length > n:
                    raise ValueError("a reference beyond the image")
                out[done : done + length] = np.resize(out[done - d : done], length)
                done += length
                p = b.at - 8 * a
        at = p + 8 * a
    if at > b.end:
        raise ValueError("the stream ends too early")
    b.at = at
    return out


def _image(b: Bits, w: int, h: int, main: bool) -> np.ndarray:
    """The entropy-coded pixels (uint32 ARGB, flat) of an image or of a transform's data."""
    cache_bits = b.read(4) if b.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    groups, block, wide = 1, 0, 1
    meta = None
    if main and b.read(1):
        block = b.read(3) + 2
        wide = (w + (1 << block) - 1) >> block
        meta = (_image(b, wide, (h + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(b, k) for k in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups)]
    n = w * h
    green, red, blue, alpha, dist = codes[0]
    if groups == 1 and not cache_size and None not in (red.only, blue.only, alpha.only):
        if green.only is not None:
            lit = np.full(n, green.only, dtype=np.uint8) if green.only < 256 else None
        else:
            lit = _fast(b, green, dist, n, w)
        if lit is not None:
            return lit.astype(np.uint32) << np.uint32(8) | np.uint32(alpha.only << 24 | red.only << 16 | blue.only)
    out: list[int] = []
    cache, shift = [0] * cache_size, 32 - cache_bits
    done = 0  # pixels that the cache holds
    while len(out) < n:
        p = len(out)
        if meta is not None:
            green, red, blue, alpha, dist = codes[meta[(p // w >> block) * wide + (p % w >> block)]]
        else:
            dist = codes[0][4]
        s = green.read(b)
        if s < 256:
            r, bl = red.read(b), blue.read(b)
            out.append(alpha.read(b) << 24 | r << 16 | s << 8 | bl)
        elif s < 280:
            length, d = _number(b, s - 256), _distance(_number(b, dist.read(b)), w)
            if d > p or p + length > n:
                raise ValueError("a reference beyond the image")
            for _ in range(length):
                out.append(out[-d])
        else:
            for v in out[done:]:
                cache[(v * _HASH & 0xFFFFFFFF) >> shift] = v
            done = p
            if s - 280 >= cache_size:
                raise ValueError("beyond the colour cache")
            out.append(cache[s - 280])
    return np.array(out, dtype=np.uint32)


def _channels(a: np.ndarray) -> np.ndarray:
    """(..., 4) of alpha, red, green, blue as int32."""
    return np.stack([(a >> np.uint32(k)) & np.uint32(255) for k in (24, 16, 8, 0)], -1).astype(np.int32)


def _argb(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _guess(mode: int, l, t, tl, tr):  # noqa: E741
    """A predictor of four-channel pixels."""
    avg = lambda a, b: (a + b) >> 1
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0], dtype=np.int32)
    if mode == 11:
        to_l, to_t = np.abs(t - tl).sum(), np.abs(l - tl).sum()
        return l if to_l < to_t else t
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        m = avg(l, t)
        d = m - tl
        return np.clip(m + np.where(d < 0, -(-d // 2), d // 2), 0, 255)
    return {1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(l, tl), avg(t, tr))}[mode]


def _predict(px: np.ndarray, w: int, h: int, bits: int, modes: np.ndarray) -> np.ndarray:
    c = _channels(px)
    wide = (w + (1 << bits) - 1) >> bits
    mode = (modes >> np.uint32(8) & np.uint32(15)).tolist()
    for y in range(h):
        for x in range(w):
            p = y * w + x
            if not p:
                g = np.array([255, 0, 0, 0], dtype=np.int32)
            elif not y:
                g = c[p - 1]
            elif not x:
                g = c[p - w]
            else:
                g = _guess(mode[(y >> bits) * wide + (x >> bits)], c[p - 1], c[p - w], c[p - w - 1], c[p - w + 1])
            c[p] = (c[p] + g) & 255
    return _argb(c)


def _uncross(px: np.ndarray, w: int, h: int, bits: int, data: np.ndarray) -> np.ndarray:
    c = _channels(px)
    wide = (w + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(w * h), w)
    m = _channels(data)[(y >> bits) * wide + (x >> bits)].astype(np.int8).astype(np.int32)
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    g = signed(c[:, 2])
    red = (c[:, 1] + ((m[:, 3] * g) >> 5)) & 255
    blue = (c[:, 3] + ((m[:, 2] * g) >> 5) + ((m[:, 1] * signed(red)) >> 5)) & 255
    c[:, 1], c[:, 3] = red, blue
    return _argb(c)


def decode(data: bytes) -> np.ndarray:
    """The (height, width) uint32 ARGB pixels of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    b = Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
    if b.read(8) != 0x2F:
        raise ValueError("no lossless stream")
    w, h = b.read(14) + 1, b.read(14) + 1
    b.read(1)
    if b.read(3):
        raise ValueError("unknown version")
    steps, width, seen = [], w, set()
    while b.read(1):
        kind = b.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind < 2:
            bits = b.read(3) + 2
            steps.append((kind, width, bits, _image(b, (width + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits, False)))
        elif kind == 2:
            steps.append((kind, width, 0, None))
        else:
            n = b.read(8) + 1
            table = _argb(np.cumsum(_channels(_image(b, n, 1, False)), 0))
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((kind, width, bits, table))
            width = (width + (1 << bits) - 1) >> bits
    px = _image(b, width, h, True)
    for kind, wide, bits, extra in reversed(steps):
        if kind == 0:
            px = _predict(px, wide, h, bits, extra)
        elif kind == 1:
            px = _uncross(px, wide, h, bits, extra)
        elif kind == 2:
            c = _channels(px)
            c[:, 1] += c[:, 2]
            c[:, 3] += c[:, 2]
            px = _argb(c)
        else:
            index = (px >> np.uint32(8) & np.uint32(255)).reshape(h, -1)
            per = 8 >> bits
            if bits:
                index = ((index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * np.uint32(per))) & np.uint32((1 << per) - 1)).reshape(h, -1)[:, :wide]
            table = np.concatenate([extra, np.zeros(256, dtype=np.uint32)])
            px = table[index].reshape(-1)
    return px.reshape(h, w)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most `most` bits for symbols with counts; a lone symbol gets 1."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) == 1:
        out[used] = 1
        return out
    least = 1
    while True:
        heap = [(max(int(counts[s]), least), k) for k, s in enumerate(used)]
        heapq.heapify(heap)
        up, made = [0] * (2 * len(used)), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            up[i] = up[j] = made
            heapq.heapreplace(heap, (a + b, made))
            made += 1
        depth = [0] * made
        for k in range(made - 2, -1, -1):
            depth[k] = depth[up[k]] + 1
        if max(depth[: len(used)], default=0) <= most:
            out[used] = depth[: len(used)]
            return out
        least *= 2


def write_code(b: Writer, lengths) -> None:
    """Stores a prefix code; runs of zeros are shortened."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1 and used[0] < 256:
        b.write(1 | 1 << 2 | used[0] << 3, 11)
        return
    lengths = [int(n) for n in lengths]
    parts, k = [], 0
    while k < len(lengths):
        run = k
        while run < len(lengths) and not lengths[run]:
            run += 1
        if (n := run - k) >= 11:
            n = min(n, 138)
            parts.append((18, n - 11, 7))
        elif n >= 3:
            parts.append((17, n - 3, 3))
        else:
            parts.append((lengths[k], 0, 0))
            n = 1
        k += n
    first = code_lengths(np.bincount([p[0] for p in parts], minlength=19), 7)
    table = {s: (c, n) for s, n, c in canonical(first)} if np.count_nonzero(first) > 1 else {parts[0][0]: (0, 0)}
    b.write(0, 1)
    b.write(15, 4)
    for s in _ORDER:
        b.write(int(first[s]), 3)
    b.write(0, 1)
    for s, extra, n in parts:
        c, m = table[s]
        b.write(c | extra << m, m + n)


def _bit_string(values: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int]:
    """Codes of up to 16 bits one after the other."""
    ends = np.cumsum(sizes)
    at = ends - sizes
    v = values.astype(np.uint64) << (at & 31).astype(np.uint64)
    n = (int(ends[-1]) >> 5) + 2
    words = np.bincount(at >> 5, weights=(v & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    words += np.bincount((at >> 5) + 1, weights=(v >> np.uint64(32)).astype(np.float64), minlength=n)[:n]
    return words.astype(np.uint64).astype("<u4").tobytes(), int(ends[-1])


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits' value, their number) of lengths or distance numbers from 1 on."""
    x = v - 1
    extra = np.where(x < 4, 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) - 1)
    symbol = np.where(x < 4, x, 2 * extra + 2 + (x >> extra & 1))
    return symbol, np.where(x < 4, 0, x - ((2 + (symbol & 1)) << extra)), extra


def _tokens(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits' value, their number): literals, and for runs of eight or more of one
    sample back-references of at most 4,096 to the sample before."""
    edges = np.flatnonzero(samples[1:] != samples[:-1]) + 1
    starts = np.append(0, edges)
    size = np.diff(np.append(starts, len(samples)))
    long = np.flatnonzero(size >= 8)
    if not len(long):
        zero = np.zeros(len(samples), dtype=np.int64)
        return samples.astype(np.int64), zero, zero
    inside = np.zeros(len(samples) + 1, dtype=np.int64)
    inside[starts[long] + 1] += 1
    inside[starts[long] + size[long]] -= 1
    keep = np.cumsum(inside)[:-1] == 0
    kept = np.flatnonzero(keep)
    at, n = [], []
    for s, m in zip(starts[long].tolist(), (size[long] - 1).tolist()):
        for k in range(0, m, 4096):
            at.append(s + 1 + k)
            n.append(min(4096, m - k))
    symbol, extra, bits = _prefix(np.array(n, dtype=np.int64))
    where = np.searchsorted(kept, np.array(at))
    zero = np.zeros(len(kept), dtype=np.int64)
    return np.insert(samples[kept].astype(np.int64), where, symbol + 256), np.insert(zero, where, extra), np.insert(zero, where, bits)


def _pixels(b: Writer, samples: np.ndarray, meta: bool = True) -> None:
    """Writes an image's entropy-coded green samples; red and blue are 0 and alpha is 255."""
    symbol, extra, bits = _tokens(samples)
    lengths = code_lengths(np.bincount(symbol, minlength=280), 12)
    b.write(0, 1 + meta)  # no colour cache, one group of codes
    write_code(b, lengths)
    for s in (0, 0, 255, 1):  # red, blue, alpha, distance: one to the left
        b.write(1 | 1 << 2 | s << 3, 11)
    if np.count_nonzero(lengths) > 1:
        codes = np.zeros(280, dtype=np.int64)
        for s, _, c in canonical(lengths):
            codes[s] = c
        data, n = _bit_string(codes[symbol] | extra << lengths[symbol], lengths[symbol] + bits)
        b.write(int.from_bytes(data, "little"), n)


def _entropy(samples: np.ndarray, width: int, palette: np.ndarray | None) -> bytes:
    """A file of green samples; with a palette of at most 16 of them, indexes packed into bytes."""
    b = Writer()
    b.write(0x2F, 8)
    b.write(width - 1, 14)
    b.write(len(samples) // width - 1, 14)
    b.write(0, 4)  # no alpha, version 0
    if palette is not None:
        b.write(1 | 3 << 1 | (len(palette) - 1) << 3, 11)
        b.write(0, 1)  # the palette's own colours, as differences from the one before
        steps = np.diff(palette.astype(np.int64), prepend=0) & 255
        table = code_lengths(np.bincount(steps, minlength=280), 12)
        alpha = code_lengths(np.bincount([255] + [0] * (len(steps) - 1), minlength=256), 12)
        write_code(b, table)
        for s in (0, 0):
            b.write(1 | 1 << 2 | s << 3, 11)
        write_code(b, alpha)
        b.write(1 | 1 << 2 | 1 << 3, 11)
        at = [{s: (c, n) for s, n, c in canonical(t)} if np.count_nonzero(t) > 1 else {} for t in (table, alpha)]
        for k, s in enumerate(steps.tolist()):
            b.write(*at[0].get(s, (0, 0)))
            b.write(*at[1].get(0 if k else 255, (0, 0)))
        bits = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1
        per, each = 1 << bits, 8 >> bits
        index = np.searchsorted(palette, samples).reshape(-1, width)
        index = np.pad(index, ((0, 0), (0, -width % per))).reshape(len(index), -1, per)
        samples = (index << (np.arange(per) * each)).sum(2).reshape(-1).astype(np.uint8)
    b.write(0, 1)  # no more transforms
    _pixels(b, samples)
    data = b.bytes()
    data += b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def encode_grey(payload: np.ndarray, width: int) -> bytes:
    """A file whose pixels have the payload's bytes as green samples; other samples are constant.
    Few different bytes are also tried as a palette; the shorter file is taken."""
    plain = _entropy(payload, width, None)
    palette = np.flatnonzero(np.bincount(payload, minlength=256))
    if len(palette) > 16:
        return plain
    return min(plain, _entropy(payload, width, palette), key=len)


def encode_payload(payload: bytes) -> bytes:
    """Lossless WebP files one after the other: rows of 576 samples, 1,024 rows a file at most."""
    x = np.frombuffer(payload, dtype=np.uint8)
    return b"".join(encode_grey(x[k : k + WIDTH * 1024], WIDTH) for k in range(0, len(x), WIDTH * 1024))


def decode_payload(media: bytes) -> list[np.ndarray]:
    """The pixels of each file in `media`."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append(decode(media[at : at + n]))
        at += n
    return out


def padded(text: str | None, unit: int = WIDTH) -> tuple[int, bytes]:
    """(bytes of the text, the text in UTF-8 filled with 255 to a positive multiple of `unit`)."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def feature(px: np.ndarray) -> str:
    """Width, height, mean, deviation and entropy of the samples, and a 64-bit hash: which of
    64 equal stretches are brighter than their median."""
    x = px.reshape(-1)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    means = np.add.reduceat(x, np.arange(64) * len(x) // 64, dtype=np.int64) / np.diff(np.arange(65) * len(x) // 64)
    bits = int.from_bytes(np.packbits(means > np.median(means)).tobytes(), "big")
    return f"{WIDTH}x{len(x) // WIDTH};mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum() + 0:.4f};hash={bits:016x}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as lossless WebP. No shuffle; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, z in slices(texts, 2 << 20):
                rows = [padded(t) for t in texts.slice(a, z - a).to_pylist()]
                media = [encode_payload(p) for _, p in rows]
                yield pa.RecordBatch.from_arrays([keys.slice(a, z - a), pa.array([n for n, _ in rows], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def pixels(media: DataFrame) -> DataFrame:
    """(doc_id, image, width, height, argb): the pixels of each image of a media column, row by row
    as little-endian 32-bit numbers."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(1)):
                for i, px in enumerate(decode_payload(raw.as_py())):
                    row = (pa.array([i], pa.int32()), pa.array([px.shape[1]], pa.int32()), pa.array([px.shape[0]], pa.int32()), pa.array([px.astype("<u4").tobytes()], pa.binary()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *row], ["doc_id", "image", "width", "height", "argb"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, image int, width int, height int, argb binary")


def describe(media: DataFrame) -> DataFrame:
    """Decodes a media column and computes sizes, checksums and features from the pixels."""
    kind = media.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(raw: bytes) -> tuple:
        x = np.concatenate([(px >> np.uint32(8)).astype(np.uint8).reshape(-1) for px in decode_payload(raw)])
        b = x.tobytes()
        return len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(one(m.as_py()) for m in batch.column(2)))) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text in a media table of the shared folder, reads that and describes it.

    Null and empty texts are 576 samples of 255; texts of more than 589,824 bytes take several
    images; null and repeated ids are carried along; no rows give none; other columns are ignored."""
    return describe(materialise(store(docs, id_col, text_col)))
