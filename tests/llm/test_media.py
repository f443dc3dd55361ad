"""Ops 7, 8 and 10: archives, language models, images."""

import gzip
import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import ppm, warc, webp
from tests.llm.data import corpus, empty, frame

BIG = "<p>" + "x" * 2000 + "</p>"


def test_archives(spark):
    inner = warc.member(1, "u", b"y" * 50, "d", None) * 2  # an archive inside a page
    rows = [(1, "u1", BIG), (2, "u2", BIG), (3, None, BIG), (4, "u4", "short"), (5, "u5", "short"), (6, "a\r\nb", None), (7, "", ""), (None, "u", BIG), (8, "u8", "é" * 600), (9, "u9", inner.decode("latin-1"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as n", "3 as payload").repartition(2)
    for split in (1 << 20, 97):
        path_rows = warc.write_and_read(df).collect() if split > 100 else None
        if path_rows is None:
            from pagewright.llm.common import shared_dir

            path = shared_dir(spark)
            path_rows = warc.read_archives(spark, warc.write_archives(df, path), path, split=split, with_payload=True).collect()
        got = {r.page_id: r for r in path_rows}
        assert len(path_rows) == len(rows)
        for k, u, h in rows:
            raw = (h or "").encode()
            assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            again = h == BIG and k != 3
            assert (got[k].record_type, got[k].refers_to) == (("revisit", 3) if again else ("response", None))
        assert got[3].url is None and got[7].url == "" and got[1].url == "u1"
    assert warc.write_and_read(df.limit(0)).count() == 0


def test_scan_skips_false_members():
    real = warc.member(1, "u", b"a" * 100, "d", None)
    raw = gzip.compress(b"no record") + b"\x1f\x8b\x08junk" + real + warc.member(2, "v", b"b", "d", None)
    got = list(warc.scan(io.BytesIO(raw), 0, len(raw), len(raw)))
    assert got[0] == (0, None)  # the file doesn't begin with a record
    assert [warc.parse(r)["page_id"] for _, r in got[1:]] == [1, 2]


def foreign(kind, block, *more):
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", f"Content-Length: {len(block)}", *more]
    return gzip.compress("\r\n".join(["WARC/1.0", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_foreign_archives(spark, tmp_path):
    """Other writers' records: all types, no private headers, Base32 digests; damage is told."""
    body = b"HTTP/1.1 200 OK\r\ncontent-length: 3\r\n\r\nabc"
    http = "Content-Type: application/http; msgtype=response"
    records = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: <http://h/>"),
        foreign("response", body, http, "warc-target-uri: http://h/"),
        foreign("revisit", body[:-3], http, "WARC-Payload-Digest: sha1:VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5", "WARC-Refers-To: <urn:uuid:9>"),
        foreign("metadata", b"k: v"),
        foreign("resource", b"{}", "Content-Type: text/json"),
    ]
    good = b"".join(records)
    cut = records[0] + records[1][: len(records[1]) // 2] + records[2] + records[3][:20]
    (tmp_path / "a").write_bytes(good)
    (tmp_path / "b").write_bytes(cut)
    read = lambda name, n, split, **kw: warc.read_archives(spark, spark.createDataFrame([(name, n)], "name string, bytes long"), f"file://{tmp_path}", split, **kw).collect()
    for split in (1 << 20, 50):
        got = read("a", len(good), split, with_payload=True, with_ids=True)
        by = {r.record_type: r for r in got}
        assert len(got) == 6 and list(sorted(by)) == ["metadata", "request", "resource", "response", "revisit", "warcinfo"]
        assert by["response"].payload == b"abc" and by["response"].payload_digest == hashlib.sha1(b"abc").hexdigest()
        assert by["request"].url == "http://h/" and by["request"].payload == b"" and by["metadata"].payload == b"k: v"
        assert by["revisit"].payload_digest == hashlib.sha1(b"abc").hexdigest()
        assert by["revisit"].payload_bytes == 3 and by["revisit"].refers_to_id == "<urn:uuid:9>" and by["revisit"].page_id is None
        got = read("b", len(cut), split, damage="report")
        assert sorted(r.record_type for r in got) == ["damaged", "damaged", "response", "warcinfo"]
        with pytest.raises(Exception, match="no record at byte"):
            read("b", len(cut), split)


def test_language(spark):
    rows = [[k, t, lang, "s", 0] for k in range(120) for t, lang in [(("the cat and the dog went %d over the hill" % k, "en") if k % 2 else ("der hund und die katze gingen %d ueber den berg" % k, "de"))]]
    rows += [[900, None, "en", "s", 0], [901, "123 !!", "de", "s", 0], [902, "", None, "s", 0], [903, "the dog", None, "s", 0], [None, "der berg", None, "s", 0]]
    got = {r.doc_id: r for r in ppm.identify(frame(spark, rows)).collect()}
    for k, t, lang, _, _ in rows:
        assert got[k].held_out == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2)
        if t is None or not any(c.isalpha() for c in t):
            assert got[k].lang_pred == "und" and got[k].score == 0
        elif lang:
            assert got[k].lang_pred == lang and 0 <= got[k].score <= 1
    assert got[903].lang_pred == "en" and got[None].lang_pred == "de"
    kept = ppm.keep_identified(frame(spark, rows))
    assert kept.count() == len(rows) - 3 and kept.columns == frame(spark, rows).columns
    assert ppm.identify(empty(spark)).count() == 0


def test_language_sample_is_bounded(spark):
    """Repeated rows and ids don't exceed the bound; rows without an id are learned from."""
    rows = [[1, "the same text", "en", "s", 0]] * 9 + [[1, f"other {k}", "en", "s", 0] for k in range(5)] + [[None, f"keine nummer {k}", "de", "s", 0] for k in range(4)]
    got = ppm.train_sample(frame(spark, rows), "doc_id", "text", "lang", 3).collect()
    assert sorted(r.lang for r in got) == ["de"] * 3 + ["en"] * 3


def test_code_lengths_are_exact():
    rows = []
    for lang, text in (("a", "abracadabra"), ("b", "barbarabar")):
        b = b"\n\n" + text.encode()
        for k in (1, 2, 3):
            for i in range(2, len(b)):
                rows.append((lang, k, int.from_bytes(b[i - k + 1 : i + 1], "big"), 1))
    total = {}
    for lang, k, g, n in rows:
        total[lang, k, g] = total.get((lang, k, g), 0) + n
    m = ppm.build([(*k, n) for k, n in total.items()], 2)
    for i in range(len(m.suffix)):  # each state's probabilities add up to 1
        p = np.zeros(2)
        for x in range(m.symbols):
            at, cost = i, np.zeros(2)
            while m.at[at * m.symbols + x] < 0:
                cost, at = cost + m.escape[at], m.suffix[at]
            p += np.exp2(-cost - m.cost[m.at[at * m.symbols + x]])
        assert np.allclose(p, 1)

    def bits(lang, text):  # the definition, letter by letter
        b, out = b"\n\n" + text, 0.0
        for i in range(2, len(b)):
            ctx = bytes(b[i - 2 : i])
            out += -np.log2(_prob(total, lang, ctx, m.symbol, m.symbols)[m.symbol[b[i]]])
        return out

    for t in (b"abra", b"bar\xff", b"zz"):
        assert np.allclose(ppm.code_lengths(m, [t])[0], [bits("a", t), bits("b", t)])


def _prob(total, lang, ctx, symbol, symbols):
    lower = np.full(symbols, 1 / symbols) if not ctx else _prob(total, lang, ctx[1:], symbol, symbols)
    f = np.zeros(symbols)
    for (x, k, g), n in total.items():
        raw = g.to_bytes(k, "big")
        if x == lang and raw[:-1] == ctx:
            f[symbol[raw[-1]]] += n
    if not f.sum():
        return lower
    n, d = f.sum(), (f > 0).sum()
    rest = np.where(f > 0, 0, lower)
    if not rest.sum():
        return f / n
    return f / (n + d) + rest / rest.sum() * d / (n + d)


def literal_image(w, h, px, prefix=lambda b: None, cache=0):
    """A file of plain 8-bit codes, behind whatever `prefix` writes."""
    b = webp.Writer()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 1), (0, 3)):
        b.write(v, n)
    wide = prefix(b) or w
    b.write(0, 1)
    body(b, px, main=True)
    assert len(px) == wide * h
    raw = b.bytes()
    raw += b"\0" * (len(raw) % 2)
    return b"RIFF" + (12 + len(raw)).to_bytes(4, "little") + b"WEBPVP8L" + len(raw).to_bytes(4, "little") + raw


def body(b, px, main, cache=0, symbols=None):
    """Colour-cache flag, one group of codes and the pixels; symbols: (kind, ...) instead of pixels."""
    if cache:
        b.write(1, 1)
        b.write(cache, 4)
    else:
        b.write(0, 1)
    if main:
        b.write(0, 1)
    flat = [8] * 256
    size = 280 + ((1 << cache) if cache else 0)
    green = [9] * 256 + [0] * (size - 256) if symbols is None else [9] * 512 + [0] * 0
    if symbols is not None:
        green = [9] * size
        # fill up to a complete code
        room = 512 - size
        for i in range(room):
            green[i] = 8
    else:
        green = [8] * 256 + [0] * (size - 256)
    codes = [green, flat, flat, flat, [5] * 24 + [6] * 16 if symbols is not None else [1] + [0] * 39]
    tables = []
    for c in codes:
        webp.write_code(b, c)
        tables.append({s: (code, n) for s, n, code in webp.canonical(c)})
    put = lambda t, s: b.write(*tables[t][s])
    for item in symbols if symbols is not None else [("px", p) for p in px]:
        if item[0] == "px":
            p = item[1]
            put(0, p >> 8 & 255), put(1, p >> 16 & 255), put(2, p & 255), put(3, p >> 24)
        elif item[0] == "copy":
            put(0, 256 + item[1] - 1), put(4, item[2])
            for v, n in item[3:]:
                b.write(v, n)
        else:
            put(0, 280 + item[1])


def test_literals():
    r = np.random.default_rng(1)
    px = [int(x) for x in r.integers(0, 2**32, 12)]
    assert webp.decode(literal_image(4, 3, px)).reshape(-1).tolist() == px


def test_back_references_and_cache():
    b = webp.Writer()
    for v, n in ((0x2F, 8), (5, 14), (1, 14), (0, 1), (0, 3), (0, 1)):
        b.write(v, n)
    p, q = 0xFF112233, 0xFF445566
    key = lambda v: (v * 0x1E35A7BD & 0xFFFFFFFF) >> 28
    # two pixels; a run of 4 from one back (near code 2 is one to the left); the cached first; one above
    body(b, None, True, cache=4, symbols=[("px", p), ("px", q), ("copy", 4, 1), ("cache", key(p)), ("copy", 1, 0), ("px", q), ("px", p), ("px", p), ("px", q)])
    raw = b.bytes()
    raw += b"\0" * (len(raw) % 2)
    got = webp.decode(b"RIFF" + (12 + len(raw)).to_bytes(4, "little") + b"WEBPVP8L" + len(raw).to_bytes(4, "little") + raw).reshape(-1).tolist()
    assert got == [p, q, q, q, q, q, p, q, q, p, p, q]


def test_subtract_green_and_palette():
    px = [0x01020304, 0xFFFF01FF]

    def sub(b):
        b.write(1, 1), b.write(2, 2)

    assert webp.decode(literal_image(2, 1, px, sub)).reshape(-1).tolist() == [0x01050307, 0xFF000100]

    def palette(b):  # two colours, eight pixels a byte; the second is stored as a difference
        b.write(1, 1), b.write(3, 2), b.write(1, 8)
        body(b, [0xFF102030, 0x00010101], False)
        return 1

    got = webp.decode(literal_image(5, 1, [0b10110 << 8], palette)).reshape(-1).tolist()
    a, z = 0xFF102030, 0xFF112131
    assert got == [a, z, z, a, z]


def test_predictors_and_cross_colour():
    r = np.random.default_rng(2)
    w, h = 5, 4
    want = r.integers(0, 256, (h * w, 4)).astype(np.int32)
    for mode in range(14):
        res = np.empty_like(want)
        for p in range(w * h):
            y, x = divmod(p, w)
            if p == 0:
                g = np.array([255, 0, 0, 0])
            elif y == 0:
                g = want[p - 1]
            elif x == 0:
                g = want[p - w]
            else:
                g = webp._guess(mode, want[p - 1], want[p - w], want[p - w - 1], want[p - w + 1])
            res[p] = (want[p] - g) & 255

        def pre(b):
            b.write(1, 1), b.write(0, 2), b.write(1, 3)
            body(b, [mode << 8], False)

        got = webp.decode(literal_image(w, h, webp._argb(res).tolist(), pre)).reshape(-1)
        assert got.tolist() == webp._argb(want).tolist(), mode

    def cross(b):  # red gains green * 32 >> 5, blue green * 16 >> 5 and red * 32 >> 5
        b.write(1, 1), b.write(1, 2), b.write(0, 3)
        body(b, [32 << 16 | 16 << 8 | 32], False)

    got = webp.decode(literal_image(1, 1, [0xFF0A1405], cross)).reshape(-1).tolist()
    assert got == [0xFF000000 | (10 + 20) << 16 | 20 << 8 | (5 + 10 + 30)]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.text(alphabet="ab \n", max_size=3000).map(str.encode), st.lists(st.tuples(st.integers(0, 255), st.integers(1, 9000)), max_size=4).map(lambda x: b"".join(bytes([c]) * n for c, n in x))))
def test_payload_round_trip(raw):
    n, p = len(raw), raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    got = np.concatenate([x.reshape(-1) for x in webp.decode_payload(webp.encode_payload(p))])
    assert ((got >> 8) & 255).astype(np.uint8).tobytes() == p and n <= len(p)


def test_encoder_chooses_by_size():
    """Runs become back-references; few different bytes a palette of packed pixels; and what comes
    out by the fast way comes out by the general one too."""
    r = np.random.default_rng(4)
    few = r.choice(np.frombuffer(b"aaaaaaaaab", dtype=np.uint8), 5760)
    plain = r.integers(0, 256, 5760).astype(np.uint8)
    runs = np.concatenate([plain[:576], np.full(5000, 255, dtype=np.uint8), plain[:184]])
    assert len(webp.encode_grey(few, 576)) < len(webp._entropy(few, 576, None)) < 5760
    assert len(webp.encode_grey(np.full(5760, 255, dtype=np.uint8), 576)) < 80
    assert len(webp.encode_grey(runs, 576)) < 1100
    for x in (few, plain, runs, np.tile(plain[:700], 9)[:5760]):
        raw = webp.encode_grey(x, 576)
        got = webp.decode(raw)
        assert (got.reshape(-1) >> 8 & 255 == x).all()
        fast, webp._fast = webp._fast, lambda *a: None
        try:
            assert (webp.decode(raw) == got).all()
        finally:
            webp._fast = fast


def test_fast_way_with_any_distance():
    """Back-references of the general kind, to pixels before and above, among green literals."""
    b = webp.Writer()
    for v, n in ((0x2F, 8), (9, 14), (3, 14), (0, 4), (0, 1), (0, 1), (0, 1)):
        b.write(v, n)
    green, dist = [8] * 232 + [9] * 48, [5] * 24 + [6] * 16
    webp.write_code(b, green)
    for s in (0, 0, 255):
        b.write(1 | 1 << 2 | s << 3, 11)
    webp.write_code(b, dist)
    g, d = ({s: (c, n) for s, n, c in webp.canonical(x)} for x in (green, dist))
    for k in range(10):
        b.write(*g[k])
    b.write(*g[256 + 3]), b.write(*d[0])  # four from above
    b.write(*g[77])
    b.write(*g[256 + 4]), b.write(1, 1), b.write(*d[1])  # six from one to the left
    b.write(*g[256 + 6]), b.write(0, 2), b.write(*d[4]), b.write(1, 1)  # nine from near code 6
    for k in range(10):
        b.write(*g[100 + k])
    raw = b.bytes() + b"\0" * (len(b.bytes()) % 2)
    raw = b"RIFF" + (12 + len(raw)).to_bytes(4, "little") + b"WEBPVP8L" + len(raw).to_bytes(4, "little") + raw
    got = webp.decode(raw)
    fast, webp._fast = webp._fast, lambda *a: None
    try:
        assert (webp.decode(raw) == got).all()
    finally:
        webp._fast = fast
    assert (got.reshape(-1)[:21] >> 8 & 255).tolist() == [*range(10), 0, 1, 2, 3, *[77] * 7]


def test_pixel_arrays(spark):
    rows = [[1, "ab" * 900, "en", "s", 0], [2, None, "en", "s", 0]]
    got = {r.doc_id: r for r in webp.pixels(webp.store(frame(spark, rows))).collect()}
    for k, t, *_ in rows:
        r, p = got[k], webp.padded(t)[1]
        px = np.frombuffer(r.argb, dtype="<u4")
        assert (r.image, r.width, r.height) == (0, 576, len(p) // 576) and ((px >> 8 & 255).astype(np.uint8).tobytes(), set((px >> 24).tolist())) == (p, {255})


def test_damaged_files():
    good = webp.encode_payload(webp.padded("abc " * 900)[1])
    for bad in (b"RIFFxxxx", good[: len(good) // 2], good[:21] + b"\xff" * 40):
        with pytest.raises((ValueError, IndexError, KeyError)):
            webp.decode(bad)


def test_media(spark):
    got = {r.doc_id: r for r in webp.round_trip(frame(spark)).collect()}
    for k, t, *_ in corpus():
        n, p = webp.padded(t)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.media_sha256 == hashlib.sha256(webp.encode_payload(p)).hexdigest()
    assert got[3].feature == got[83].feature
    assert webp.round_trip(empty(spark)).count() == 0
