"""Ops 2 and 3 against brute force; connected components; the top-k search."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import linededup, nearjoin, topk
from pagewright.llm.common import components
from tests.llm.data import corpus, empty, frame


def united(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0


def test_components(spark):
    r = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in r.integers(0, 120, (90, 2))] + [(k, k + 1) for k in range(200, 240)]
    got = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = united(241, pairs)
    touched = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_join(spark):
    rows = corpus()
    got = nearjoin.classes(frame(spark)).collect()
    assert len(got) == len(rows)
    norm = [tuple(w for w in re.split(r"[\W_]+", (r[1] or "").lower()) if w) for r in rows]
    texts = sorted({w for w in norm if w})
    sets = [frozenset(w[i : i + 3] for i in range(max(1, len(w) - 2))) for w in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.5]
    root = united(len(texts), links)
    least, number = defaultdict(list), Counter(x for p in links for x in p)
    for r, w in zip(rows, norm):
        if w and r[0] is not None:
            least[root[texts.index(w)]].append(r[0])
    want = Counter()
    for r, w in zip(rows, norm):
        k = texts.index(w) if w else None
        cls = min(least[root[k]], default=None) if w else r[0]
        want[r[0], cls, number[k] if w else 0] += 1
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    kept = nearjoin.keep_one(frame(spark))
    stay = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert stay == sorted({k for k, c, _ in want if k == c and k is not None})
    assert kept.columns == frame(spark).columns
    assert nearjoin.classes(empty(spark)).count() == 0 and nearjoin.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("group", [1 << 20, 500])
def test_line_dedup(spark, monkeypatch, group):
    """The lines that stay, and the links, as brute force has them; with the small group size most
    homes fall apart into bands and blocks."""
    monkeypatch.setattr(linededup, "GROUP", group)
    rows = corpus()
    got = linededup.report(frame(spark)).collect()
    assert len(got) == len(rows)
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    first = {}
    for known, k, t in order:
        for i, x in enumerate(t.split("\n")):
            if x.strip():
                first.setdefault(x, (known, k, i))
    lines = list(first)
    sets = [frozenset(x.lower()[i : i + 5] for i in range(len(x) - 4)) for x in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8]
    root = united(len(lines), links)
    group = defaultdict(list)
    for i, x in enumerate(lines):
        group[root[i]].append(first[x])
    keep = {min(g) for g in group.values()}
    assert links
    for r in got:
        src = next(x[1] for x in rows if x[0] == r.doc_id)
        if src is None:
            assert r.text is None and r.n_lines == 0
            continue
        want = [x for i, x in enumerate(src.split("\n")) if not x.strip() or (r.doc_id is not None, r.doc_id or 0, i) in keep]
        assert r.text == "\n".join(want), r.doc_id
        assert r.n_lines == sum(bool(x.strip()) for x in src.split("\n"))
    assert sum(r.n_links for r in {r.doc_id: r for r in got}.values()) == 2 * len(links)
    out = linededup.keep_lines(frame(spark))
    assert out.columns == frame(spark).columns and all(r.n_chars == len(r.text) for r in out.collect())
    assert linededup.report(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abİ日é", min_size=5, max_size=14), min_size=1, max_size=6), st.booleans())
def test_shingle_sets(lines, wide):
    """Similarities are those of sets of strings, whatever the alphabet."""
    lines = lines + ["".join(map(chr, range(0x4E00, 0x4E00 + 5000)))] * wide
    of, low = linededup._sets(lines), [x.lower() for x in lines]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in low]
    for i, x in enumerate(sets):
        assert len(of(i)) == len(x)
        assert all(linededup._common(of(i), of(j)) == len(x & y) for j, y in enumerate(sets))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc d", max_size=12), min_size=1, max_size=8))
def test_signatures_one_by_one(lines):
    """A line's signature doesn't depend on the lines beside it."""
    got = linededup.signatures(lines)
    assert all((got[i] == linededup.signatures([x])[0]).all() for i, x in enumerate(lines))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(-30, 30), min_size=4, max_size=4), min_size=1, max_size=60), st.integers(1, 12))
def test_index(vectors, k):
    m = np.array(vectors, dtype=np.int64)
    keys = np.arange(len(m)) // 2
    index = topk.Index(m)
    for i in range(min(5, len(m))):
        at, score = index.search(m[i], k, np.array([i]), keys)
        exact = m @ m[i]
        want = [j for j in np.lexsort((keys, -exact)) if j != i][:k]
        assert [(keys[j], s) for j, s in zip(at, score)] == [(keys[j], exact[j]) for j in want]


def test_search(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=8)]) for k in range(250)]
    rows += [(300, None), (301, [1.0, None]), (400, [float("nan")] * 8), (500, rows[7][1]), (7, rows[7][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "2 as score")
    got = topk.search(df, block=64, chunk=2).collect()
    good = [(k, np.floor(1024 * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64)) for k, v in rows if k is not None and v and None not in v and v[0] == v[0]]
    want = set()
    for i, (k, q) in enumerate(good):
        if k % 100 == 0:
            best = sorted((-int(v @ q), j) for n, (j, v) in enumerate(good) if n != i)[:10]
            want |= {(k, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert {tuple(x) for x in got} == want
    assert topk.search(df.limit(0)).count() == 0


def brute_top(rows, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None]
    out = set()
    for a, (i, q) in enumerate(good):
        if i % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if a != b)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_search_odd_tables(spark):
    """Huge components, a handful of rows, few dimensions, empty and ragged vectors."""
    tables = [
        [(0, [3e6] * 4), (1, [2e3] * 4), (2, [1.0, -2.0, 0.5, 0.0])] + [(k, [float(k)] * 4) for k in range(3, 60)],
        [(0, [1e12, 1.0]), (100, [-1e3, 2.0])] + [(k, [float(k % 7), -1.5]) for k in range(1, 30)],
        [(0, [0.5, 1.0]), (1, [1.0, 1.0])],
        [(0, [1.0]), (100, [2.0]), (3, [-1.0]), (4, [0.0])],
        [(0, []), (1, []), (2, [1.0])],
        [(100, [1.0, 2.0])],
    ]
    for rows in tables:
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert {tuple(x) for x in topk.search(df).collect()} == brute_top(rows), rows[:3]
    big = spark.createDataFrame([(0, [1e15] * 3), (1, [1e15] * 3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.search(big).collect()


def test_near_join_beside_copies(spark):
    """A group of near copies holds nearly all links; pairs just at the threshold are found all the same."""
    r = np.random.default_rng(11)
    new = lambda n: [f"w{x}" for x in r.integers(0, 1 << 60, n)]
    base, rows = new(100), []
    for k in range(120):  # J about 0.88 with each other
        w = list(base)
        w[int(r.integers(5, 95))] = f"own{k}"
        rows.append((k, " ".join(w)))
    for k in range(150):  # J 0.50 to 0.54
        common = new(42 + k % 3)
        rows += [(1000 + 2 * k + i, " ".join(common + new(62 - len(common)))) for i in (0, 1)]
    sets = {k: frozenset(zip(w, w[1:], w[2:])) for k, w in ((k, t.split()) for k, t in rows)}
    assert all(0.5 <= jaccard(sets[1000 + 2 * k], sets[1001 + 2 * k]) < 0.55 for k in range(150))
    got = {x.doc_id: x.class_id for x in nearjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(120)} == {0}
    assert sum(got[1001 + 2 * k] == 1000 + 2 * k for k in range(150)) >= 0.97 * 150


def test_work_of_a_family(spark, monkeypatch):
    """Near copies are compared by what they change, and their links, n x n / 2, are no edges of the
    search for components; links and classes are as brute force has them."""
    r = np.random.default_rng(4)
    base, rows = [f"w{x}" for x in r.integers(0, 1 << 60, 200)], []
    for k in range(90):
        w = list(base)
        for at in r.integers(3, 197, 2 if k % 3 else 16):
            w[int(at)] = f"own{k}x{at}"
        rows.append((k, " ".join(w)))
    coded, edges = [], []
    monkeypatch.setattr(nearjoin, "_coded", lambda members, sets, f=nearjoin._coded: coded.append(f(members, sets)) or coded[-1].cache())
    monkeypatch.setattr(nearjoin, "components", lambda e: edges.append(e.count()) or components(e))
    got = nearjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for _, t in rows)]
    links = [(i, j) for i in range(90) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.5]
    number, root = Counter(x for p in links for x in p), united(90, links)
    assert 2000 < len(links) < 90 * 89 / 2  # some pairs of much changed ones aren't linked
    assert {(x.doc_id, x.class_id, x.n_links) for x in got} == {(k, root[k], number[k]) for k in range(90)}
    assert edges[0] < 3 * 90
    sent = coded[0].collect()
    assert len(sent) >= 90 and np.mean([len(x.delta) for x in sent]) < 0.6 * np.mean([x.size for x in sent])


def test_bands_of_unlike_lines():
    """Lines far from the threshold seldom meet, as their number grows with the square of the lines';
    those right at it nearly always do."""
    r = np.random.default_rng(7)
    a, b = r.integers(0, 1 << 63, (2, 20_000, linededup.BINS), dtype=np.uint64)

    def met(j):
        return (linededup.band_hashes(a) == linededup.band_hashes(np.where(r.random(a.shape) < j, a, b))).any(1).mean()

    assert met(0.3) < 0.012 and met(0.8) > 0.985


def test_links_of_a_family():
    """Hundreds of near copies beside single lines: links as counted one by one."""
    r = np.random.default_rng(8)
    base, lines = list(map(chr, r.integers(97, 123, 150))), []
    for k in range(300):
        x = list(base)
        x[int(r.integers(len(x)))] = chr(0x400 + int(r.integers(60)))
        lines.append("".join(x) + "xyz"[k % 3])
    lines = list(dict.fromkeys(lines)) + ["".join(map(chr, r.integers(97, 110, 70))) for _ in range(40)]
    n, bands = len(lines), linededup.band_hashes(linededup.signatures(lines))
    got = linededup._links(np.zeros(n, dtype=int), np.arange(n), np.full(n, 3), np.full(n, (1 << linededup.BANDS) - 1), bands, lines, 0.8)
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    links = [(i, j) for i in range(n) for j in range(i) if (bands[i] == bands[j]).any() and jaccard(sets[i], sets[j]) >= 0.8]
    assert len(links) > 8 * n
    number, root = Counter(x for p in links for x in p), united(n, links)
    assert {i: (x, c) for i, x, c in zip(*(x.tolist() for x in got))} == {i: (root[i], c) for i, c in number.items()}


def test_bands_as_bytes(spark):
    """Bands travel as bytes, of the lines that have some, and come back from any slice; what fills an
    empty bin is the next one that isn't, also past the last bin."""
    r = np.random.default_rng(9)
    bands = r.integers(-(1 << 31), 1 << 31, (40, linededup.BANDS)).astype(np.int32)
    some = np.arange(40) % 3 > 0
    col = linededup._bytes(bands[some], some)
    assert [x is not None and len(x) for x in col.to_pylist()] == (4 * linededup.BANDS * some).tolist()
    whole = linededup._bytes(bands, np.ones(40, dtype=bool))
    for a, z in ((0, 40), (7, 21), (39, 40), (5, 5)):
        assert (linededup._numbers(whole.slice(a, z - a)) == bands[a:z]).all()
    assert dict(linededup.line_table(spark.createDataFrame([(1, 2, "a line")], "doc_id long, row long, text string")).dtypes)["bands"] == "binary"
    line = "abcdefgh" * 2 + "xyz"
    h = linededup._shingles(np.frombuffer(line.encode("utf-32-le"), dtype="<u4"), linededup.SHINGLE)
    own = {}
    for x in h.tolist():
        own[x >> 58] = min(x, own.get(x >> 58, x))
    far = [next(k for k in range(linededup.BINS) if (b + k) % linededup.BINS in own) for b in range(linededup.BINS)]
    want = [(own[(b + k) % linededup.BINS] + k * 0x632BE59BD9B4E019) % (1 << 64) for b, k in enumerate(far)]
    assert linededup.signatures(["", line])[1].tolist() == want
