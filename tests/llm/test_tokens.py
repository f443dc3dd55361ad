"""Ops 4 and 5: ids against the tokenizers library, packing, file round trips."""

import io
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import idfiles, packing
from pagewright.llm.queries import TOKENIZER
from pagewright.llm.tokens import Encoder
from tests.llm.data import corpus, empty, frame

ENC = Encoder(TOKENIZER)
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\na", "it's 's x", "12 3a b1 ²x x² _a a_", "<|endoftext|> a", "trail ", "a.\nb c.\n\nd e\n f", "don't.\n's x", "日本 語", "x\tb c\r\nd e", "é̂ éx naïve,, -- ..."]


def direct(text):
    return ENC.tok.encode(text or "", add_special_tokens=False).ids


def test_odd_texts():
    for t, got in zip(ODD, ENC.encode(pa.array(ODD))):
        assert list(got) == direct(t), t


def test_added_tokens():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(TOKENIZER)  # the library's defaults, whatever the encoder sets
    texts = ["end <|endoftext|> next", "plain a b", "<|endoftext|>", None, "a<|endoftext|><|endoftext|> b  c", "<|endoftext"]
    got = [list(x) for x in ENC.encode(pa.array(texts))]
    assert got[0] == [437, 220, 50256, 1306]
    assert got == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t'.,1_😀", max_size=25), min_size=1, max_size=6))
def test_any_text(texts):
    for t, got in zip(texts, ENC.encode(pa.array(texts))):
        assert list(got) == direct(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=120))
def test_windows(sizes):
    sets = packing.windows(sizes, 1024)
    assert all(sum(n for _, _, n in s) <= 1024 for s in sets)
    got = defaultdict(list)
    for s in sets:
        for i, start, n in s:
            got[i].append((start, n))
    for i, size in enumerate(sizes):
        at = 0
        for start, n in sorted(got[i]):
            assert start == at and n > 0
            at += n
        assert at == size
    assert len(sets) <= -(-sum(sizes) // 1024) * 1.01 + 1


def test_difference_is_near_equal():
    sets = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in s) for s in sets) in ([14, 16], [15, 15])


def test_pack(spark):
    rows = packing.pack(frame(spark), TOKENIZER, with_ids=True).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and len(r.ids) == r.length
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for text, key in ((r[1], r[0]) for r in corpus()):
        ids = direct(text) + [0]
        own = sorted((r.start, r.length, r.ids) for r in docs[key])
        if key == 206:  # the repeated row
            assert sum(n for _, n, _ in own) == 2 * len(ids)
            continue
        assert [x for _, _, p in own for x in p] == ids and all(r.doc_tokens == len(ids) for r in docs[key])
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_files(spark):
    got = idfiles.encode_and_read(frame(spark), TOKENIZER, file_ids=2000, block_ids=700).collect()
    want = sorted(((r[0] is not None, r[0] or 0), np.array(direct(r[1]) + [0], dtype="<u4").tobytes()) for r in corpus())
    at = 0
    for r, (key, raw) in zip(sorted(got, key=lambda r: r.start), want):
        assert (r.doc_id is not None, r.doc_id or 0) == key
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(raw) // 4, zlib.crc32(raw))
        at += r.n_tokens
    assert len(got) == len(want) and len({r.file for r in got}) > 1
    assert idfiles.encode_and_read(empty(spark), TOKENIZER).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_number_code(values):
    v = np.array(values, dtype=np.uint32)
    assert (idfiles.decode_numbers(*idfiles.encode_numbers(v), len(v)) == v).all()
    f = io.BytesIO(idfiles.block(np.array([5]), np.array([True]), np.array([len(v)]), v))
    keys, valid, lens, ranks = next(idfiles.blocks(f))
    assert keys[0] == 5 and valid[0] and lens[0] == len(v) and (ranks == v).all()


def test_bad_file():
    with pytest.raises(ValueError):
        next(idfiles.blocks(io.BytesIO(b"x" * 64)))


def test_units_forgotten():
    """Units that follow a space are kept apart from others; with room for few, ids stay right."""
    enc = Encoder(TOKENIZER, keep=6)
    texts = [t or "" for t in (r[1] for r in corpus(12))] + ODD
    for _ in range(2):
        assert [list(x) for x in enc.encode(pa.array(texts))] == [direct(t) for t in texts]
        assert enc.after and len(enc.seen) + len(enc.after) <= 6
    assert not any(u.startswith(" ") for u in [*enc.seen, *enc.after])


def test_ids_counted_at_once():
    """Ids are read from a column's bytes, whatever slice it is, and not row by row."""
    rows = [np.array(x, dtype="<u2") for x in ([1, 2, 65535], [], [7] * 9, [3])]
    col = pa.array([x.tobytes() for x in rows], pa.binary())
    for c in (col, col.cast(pa.large_binary())):
        assert [x.tolist() for x in idfiles.flat_ids(c)] == [[1, 2, 65535] + [7] * 9 + [3]]
        assert np.concatenate(list(idfiles.flat_ids(c.slice(1, 3), 4))).tolist() == [7] * 9 + [3]
        assert list(idfiles.flat_ids(c.slice(0, 0))) == [] and list(idfiles.flat_ids(c.slice(1, 1))) == []


def test_difference_by_arrays():
    """Merging two partitions takes a number of Python steps that doesn't depend on that of their sets."""
    import sys

    sizes, steps = [3 + 37 * i % 250 for i in range(200)], Counter()

    def trace(frame, event, arg):
        if frame.f_code is not packing.difference.__code__:
            return None
        frame.f_trace_opcodes = True
        steps[event] += 1
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        sets = packing.difference(sizes, 64)
    finally:
        sys.settrace(before)
    assert sorted(i for s in sets for i in s) == list(range(200)) and len(sets) == 64
    assert 0 < steps["opcode"] < 200 * 64 * 5


def test_encoder_ends_with_its_stage(spark, monkeypatch):
    """A worker serves all stages: what the encoder remembers doesn't stay beside another's tasks."""
    import weakref
    from contextlib import suppress

    from pagewright.llm import linededup, ppm
    from pagewright.llm.tokens import encoder

    docs, runs = frame(spark), []
    texts = spark.createDataFrame([], "id long, chars long, bands binary")

    def taken(self, run, schema):
        runs.append(run)
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(type(docs), "mapInArrow", taken)
    linededup.line_table(docs.selectExpr("doc_id", "0L as row", "text"))
    linededup._members(texts)  # two
    linededup._verify(texts, 0.8)
    ppm.grams(docs, "text", "lang", 3)
    ppm.predict(docs, ppm.build([], 3))
    assert len(runs) == 6
    for run in runs:
        held = weakref.ref(encoder(TOKENIZER))
        with suppress(StopIteration):
            next(run(iter([])))
        assert held() is None
