"""Ids of byte-level BPE vocabularies for whole Arrow columns of text.

A space with no white space on either side always begins a new pre-token in this kind of
vocabulary, so a text falls apart at such spaces into units whose ids don't depend on their
surroundings, unless a text has the string of an added token: such a text is given to the
tokenizers library whole. Units repeat a lot: each batch is cut and dictionary-encoded by Arrow, and the
tokenizers library only sees the units that a worker hasn't met."""

from __future__ import annotations

import ctypes
import gc
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,;:!?"


def _byte_alphabet() -> dict[int, str]:
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary: what it remembers outlives a task."""
    return Encoder(path)


def forget() -> None:
    """Drop the worker's encoders and give their memory back to the system. Workers outlive a stage:
    tasks that encode nothing call this first, or they'd run beside all that was remembered."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
        if trim:
            trim(0)


class Encoder:
    """Encodes texts to uint16 ids (vocabularies beyond 65,536 ids are refused).

    path: a byte-level BPE file of the tokenizers library without normaliser and prefix space.
    keep: units that a worker remembers; when full, the older half is forgotten."""

    def __init__(self, path: str, keep: int = 1_600_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("more than 65,536 ids")
        self.model, self.keep = self.tok.model, keep
        self.alphabet = _byte_alphabet()
        self.seen: dict[str, bytes] = {}
        #: The same for units that follow a space, without that space.
        self.after: dict[str, bytes] = {}

    def _piece(self, s: str) -> bytes:
        if s.isascii():  # letters are themselves in the byte alphabet, and only a space is not
            s = s.replace(" ", self.alphabet[32])
        else:
            s = s.encode().decode("latin-1").translate(self.alphabet)
        return array("H", [t.id for t in self.model.tokenize(s)]).tobytes()

    def _ids(self, unit: str) -> bytes:
        """The ids of a unit, with its leading space if it has one."""
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha():  # one pre-token
            return self._piece(unit)
        stem = body.rstrip(_MARKS)
        if stem.isalpha():  # one of letters and one of marks
            return self._unit(unit[: len(unit) - len(body) + len(stem)]) + self._unit(body[len(stem) :])
        if "\n" in body:  # a line feed between other characters is a pre-token of its own
            first, *rest = body.split("\n")
            if first and all(p and not p[0].isspace() for p in rest) and not any(p[-1].isspace() for p in (first, *rest)):
                feed = self._unit("\n")
                return self._unit(unit[: len(unit) - len(body) + len(first)]) + b"".join(feed + self._unit(p) for p in rest)
        return array("H", self.tok.encode(unit, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        seen, key = (self.after, unit[1:]) if unit[:1] == " " else (self.seen, unit)
        got = seen.get(key)
        if got is None:
            got = self._ids(unit)
            if len(unit) <= 48:
                if len(self.seen) + len(self.after) >= self.keep:
                    for d in (self.seen, self.after):
                        for k in list(d)[: -(-len(d) // 2)]:
                            del d[k]
                seen[key] = got
        return got

    def _slow(self, text: str) -> np.ndarray:
        """A text with runs of white space: cut only at the spaces that are surely borders."""
        first, *rest = _CLEAN_SPACE.split(text)
        return np.frombuffer(self._unit(first) + b"".join(self._unit(" " + u) for u in rest), dtype="<u2")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """uint16 ids of each text; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if n == 0:
            return []
        held, whole = texts, np.zeros(n, dtype=bool)
        for t in self.added:
            whole |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if whole.any():
            texts = pc.if_else(pa.array(whole), "", texts)
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        d = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        # no unit has a space, and one string is parted faster than many are made
        every = pa.ListArray.from_arrays(pa.array([0, len(d.dictionary)], pa.int32()), d.dictionary)
        units, idx = pc.binary_join(every, pa.scalar(" ", pa.large_string()))[0].as_py().split(" "), d.indices.to_numpy().copy()
        vals: list[bytes] = list(map(self.after.get, units))
        for k in [k for k, x in enumerate(vals) if x is None]:
            u = units[k]  # what has no ids is left to _slow
            vals[k] = self._unit(" " + u) if u and not u[0].isspace() and not u[-1].isspace() else b""
        firsts = offsets[:-1]
        # the first unit of a text has no space before it
        vals += [self._unit(units[i]) if vals[i] else b"" for i in idx[firsts].tolist()]
        idx[firsts] = len(units) + np.arange(n)
        lens = np.fromiter(map(len, vals), dtype=np.int64, count=len(vals)) // 2
        flat = np.frombuffer(b"".join(vals), dtype="<u2")
        at = np.cumsum(lens) - lens
        ul = lens[idx]
        ends = np.cumsum(ul)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total < 1 << 30 else np.int64
        take = np.repeat((at[idx] - (ends - ul)).astype(kind), ul)
        take += np.arange(total, dtype=kind)
        ids = flat[take]
        bounds = np.concatenate([[0], ends])[offsets]
        bad = np.add.reduceat(ul == 0, firsts, dtype=np.int64) > 0
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for k in np.flatnonzero(bad):
            s = texts[int(k)].as_py()
            out[k] = self._slow(s) if s else np.empty(0, dtype="<u2")
        for k in np.flatnonzero(whole):  # the library finds added tokens before it cuts
            out[k] = np.array(self.tok.encode(held[k].as_py(), add_special_tokens=False).ids, dtype="<u2")
        return out


def slices(col: pa.Array, most: int = 4 << 20):
    """(start, stop) row ranges of a text column with about `most` bytes each, one row at least."""
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(size):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += int(n)
    if len(size):
        yield start, len(size)
