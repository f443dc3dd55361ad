"""Language identification by prediction by partial matching (op 8)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import materialise, nested, unnested
from pagewright.llm.tokens import forget, slices

#: Rows of two numbers that are broadcast at most.
_FEW = 100_000


@dataclass
class Model:
    """Frozen statistics: a context's state is the longest suffix of the last `order` symbols in
    the tree. at[state * symbols + symbol] is the row of `cost` with that symbol's code length in
    bits for each language, or -1 if no language saw it after the context: then `escape` of the
    state is paid and the state's `suffix` asked."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol; the bytes never seen in training share the last one
    symbols: int
    order: int
    state: np.ndarray  # symbols of the context as digits -> state
    at: np.ndarray
    cost: np.ndarray
    escape: np.ndarray
    suffix: np.ndarray


def train_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> DataFrame:
    """At most `per_lang` whole documents a language, those with the least hash of id and text.

    Hashes are ranked in 64 parts of a language and then over them, so no task ranks a whole
    language; the chosen hashes, `per_lang` a language, are broadcast if there are few languages,
    and the texts of repeated rows are ranked again."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(id_col, text_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def first(df: DataFrame, *by: str | Column) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*by).orderBy("key"))
        return df.withColumn("n", n).where(F.col("n") <= per_lang).drop("n")

    keys = first(first(rows.select("key", "lang"), "lang", F.pmod("key", F.lit(64))), "lang").distinct()
    keys = materialise(keys)
    few = keys.count() <= _FEW
    chosen = rows.join(F.broadcast(keys) if few else keys, ["key", "lang"], "left_semi")
    return first(chosen, "lang").select(F.col("text").alias(text_col), F.col("lang").alias(lang_col))


def grams(sample: DataFrame, text_col: str, lang_col: str, order: int) -> DataFrame:
    """(lang, gram, n): counts of every run of 1 to order + 1 bytes; a text begins after `order`
    line feeds. Texts are lower-cased."""
    width = order + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total: dict[tuple[str, int, int], int] = defaultdict(int)
        for batch in batches:
            for text, lang in zip(pc.utf8_lower(batch.column(0)).to_pylist(), batch.column(1).to_pylist()):
                b = np.frombuffer(b"\n" * order + text.encode(), dtype=np.uint8).astype(np.int64)
                if len(b) <= order:
                    continue
                for k in range(1, width + 1):
                    code = np.zeros(len(b) - order, dtype=np.int64)
                    for j in range(k):
                        at = order - (k - 1) + j
                        code = code << 8 | b[at : at + len(code)]
                    for g, n in zip(*(x.tolist() for x in np.unique(code, return_counts=True))):
                        total[lang, k, g] += n
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())],
            ["lang", "k", "gram", "n"],
        )

    return sample.select(text_col, lang_col).mapInArrow(run, "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))


def build(rows: list[tuple[str, int, int, int]], order: int) -> Model:
    """The model from gram counts; every context that occurred is in the tree.

    A symbol that followed a context c of n occurrences and d distinct symbols k times has
    probability k / (n + d); the escape, d / (n + d), is shared by the others in proportion to
    their probabilities after the context's suffix; below the empty context all symbols are
    alike. So each state's probabilities add up to 1 for each language. Only symbols that some
    language saw after a context have a row of costs there; the others' probability is the
    suffix's times one factor of the context."""
    langs = sorted({r[0] for r in rows})
    wide = max(1, len(langs))
    number_of = {x: k for k, x in enumerate(langs)}
    seen = sorted({r[2] for r in rows if r[1] == 1} | {10})  # the line feed is every text's first context
    symbols = len(seen) + 1
    symbol = np.full(256, symbols - 1, dtype=np.int64)
    symbol[seen] = np.arange(len(seen))
    follow: dict[tuple, dict[int, np.ndarray]] = {(): {}}
    for lang, k, gram, n in rows:
        raw = [int(symbol[gram >> (8 * j) & 255]) for j in reversed(range(k))]
        of = follow.setdefault(tuple(raw[:-1]), {}).setdefault(raw[-1], np.zeros(wide))
        of[number_of[lang]] += n
    contexts = sorted(follow, key=lambda c: (len(c), c))
    number = {c: i for i, c in enumerate(contexts)}
    at = np.full(len(contexts) * symbols, -1, dtype=np.int32)
    costs, escape, suffix = [], np.zeros((len(contexts), wide)), np.zeros(len(contexts), dtype=np.int32)
    prob: dict[tuple, np.ndarray] = {}  # of contexts that may be suffixes
    flat = np.full((symbols, wide), 1 / symbols)
    made = 0
    for c, i in number.items():
        shorter = next((c[cut:] for cut in range(1, len(c) + 1) if c[cut:] in number), None)
        suffix[i] = -1 if shorter is None else number[shorter]
        lower = flat if shorter is None else prob[shorter]
        f = np.zeros((symbols, wide))
        for x, n in follow[c].items():
            f[x] = n
        n, d = f.sum(0), (f > 0).sum(0)
        rest = np.where(f > 0, 0, lower)
        left = rest.sum(0)
        full = np.where(left > 0, 0, 1)  # every symbol seen: nothing to escape to
        own = f / np.maximum(1, n + d * (1 - full))
        esc = np.where(left > 0, d / np.maximum(1, n + d) / np.where(left > 0, left, 1), 0)
        esc = np.where(n > 0, esc, 1)
        got = np.where(n > 0, own + rest * esc, lower)
        have = sorted(follow[c]) if shorter is not None else list(range(symbols))
        at[i * symbols + np.array(have, dtype=np.int64)] = made + np.arange(len(have))
        made += len(have)
        with np.errstate(divide="ignore"):
            costs.append(-np.log2(got[have]))
            escape[i] = -np.log2(esc)  # infinite only where all symbols have rows
        if len(c) < order:
            prob[c] = got
    state = np.zeros((symbols,) * order, dtype=np.int32)
    for c, i in number.items():  # shorter contexts first; longer ones overwrite their part
        state[(slice(None),) * (order - len(c)) + c] = i
    return Model(langs, symbol, symbols, order, state.reshape(-1), at, np.concatenate(costs), escape, suffix)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits that each language's statistics need for each text: (texts, languages)."""
    order, m = model.order, model.symbols
    lead = b"\n" * order
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros((len(texts), model.cost.shape[1]))
    if not sizes.sum():
        return out
    b = model.symbol[np.frombuffer(b"".join(lead + t for t in texts), dtype=np.uint8)]
    ctx = np.zeros(len(b) - order, dtype=np.int64)
    for j in range(order):
        ctx = ctx * m + b[j : j + len(ctx)]
    state, sym = model.state[ctx], b[order:]
    owner = np.repeat(np.arange(len(texts)), sizes)
    where = np.arange(len(owner)) + np.repeat(np.arange(len(texts)) * order, sizes)
    state, sym = state[where].astype(np.int64), sym[where]
    row = model.at[state * m + sym]
    open_ = np.flatnonzero(row < 0)
    while len(open_):  # a context without the symbol: pay its escape, ask its suffix
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(owner[open_], weights=model.escape[state[open_], k], minlength=len(texts))
        state[open_] = model.suffix[state[open_]]
        row[open_] = model.at[state[open_] * m + sym[open_]]
        open_ = open_[row[open_] < 0]
    starts = np.cumsum(sizes) - sizes
    for k, (s, n) in enumerate(zip(starts, sizes)):
        if n:
            out[k] += model.cost[row[s : s + n]].sum(0)
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(d, lang_pred, score, bits_per_byte): each row as a struct, and what is predicted of it.

    The language with the least code length of the whole lower-cased text is predicted, the
    first in order of code points on a tie. score: its posterior probability, were all languages
    as likely before, with code lengths divided by the square root of the bytes so that long
    texts don't all end at 1; bits_per_byte: its code length a byte. Null texts and texts without
    a letter are `und` with score 0 and null bits_per_byte; so is everything, if nothing was
    learned."""
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    src = docs.select(nested(docs), letter.alias("letter"))
    schema = T.StructType([T.StructField("d", src.schema["d"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model = shared.value
        for whole in batches:
            for a, z in slices(pc.struct_field(whole.column(0), text_col), 1 << 19):
                batch = whole.slice(a, z - a)
                texts = pc.fill_null(pc.utf8_lower(pc.struct_field(batch.column(0), text_col)), "").to_pylist()
                texts = [t.encode() for t in texts]
                use = np.array(batch.column(1).to_pylist(), dtype=bool) & bool(model.langs)
                bits = code_lengths(model, [t if u else b"" for t, u in zip(texts, use)])
                size = np.array([max(1, len(t)) for t in texts])
                best = bits.argmin(1)
                low = bits.min(1)
                weight = np.exp2(-np.minimum((bits - low[:, None]) / np.sqrt(size)[:, None], 1000))
                score = 1 / weight.sum(1)
                pred = [model.langs[k] if u else "und" for k, u in zip(best, use)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(use, score, 0.0)), pa.array(low / size, pa.float64(), mask=~use)],
                    schema.names,
                )

    return src.mapInArrow(run, schema)


def held_out(id_col: str) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, order: int = 3) -> Model:
    """Trains on at most `per_lang` documents of each language that aren't held out.

    That bound is all that limits training; the gram counts that reach the driver are bounded
    by it too."""
    sample = train_sample(docs.where(~held_out(id_col)), id_col, text_col, lang_col, per_lang)
    rows = grams(sample, text_col, lang_col, order).collect()
    return build([tuple(r) for r in rows], order)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) of every row.

    Null ids count as not held out. Repeated rows get equal results; no rows give none; other
    columns are ignored."""
    model = learn(docs, id_col, text_col, lang_col, **kw)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).select("d.doc_id", "d.held_out", "lang_pred", "score", "bits_per_byte")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **kw) -> DataFrame:
    """The documents whose language could be told, with their columns whatever their names: those
    that are `und`, of null text or without a letter, go."""
    model = learn(docs, id_col, text_col, lang_col, **kw)
    return unnested(predict(docs, model, text_col).where("lang_pred <> 'und'"), docs, {})
