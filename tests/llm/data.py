"""Small corpora with the awkward cases: nulls, empty and long texts, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns of the operators' own names, which they must not trip over.
CLASH = ["id", "key", "row", "start", "size", "n", "block", "band", "h", "target", "pass", "a", "b", "d", "whole", "lines", "kept", "blank", "of", "g", "x", "y", "letter", "lang_pred", "score", "rows", "_rows", "_key", "_src", "_id", "_of", "_k", "_n", "_nth", "_text", "_segs", "_size", "_passes", "_bits", "_lines", "_kept", "_row", "_row_key", "_n_lines", "_n_kept", "_lang_pred", "_letter", "_spread", "_at", "_bucket", "a.b c"]


def words(r, n):
    return [r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma tau".split()) + r.choice(["", "n", "ra", "to", "li"]) for _ in range(n)]


def corpus(n=60, seed=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        lines = [" ".join(words(r, r.randint(6, 30))) + "." for _ in range(r.randint(1, 6))]
        out.append([k, "\n".join(lines), "en" if k % 2 else "de", f"src{k % 4}" if k % 9 else "hot", 0])
    for k in range(n, n + 20):  # near copies of earlier documents
        w = out[k - n][1].split(" ")
        for _ in range(max(1, len(w) // 40)):
            w[r.randrange(len(w))] = "changed"
        out.append([k, " ".join(w), "en", "hot", 0])
    out += [[n + 20 + k, out[3][1], "en", "hot", 0] for k in range(5)]  # exact copies
    out += [[200, None, None, None, None], [201, "", "en", "src0", 0], [202, "  \n\t ", "en", "src0", 0], [203, "!!! 123", "en", None, 0]]
    out += [[204, " ".join(words(r, 4000)), "en", "src1", 0], [205, "x", "en", "src1", 0], [None, "no id here at all, sir", "en", "src2", 0]]
    out += [[206, "the same row twice in it", "en", "src2", 0]] * 2
    return out


def frame(spark, rows=None, clash=True):
    df = spark.createDataFrame(corpus() if rows is None else rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(7) for c in CLASH}) if clash else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
