"""Headings from size, weight and wording (A-01, P-07, P-08, W-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config
from pagewright.functions import predicates as P
from pagewright.functions.clean import strip
from pagewright.operators.lines import DOC, by_page

ITALIC, BOLD = 2, 16


def has_flag(flags: Column | str, bit: int) -> Column:
    return F.coalesce(F.col(flags) if isinstance(flags, str) else flags, F.lit(0)).bitwiseAND(bit) != 0


def baseline_size(spans: DataFrame) -> DataFrame:
    """A-01: (doc, baseline_body_size): the most frequent size of plain text, rounded to a tenth;
    of equally frequent ones the first met. spans: doc, ord, text, size, flags."""
    plain = spans.where(~has_flag("flags", BOLD) & ~has_flag("flags", ITALIC) & (strip(F.col("text")) != ""))
    n = plain.groupBy(*DOC, F.bround("size", 1).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return n.groupBy(*DOC).agg(F.max_by("s", F.struct(F.col("n"), -F.col("first"))).alias("baseline_body_size"))


def score(text: Column, rel: Column, bold: Column, italic: Column, config: Config = DEFAULT) -> tuple[Column, Column]:
    """P-07: (score, reasons)."""
    both = scored(text, rel, bold, italic, config)
    return both["score"], both["reasons"]


def scored(text: Column, rel: Column, bold: Column, italic: Column, config: Config = DEFAULT) -> Column:
    """P-07 as one struct of score and reasons. What is read off the text is computed once a line: the
    lambda binds it, where plain columns would be computed again in each of their places."""
    t = strip(text)
    once = F.transform(F.array(t), lambda t: F.struct(t.alias("t"), P.words(t).alias("n"), _count(t, "L").alias("letters"), _count(t, "Lu").alias("capitals"), rel.alias("rel"), bold.alias("bold"), italic.alias("italic")))
    return F.get(F.transform(once, lambda f: _points(f, config)), F.lit(0))


def _count(t: Column, kind: str) -> Column:
    """Characters of a kind: what is left without the others."""
    return F.length(F.regexp_replace(t, rf"\P{{{kind}}}+", ""))


def _points(f: Column, config: Config) -> Column:
    t, n, letters, capitals, rel, bold, italic = (f[k] for k in ("t", "n", "letters", "capitals", "rel", "bold", "italic"))
    core = F.regexp_replace(t, r"\.+$", "")
    numbering = core.rlike(r"^\p{Nd}+$") | core.rlike(r"(?i)^[IVXLCDM]+$") | core.rlike(r"^[A-Za-z]*\s*\d+$")
    dangling = (n == 1) & t.endswith(".") & ~numbering
    steps = [  # (condition, points, reason); the first of a group that holds counts
        [(bold, 3, "bold"), (italic, 2, "italic")],
        [(rel >= 1.5, 3, "much_larger_than_body"), (rel >= 1.15, 2, "larger_than_body"), (rel >= 0.98, 1, "body_size_but_styled"), (F.lit(True), -2, "smaller_than_body")],
        [(n <= config.heading_words, 2, "short"), (n <= config.long_words, 0, None), (F.lit(True), -3, "too_long")],
        [(t.endswith(".") & (n > 3), -2, "ends_like_sentence")],
        [(capitals >= 0.9 * letters, 1, "all_caps")],
    ]
    points, reasons = F.lit(0), []
    for group in steps:
        p = r = None
        for cond, k, name in group:
            p = F.when(cond, k) if p is None else p.when(cond, k)
            r = F.when(cond, F.lit(name)) if r is None else r.when(cond, F.lit(name))
        points = points + p.otherwise(0)
        reasons.append(r)
    none = F.array().cast("array<string>")
    total = F.when((t == "") | (letters == 0) | dangling, 0).otherwise(points)
    why = (
        F.when(t == "", none)
        .when(letters == 0, F.array(F.lit("no_letters")))
        .when(dangling, F.array(F.lit("dangling_sentence_fragment")))
        .otherwise(F.array_compact(F.array(*reasons)))
    )
    return F.struct(total.alias("score"), why.alias("reasons"))


def level(text: Column, rel: Column, bold: Column, italic: Column) -> Column:
    """P-08."""
    return (
        F.when(rel >= 1.5, 1).when(P.is_marker(strip(text)), 2).when(italic & (rel < 1.15), 4).when(bold, 3).otherwise(4)
    )


def detect(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds is_bold, is_italic, relative_size, score, reasons, is_heading, level and
    baseline_body_size to lines with text, size and flags."""
    base = baseline_size(lines.withColumn("ord", F.struct("page_index", "line_index").cast("struct<a:long,b:long>")).withColumn("ord", F.col("ord.a") * (1 << 24) + F.col("ord.b")))
    x = lines.join(base, DOC, "left").withColumn("baseline_body_size", F.coalesce("baseline_body_size", F.lit(config.fallback_size)))
    bold = has_flag("flags", BOLD)
    x = x.withColumns({"is_bold": bold, "is_italic": has_flag("flags", ITALIC) & ~bold, "relative_size": F.col("size") / F.col("baseline_body_size")})
    x = x.withColumn("_s", scored(F.col("text"), F.col("relative_size"), F.col("is_bold"), F.col("is_italic"), config))
    x = x.withColumns({"score": F.col("_s.score"), "reasons": F.col("_s.reasons")}).drop("_s")
    x = x.withColumn("is_heading", F.col("score") >= config.heading_score)
    x = x.withColumn("level", F.when(F.col("is_heading"), level(F.col("text"), F.col("relative_size"), F.col("is_bold"), F.col("is_italic"))).otherwise(0))
    return suppress_bold_runs(x)


def suppress_bold_runs(x: DataFrame) -> DataFrame:
    """W-11: after a long bold line without a full stop, bold lines are no headings until a line
    ends with one or isn't bold. Each line opens, closes or leaves the run, so the last line that
    did either decides."""
    end = strip(F.col("text")).endswith(".")
    opens = F.col("is_bold") & ~F.col("is_heading") & F.array_contains("reasons", "too_long") & ~end
    event = F.when(opens, True).when(~F.col("is_bold") | end, False)
    before = F.coalesce(F.last("_event", ignorenulls=True).over(by_page().rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    x = x.withColumn("_event", event).withColumn("_out", before & F.col("is_bold") & F.col("is_heading"))
    return x.withColumns(
        {
            "reasons": F.when(F.col("_out"), F.array_append("reasons", F.lit("continuation_of_bold_sentence"))).otherwise(F.col("reasons")),
            "level": F.when(F.col("_out"), 0).otherwise(F.col("level")),
            "is_heading": F.col("is_heading") & ~F.col("_out"),
        }
    ).drop("_event", "_out")
