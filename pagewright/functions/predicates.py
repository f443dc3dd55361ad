"""Predicates and small classifiers as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.config import RECENCY, SECTIONS, V1_COMPANIES
from pagewright.functions.clean import _CLOCK, _DATE, strip

_BAR, _FEW, ITEM = r"\|", r"\d{1,4}", r"Item\s+\d+"
BYLINE = "(?i)^.{1,80}" + r"\s*".join([_BAR, r"\d{4}", "Form", "10-K", _BAR, _FEW]) + "$"
TIMESTAMP = rf"(?i)^{_DATE}\s+{_CLOCK}(?::\d\d)?\s?(?:[AP]M)?$"
FRACTION = "^" + r"\s*/\s*".join([_FEW, _FEW]) + "$"
URL = r"(?i)https?://\S+"
MARKER = rf"(?i)^PART\s+[IVXLCDM]+\b|^{ITEM}[A-Za-z]?\."
FRAGMENT = "(?i)^(" + "|".join([ITEM + r"[A-Za-z]?\.?", r"[IVXLCDM]+\.", r"[A-Za-z]?\d+\."]) + ")$"
FLOAT = r"(?i)^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?\s*$|^\s*[+-]?(nan|inf|infinity)\s*$"


def is_byline(c: Column) -> Column:
    return strip(c).rlike(BYLINE)


def is_timestamp(c: Column) -> Column:
    return strip(c).rlike(TIMESTAMP)


def is_document_word(c: Column) -> Column:
    return F.lower(strip(c)) == "document"


def has_url(c: Column) -> Column:
    return c.rlike(URL)


def is_fraction(c: Column) -> Column:
    return strip(c).rlike(FRACTION)


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))


def numeric_token(c: Column) -> Column:
    """P-11: digits alone, once signs, commas, points and parentheses are taken out."""
    return F.regexp_replace(c, r"(?U)[$,.\-+()%\s]", "").rlike(r"^\p{Nd}+$")


def numeric_cell(c: Column) -> Column:
    """P-12."""
    return ~strip(c).isin(*"$-—%()", "--") & numeric_token(c)


def numeric_value(c: Column) -> Column:
    """P-13: what Python's float() would read without , $ % and parentheses; a dash is none."""
    x = strip(F.translate(c, ",$%()", ""))
    return ~x.isin("", "-", "—", "–", "--") & x.rlike(FLOAT)


def is_year(c: Column) -> Column:
    """P-14."""
    return strip(c).rlike(r"^\d{4}$") & F.try_to_number(F.lpad(F.substring(strip(c), 1, 4), 4, "0"), F.lit("9999")).between(1900, 2100)


def is_marker(c: Column) -> Column:
    """P-09."""
    return c.rlike(MARKER)


def is_fragment(c: Column) -> Column:
    """P-10: a heading that reads like the end of a sentence."""
    x = strip(c)
    return (words(x) <= 4) & x.endswith(".") & ~x.rlike(FRAGMENT)


def section(c: Column) -> Column:
    """P-21: the first section one of whose keywords is in the text."""
    low = F.lower(c)
    cases = [F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in ks]), F.lit(s)) for s, ks in SECTIONS.items()]
    return F.coalesce(*cases, F.lit("Unknown"))


def v1_company(c: Column) -> Column:
    """P-23."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(x.lower())), F.lit(x)) for x in V1_COMPANIES], F.lit(None).cast("string"))


def recent(c: Column) -> Column:
    """P-25."""
    return c.rlike("(?i)" + RECENCY)


def v1_heading(c: Column) -> Column:
    """P-26: an item line, or a short line in capitals."""
    x = strip(c)
    caps = (F.upper(x) == x) & x.rlike(r"\p{Lu}") & (F.length(x) < 80) & (words(x) <= 8)
    return (F.length(x) >= 4) & (x.rlike(f"(?i)^{ITEM}" + r"[A-Z]?\.") | caps)
