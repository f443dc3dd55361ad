"""Text cleaning as columns: steps are (pattern, replacement) lists, so that a chain is one
expression inside whole-stage code and the same list gives SQL for other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _pattern(short: str) -> str:
    """A pattern from its shorthand: ~ and _ are optional and required white space, #, #4 and #8
    digits, ¦ a bar, a point itself."""
    for mark, regex in ((".", r"\."), ("~", r"\s*"), ("_", r"\s+"), ("#4", r"\d{4}"), ("#8", r"\d{8}"), ("#?", r"\d*"), ("#", r"\d+"), ("¦", r"\|"),
                        ("<name>", "[A-Za-z0-9_-]+"), ("<rest>", r"[^\n]*"), ("<b>", r"\b"), ("<any>", r"\S*"), ("<feed>", r"\n"), ("<u>", "_")):
        short = short.replace(mark, regex)
    return short


_DATE = "/".join([r"\d{1,2}"] * 2 + [r"\d{2,4}"]) + ",?"
_CLOCK = ":".join([r"\d{1,2}", r"\d{2}"])

#: The second-generation steps, in their order; `strip` comes last.
V2 = {
    "c01_urls": [(r"(?i)https?://\S+", "")],
    "c02_timestamps": [(rf"(?i){_DATE}\s+{_CLOCK}(?::\d\d)?\s?(?:[AP]M)?\b", "")],
    "c03_html_files": [("(?i)" + _pattern("<name>.html?"), "")],
    "c04_sec_ids": [("(?i)" + _pattern("<b>[a-z]{2,10}-#8<b>"), "")],
    "c05_checkboxes": [("[☐☑☒□■✓✔]", "")],
    "c06_toc_link": [("(?i)^" + _pattern("~Table_of_Contents~") + "$", "")],
    "c07_unicode": [("[•–—]", "-"), ("…", "..."), ("[ \t]", " "), ("[“”]", '"'), ("[‘’]", "'")],
    "c08_spaces": [(" {2,}", " "), (_pattern("<feed>{3,}"), 2 * "\n")],
}
#: Page headers of issuers, in the order in which they go.
HEADERS = [_pattern(x) for x in """
Apple Inc.~¦~#4~Form~10-K~¦~#
Apple Inc.
Form~10-K
For the Fiscal Year Ended<rest>
JPMorgan Chase~&~Co./#4~#
Bank of America_#
#_Bank of America
^~10-K~$
Pfizer Inc.~#4~#
Goldman Sachs_#4_#
#_Goldman Sachs_#4
Alphabet Inc.
HP INC. AND SUBSIDIARIES
#_MASTERCARD_#4
MASTERCARD_#4_#
McDonald's Corporation_#4_Annual Report_#
Medtronic plc
NVIDIA CORPORATION AND SUBSIDIARIES
FY_#4_#
PayPal Holdings,~Inc.
#4_Annual Report_#
TARGET CORPORATION_#4_#
UNITED PARCEL SERVICE,~INC.~AND~SUBSIDIARIES
VISA INC.
""".strip().split("\n")]
#: What a browser leaves in a printed page.
ARTIFACTS = [_pattern(x) for x in """
<name>.htm
<name>.html
^~Document#?~$
#_JPMorgan Chase~&~Co./#4
<b>[a-z]{1,6}-#8<b>
#8~10K~FY<u>Taxonomy#4
(https?://)?sec.gov/Archives/edgar/data/<any>
""".strip().split("\n")]
#: The first-generation steps, in their order.
V1 = {
    "c09_urls": [(r"https?://\S+", "")],
    "c10_timestamps": [(rf"{_DATE}\s+{_CLOCK}\s?[AP]M", "")],
    "c11_page_numbers": [("^" + _pattern("~#.?~") + "$", ""), (_pattern("<b>#~/~#<b>"), "")],
    "c12_checkboxes": [("(?i)" + "|".join([r"\[x\]", r"\[_\]", "[☐☑☒□✓✔]"]), "")],
    "c13_headers": [("(?i)" + p, "") for p in HEADERS],
    "c14_artifacts": [("(?im)" + p, "") for p in ARTIFACTS],
    "c15_toc": [(r"(?i)Table\s+of\s+Contents", "")],
    "c16_spaces": [(r"[ \t]{2,}", " ")],
    "c17_blank_lines": [(_pattern("~".join(3 * ["<feed>"])) + "+", 2 * "\n")],
    "c18_unicode": [("[•–—]", "-"), ("…", "..."), (" ", " ")],
    "c19_quotes": [("[“”]", '"'), ("[‘’]", "'")],
    "c20_tabs": [("\t", " ")],
    "c21_lonely_numbers": [(r"(?m)^\s*\d+\s*$", "")],
}
#: Steps of the older first-generation chain that differ.
V1_OLD = {
    "c11_page_numbers": [(r"-\s*\d+\s*-", "")],
    "c12_checkboxes": [(r"[☐☑☒□✓✔]", "")],
    "c13_headers": [("(?i)" + p, "") for p in HEADERS[:8]],
    "c14_artifacts": [("(?im)" + p.replace("{1,6}", "{2,6}"), "") for p in ARTIFACTS],
    "c16_spaces": [(" {2,}", " ")],
}


def _java(pattern: str) -> str:
    """Python's meaning in Java: classes are Unicode, lines end at line feeds alone."""
    return "(?Ud)" + pattern


def apply(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, new in steps:
        c = F.regexp_replace(c, _java(pattern), new)
    return c


def clean(c: Column, steps: dict[str, list[tuple[str, str]]]) -> Column:
    for s in steps.values():
        c = apply(c, s)
    return strip(c)


def sql(column: str, steps: list[tuple[str, str]]) -> str:
    """The steps as DuckDB SQL."""
    for pattern, new in steps:
        column = "regexp_replace({}, '{}', '{}', 'g')".format(column, pattern.replace("'", "''"), new.replace("'", "''"))
    return column


def sql_strip(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '^\s+', ''), '\s+$', '')"


def repeat_key(c: Column) -> Column:
    """C-22: a trailing number becomes #."""
    return F.regexp_replace(c, r"(?Ud)\d+\s*$", "#")


def tokens(c: Column, lowercase: bool = False) -> Column:
    """C-24: runs of anything but white space."""
    return F.filter(F.split(F.lower(c) if lowercase else c, r"(?U)\s+"), lambda x: x != "")


def year_of_stem(c: Column) -> Column:
    """C-25: the first part before an underscore that is a year from 1990 to 2100."""
    good = F.filter(F.split(c, "_"), lambda x: x.rlike(r"^\d{4}$") & x.cast("int").between(1990, 2100))
    return F.get(good, F.lit(0)).cast("int")


def year_of_folder(c: Column) -> Column:
    """C-26."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")), F.lit("Unknown"))


def year_of_query(c: Column, v1: bool = False) -> Column:
    """C-27: the first year named."""
    return F.nullif(F.regexp_extract(c, r"\b20\d{2}\b" if v1 else r"\b(?:19|20)\d\d\b", 0), F.lit("")).cast("int")


def sentences(c: Column) -> Column:
    """C-23: cut at white space after a sentence mark and before a capital or a parenthesis."""
    return F.split(c, "(?U)(?<=[.!?])" + r"\s+" + "(?=[A-Z(])")
