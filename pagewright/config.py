"""Every threshold of the engine in one place, with its default."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    # headings
    heading_score: int = 5
    heading_words: int = 12
    long_words: int = 24
    fallback_size: float = 9.0
    # table candidates
    numeric_ratio: float = 0.30
    near_lines: int = 2
    near_gap: float = 80.0
    row_gap: float = 6.0
    header_zone: float = 150.0
    header_x: float = 20.0
    header_words: int = 5
    label_gap: float = 40.0
    label_words: int = 15
    # table parsing
    column_x: float = 20.0
    text_column_x: float = 45.0
    region_gap: float = 100.0
    header_rows: int = 15
    text_header_rows: int = 14
    real_table: float = 0.4
    # paragraphs
    paragraph_gap: float = 14.0
    paragraph_indent: float = 25.0
    boilerplate_pages: int = 5
    boilerplate_share: float = 0.3
    # chunks
    chunk: int = 1200
    overlap: int = 150
    least_chunk: int = 15
    v1_overlap: int = 200
    # retrieval
    floor: float = 0.58
    top_k: int = 5
    pool: int = 100
    fuse_pool: int = 30
    fuse_k: int = 60
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


DEFAULT = Config()
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
RECENCY = r"\b(" + "|".join("most recent, latest, current, this year, last fiscal year, newest, up[- ]to[- ]date".split(", ")) + r")\b"
UNKNOWN = tuple("tesla amazon google microsoft meta nvidia netflix walmart jpmorgan citigroup pfizer".split())
V1_COMPANIES = tuple("Apple Microsoft Amazon Google Meta Tesla NVIDIA".split())
#: Section and its keywords; the first section that has one in the text counts.
SECTIONS = {
    k: tuple(v.split("|"))
    for k, v in (
        ("Risk Factors", "risk factors|item 1a"),
        ("Business", "item 1. business|company background|products|markets and distribution"),
        ("MD&A", "management's discussion|item 7|results of operations|financial condition"),
        ("Revenue", "net sales|total net sales|disaggregated revenue|product performance|services net sales|iphone net sales"),
        ("Income Statement", "statements of operations|net income|operating income|gross margin|earnings per share"),
        ("Balance Sheet", "balance sheets|total assets|cash and cash equivalents|total liabilities|shareholders' equity"),
        ("Cash Flow", "cash flows|operating activities|investing activities|financing activities"),
        ("Financial Statements", "notes to consolidated financial statements|item 8|summary of significant accounting policies"),
        ("Services", "applecare|apple music|apple tv+|icloud|digital content|advertising|payment services"),
    )
}
