"""Table lines and tables (W-01, W-02, J-05, J-06, W-12; W-07..10, ST-01..04, J-07, J-08)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.config import DEFAULT, Config
from pagewright.functions import predicates as P
from pagewright.functions.clean import strip
from pagewright.operators.lines import PAGE, by_page


def numeric_ratio(cells: Column) -> tuple[Column, Column, Column]:
    """A-07: (ratio, numeric, tokens) of a line's span texts, blank ones left out."""
    parts = F.filter(cells, lambda c: strip(c) != "")
    tokens, numeric = F.size(parts), F.size(F.filter(parts, P.numeric_token))
    return F.when(tokens > 0, numeric / tokens).otherwise(0.0), numeric, tokens


def with_cells(lines: DataFrame) -> DataFrame:
    """PR-04, PR-05, A-07: adds to lines with text, spans and bbox: cells (text, x, bold by rising x;
    a span without a place has the line's, a line without spans is one plain cell), x, y (null
    without a place), xs, numeric_ratio, numeric and tokens."""
    known = F.size("bbox") >= 4
    x = F.when(known, F.get("bbox", F.lit(0))).otherwise(0.0)
    place = lambda s: F.when(F.size(s["bbox"]) >= 4, F.get(s["bbox"], F.lit(0))).otherwise(x)
    bold = lambda s: F.coalesce(s["flags"], F.lit(0)).bitwiseAND(16) != 0
    spans = F.transform("spans", lambda s, i: F.struct(place(s).alias("x"), i.alias("i"), strip(s["text"]).alias("text"), bold(s).alias("bold")))
    alone = F.array(F.struct(x.alias("x"), F.lit(0).alias("i"), strip(F.col("text")).alias("text"), F.lit(False).alias("bold")))
    parts = F.filter(F.when(F.size("spans") > 0, spans).otherwise(alone), lambda c: c["text"] != "")
    cells = F.transform(F.array_sort(parts), lambda c: F.struct(c["text"].alias("text"), c["x"].alias("x"), c["bold"].alias("bold")))
    out = lines.withColumns({"cells": cells, "x": x, "y": F.when(known, F.get("bbox", F.lit(1)))})
    ratio, numeric, tokens = numeric_ratio(F.transform("cells", lambda c: c["text"]))
    return out.withColumns({"xs": F.transform("cells", lambda c: c["x"]), "numeric_ratio": ratio, "numeric": numeric, "tokens": tokens})


def candidates(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds cand1..cand4 and the promotions to lines with text, x (least x), xs (all x), y and
    numeric_ratio. Each pass only reads what earlier passes found."""
    w = by_page()
    y, c = F.col("y"), config
    near = F.lit(0)
    for k in range(1, c.near_lines + 1):
        for f in (F.lag, F.lead):
            ok = (f("numeric_ratio", k).over(w) >= c.numeric_ratio) & (F.abs(f("y", k).over(w) - y) <= c.near_gap)
            near = near + F.when(ok, 1).otherwise(0)
    x = lines.withColumn("nearby_numeric_lines", near)
    wide = F.size(F.array_distinct("xs")) >= 2
    x = x.withColumn("cand1", (F.col("numeric_ratio") >= c.numeric_ratio) & ((F.col("nearby_numeric_lines") >= 1) | wide))
    # pass 2: level with a candidate
    def any_within(col: str, low: str, high: str) -> Column:
        """Whether a line of the page has `col` at a y between the bounds."""
        return F.expr(f"max(cast({col} as int)) over (partition by {', '.join(PAGE)} order by y range between {low} and {high})") == 1

    mate = any_within("cand1", f"{c.row_gap}D preceding", f"{c.row_gap}D following")
    x = x.withColumn("promoted_as_row_label", ~F.col("cand1") & y.isNotNull() & (strip(F.col("text")) != "") & mate)
    x = x.withColumn("cand2", F.col("cand1") | F.col("promoted_as_row_label"))
    # pass 3: a short line above the first figures, level in x with a candidate's cell
    below = any_within("cand1", "0.000000001D following", f"{c.header_zone}D following")
    page = Window.partitionBy(*PAGE)
    spots = F.flatten(F.collect_list(F.when(F.col("cand2"), F.col("xs"))).over(page))
    aligned = F.exists(F.array_distinct("_spots"), lambda s: F.abs(s - F.col("x")) <= c.header_x)
    t = strip(F.col("text"))
    x = x.withColumns({"_spots": spots, "_below": below})
    short = (t != "") & (P.words(t) <= c.header_words) & ~t.endswith(".")
    x = x.withColumn("promoted_as_header_fragment", F.coalesce(~F.col("cand2") & y.isNotNull() & short & F.col("_below") & aligned, F.lit(False)))
    x = x.withColumn("cand3", F.col("cand2") | F.col("promoted_as_header_fragment"))
    # pass 4: lines that lead into a candidate; from each line on, the first that is one or
    # breaks the chain decides
    n = P.words(t)
    link = F.coalesce((n >= 1) & (n <= c.label_words) & (F.abs(F.lead("y").over(w) - y) <= c.label_gap), F.lit(False))
    event = F.when(F.col("cand3"), True).when(~link, False)
    x = x.withColumn("_event", event)
    final = F.coalesce(F.first("_event", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(False))
    x = x.withColumn("promoted_as_label_continuation", final & ~F.col("cand3"))
    return x.withColumn("cand4", F.col("cand3") | F.col("promoted_as_label_continuation")).drop("_spots", "_below", "_event")


# ---- the geometry of a page, folded in order: one page at a time, never across pages ----

_DASHES = {"-", "--", "—"}
_LONE = _DASHES | set("$%()")


@lru_cache(1 << 16)
def _numeric(text: str) -> bool:
    s = text.strip()
    if s in _LONE:
        return False
    return s.isdigit() or re.sub(r"[$,.\-+()%\s]", "", s).isdigit()


def _year(text: str) -> bool:
    if len(text) < 4:
        return False
    s = text.strip()
    return len(s) == 4 and s.isdigit() and 1900 <= int(s) <= 2100


def _box(a: list[float] | None, b: list[float] | None) -> list[float] | None:
    """A-05: the box around two boxes, of which any may be unknown."""
    if not a or not b:
        return a or b
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def _x(cell: dict) -> float:
    return cell["x"]


def group_rows(lines: list[dict], gap: float) -> list[dict]:
    """ST-01: by rising y, a line joins the first row whose mean y is within `gap`; lines without a
    place are left out. A line too far below a row is followed by none that is nearer, so only the
    last row is open."""
    rows: list[dict] = []
    for ln in sorted((v for v in lines if v["y"] is not None), key=lambda v: v["y"]):
        row = rows[-1] if rows else None
        if row is None or not abs(ln["y"] - row["y"]) <= gap:
            rows.append({"y": ln["y"], "n": 1, "cells": list(ln["cells"]), "box": ln.get("box")})
            continue
        row["n"] += 1
        row["y"] += (ln["y"] - row["y"]) / row["n"]
        row["cells"] += ln["cells"]
        row["box"] = _box(row["box"], ln.get("box"))
    rows.sort(key=lambda r: r["y"])
    for r in rows:
        if len(r["cells"]) > 1:
            r["cells"].sort(key=_x)
    return rows


def _bold(row: dict) -> bool:
    return any(c["bold"] for c in row["cells"])


def _figures(row: dict) -> bool:
    return any(_numeric(c["text"]) for c in row["cells"])


def _wraps(rows: list[dict], k: int) -> bool:
    """Whether a row may be a label's part that goes on below: it has words, no figure and no colon
    at its end, and isn't a bold title above plain rows."""
    if _figures(rows[k]):
        return False
    words = " ".join(c["text"] for c in rows[k]["cells"]).strip()
    if not words or words.endswith(":"):
        return False
    return not _bold(rows[k]) or (k + 1 < len(rows) and _bold(rows[k + 1]))


def merge_labels(rows: list[dict]) -> list[dict]:
    """ST-02: a run of rows that may wrap joins the row with figures right below it, if the run and
    that row are alike in having something bold."""
    out: list[dict] = []
    k = 0
    while k < len(rows):
        end = k
        while end < len(rows) and _wraps(rows, end):
            end += 1
        run = rows[k:end]
        if run and end < len(rows) and _figures(rows[end]) and any(map(_bold, run)) == _bold(rows[end]):
            whole = dict(rows[end])
            whole["cells"] = sorted((c for r in [*run, rows[end]] for c in r["cells"]), key=lambda c: c["x"])
            for r in run:
                whole["box"] = _box(whole.get("box"), r.get("box"))
            out.append(whole)
            k = end + 1
        else:
            out += run or [rows[k]]
            k += max(1, len(run))
    return out


def regions(rows: list[dict], gap: float) -> list[list[dict]]:
    """W-07 and W-08: parted at wide gaps, and before rows that hold two years or more."""
    out: list[list[dict]] = []
    for k, r in enumerate(rows):
        if k == 0 or r["y"] - rows[k - 1]["y"] > gap or sum(_year(c["text"]) for c in r["cells"]) >= 2:
            out.append([])
        out[-1].append(r)
    return out


def year_header(rows: list[dict], most: int) -> int | None:
    """W-09: the row with most years, bold ones and the first row counting more."""
    best, at = 0, None
    for k, r in enumerate(rows[:most]):
        years = [c for c in r["cells"] if _year(c["text"])]
        if len(r["cells"]) >= 2 and len(years) >= 2:
            s = 2 * len(years) + 2 * sum(c["bold"] for c in years) + 2 * (k == 0)
            if s > best:
                best, at = s, k
    return at


def text_header(rows: list[dict], most: int, near: float) -> tuple[int, list[dict]] | None:
    """ST-03: the rows before the first that is half figures, clustered by x into columns."""
    first = None
    for k, r in enumerate(rows[: most + 1]):
        if r["cells"] and sum(_numeric(c["text"]) for c in r["cells"]) / len(r["cells"]) >= 0.5:
            first = k
            break
    if not first:
        return None
    clusters: list[dict] = []
    for c in (c for r in rows[:first] for c in r["cells"]):
        word = c["text"].strip()
        if not word or word in _DASHES | {"$"}:
            continue
        hit = next((g for g in clusters if abs(g["x"] - c["x"]) <= near), None)
        if hit is None:
            clusters.append({"x": c["x"], "text": word})
        else:
            hit["text"] += " " + word
    clusters = sorted((g for g in clusters if not re.fullmatch(r"\(\d+\)", g["text"])), key=lambda g: g["x"])  # footnote marks
    if len(clusters) > 2 and clusters[0]["x"] < 100:  # what stands above the labels
        clusters = clusters[1:]
    return (first, clusters) if len(clusters) >= 2 else None


def data_row(cells: list[dict], columns: list[dict], near: float, margin: float) -> dict | None:
    """J-07 and J-08: each column takes its nearest cell within `near`; what lies more than
    `margin` left of the columns is the label. Columns and cells left over are paired in order if
    there are as many. Lone symbols are neither label nor value, but dashes are values."""
    values: dict[str, str | None] = {}
    used: set[int] = set()
    edge = columns[0]["x"] - margin
    words = [c["text"].strip() for c in cells]
    places = [(c["x"], i) for i, c in enumerate(cells) if words[i] not in _LONE or words[i] in _DASHES]
    for col in columns:
        at, best = col["x"], None
        for x, i in places:
            far = abs(x - at)
            if far <= near and (best is None or far < best[0]):
                best = far, i
        values[col["text"]] = words[best[1]] if best else None
        if best:
            used.add(best[1])
    open_ = [c for c in columns if values[c["text"]] is None]
    spare = [i for x, i in places if i not in used and x >= edge]
    if len(open_) == len(spare):
        for col, i in zip(open_, spare):
            values[col["text"]] = words[i]
    label = " ".join(words[i] for i, c in enumerate(cells) if c["x"] < edge and words[i] not in _LONE).strip()
    if not (label or any(v is not None for v in values.values())):
        return None
    return {"label": label, "values": [{"col": k, "val": v} for k, v in values.items()]}


def _found(kind: str, columns: list[dict], rows: list[dict]) -> dict:
    return dict(header=[g["text"] for g in columns], header_detected=True, column_type=kind, rows=rows)


def parse_region(rows: list[dict], config: Config = DEFAULT) -> dict:
    """ST-04: by years, else by a header of words, else as it stands."""
    c = config
    at = year_header(rows, c.header_rows)
    if at is not None:
        cols = sorted(({"x": v["x"], "text": v["text"].strip()} for v in rows[at]["cells"] if _year(v["text"])), key=lambda g: g["x"])
        got = [d for k, r in enumerate(rows) if k != at and (d := data_row(r["cells"], cols, c.column_x, c.column_x))]
        if len(cols) >= 2 and got:
            return _found("year", cols, got)
    found = text_header(rows, c.text_header_rows, c.column_x)
    if found:
        first, cols = found
        got = [d for r in rows[first:] if (d := data_row(r["cells"], cols, c.text_column_x, c.text_column_x))]
        if got:
            return _found("text_label", cols, got)
    raw = [{"label": None, "values": None, "cells": [{"text": v["text"], "x": v["x"]} for v in r["cells"]]} for r in rows]
    return {"header": [], "header_detected": False, "column_type": None, "rows": raw}


def parse_page(lines: list[dict], config: Config = DEFAULT) -> list[dict]:
    """All tables of a page from its candidate lines (y, cells of text, x, bold, and box)."""
    rows = group_rows(lines, config.row_gap)
    if len(rows) < 2:
        return []
    out = []
    for region in regions(merge_labels(rows), config.region_gap):
        if len(region) >= 2:
            box = None
            for r in region:
                box = _box(box, r["box"])
            out.append(parse_region(region, config) | {"bbox": box})
    return out


TABLE_ROWS = "array<struct<label:string,values:array<struct<col:string,val:string>>,cells:array<struct<text:string,x:double>>>>"


def parse(lines: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Tables of all pages. lines: candidates with y and cells, and page_number and bbox if known. A
    page is gathered by one aggregation and folded in Arrow batches of pages; no page meets
    another."""
    box = F.col("bbox") if "bbox" in lines.columns else F.lit(None).cast("array<double>")
    number = F.col("page_number") if "page_number" in lines.columns else F.lit(None)
    pages = lines.groupBy(*PAGE).agg(F.max(number.cast("int")).alias("page_number"), F.array_sort(F.collect_list(F.struct("line_index", F.col("y").cast("double").alias("y"), "cells", F.when(F.size(box) >= 4, box.cast("array<double>")).alias("box")))).alias("lines"))
    schema = f"company string, file_name string, page_index int, page_number int, table_index int, header array<string>, header_detected boolean, column_type string, row_count int, column_count int, bbox array<double>, rows {TABLE_ROWS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, _PAGES):
                yield _batch([(*page, n, t) for *page, lines_ in _pages(b.slice(k, _PAGES)) for n, t in enumerate(parse_page(lines_, config))])

    return pages.select(*PAGE, "page_number", "lines").mapInArrow(run, schema)


#: Pages of one slice: what a Python worker holds as objects.
_PAGES = 256


def _parts(lists: pa.ListArray) -> tuple[list[int], pa.Array]:
    """Where each list begins among the values, and the values."""
    at = lists.offsets.to_numpy()
    return (at - at[0]).tolist(), lists.values.slice(at[0], at[-1] - at[0])


def _plain(a: pa.Array) -> list:
    """As to_pylist, but for text and for columns without nulls not value by value."""
    return a.to_numpy(zero_copy_only=False).tolist() if not a.null_count or pa.types.is_string(a.type) else a.to_pylist()


def _pages(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(company, file_name, page_index, page_number, lines) of pages, read column by column."""
    keys = zip(*map(_plain, batch.columns[:4]))
    page_at, lines = _parts(batch.column(4))
    cell_at, cells = _parts(lines.field("cells"))
    boxed = lines.field("box")
    box_at, corners = _parts(boxed)
    corners, known = _plain(corners), _plain(boxed.is_valid())
    every = [{"text": t, "x": x, "bold": b} for t, x, b in zip(*(_plain(cells.field(c)) for c in ("text", "x", "bold")))]
    ys = _plain(lines.field("y"))
    rows = [{"y": y, "cells": every[cell_at[i] : cell_at[i + 1]], "box": corners[box_at[i] : box_at[i + 1]] if known[i] else None} for i, y in enumerate(ys)]
    for i, key in enumerate(keys):
        yield *key, rows[page_at[i] : page_at[i + 1]]


def _lists(lists: list, kind: pa.DataType) -> pa.ListArray:
    return _listed([None if x is None else len(x) for x in lists], pa.array([v for x in lists if x for v in x], kind))


def _listed(lengths: list[int | None], values: pa.Array) -> pa.ListArray:
    at = np.cumsum([0, *(n or 0 for n in lengths)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), values, mask=pa.array([n is None for n in lengths], pa.bool_()))


def _structs(lists: list[list[dict] | None], **kinds: pa.DataType) -> pa.ListArray:
    every = [v for x in lists if x for v in x]
    fields = [pa.array([v[k] for v in every], t) for k, t in kinds.items()]
    return _listed([None if x is None else len(x) for x in lists], pa.StructArray.from_arrays(fields, list(kinds)))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    """(company, file_name, page_index, page_number, table_index, table) as columns."""
    company, file_name, page, number, index, found = zip(*out) if out else [[]] * 6
    rows = [r for t in found for r in t["rows"]]
    parts = {
        "label": pa.array([r["label"] for r in rows], pa.string()),
        "values": _structs([r["values"] for r in rows], col=pa.string(), val=pa.string()),
        "cells": _structs([r.get("cells") for r in rows], text=pa.string(), x=pa.float64()),
    }
    columns = {
        "company": pa.array(company, pa.string()), "file_name": pa.array(file_name, pa.string()), "page_index": pa.array(page, pa.int32()),
        "page_number": pa.array(number, pa.int32()), "table_index": pa.array(index, pa.int32()), "header": _lists([t["header"] for t in found], pa.string()),
        "header_detected": pa.array([t["header_detected"] for t in found], pa.bool_()), "column_type": pa.array([t["column_type"] for t in found], pa.string()),
        "row_count": pa.array([len(t["rows"]) for t in found], pa.int32()), "column_count": pa.array([len(t["header"]) for t in found], pa.int32()),
        "bbox": _lists([t["bbox"] for t in found], pa.float64()), "rows": _listed([len(t["rows"]) for t in found], pa.StructArray.from_arrays(list(parts.values()), list(parts))),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def real_table(rows: Column, share: float = DEFAULT.real_table) -> Column:
    """P-16."""
    hit = F.filter(rows, lambda r: F.exists(F.coalesce(r["values"], F.array()), lambda v: F.coalesce(P.numeric_value(v["val"]), F.lit(False))))
    return (F.size(rows) > 0) & (F.size(hit) >= F.size(rows) * share)


def table_text(header: Column, rows: Column) -> Column:
    """PR-07: a table as lines of text."""

    def one(r: Column) -> Column:
        vals = F.array_join(F.transform(F.filter(r["values"], lambda v: v["val"].isNotNull()), lambda v: F.concat_ws(": ", v["col"], v["val"])), ", ")
        cells = F.array_join(F.transform(r["cells"], lambda c: c["text"]), " | ")
        return F.when(r["values"].isNotNull(), F.concat(r["label"], F.lit(" -- "), vals)).otherwise(cells)

    top = F.when(F.size(header) > 0, F.array(F.concat(F.lit("Columns: "), F.array_join(header, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(top, F.transform(rows, one)), "\n")
