"""Secret scans with an incremental ledger of content-addressed blobs (op 9). DataFrame functions only."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pagewright.llm.common import bound, materialise, shared_dir, skew_safe_lookup


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern`; kept if `group` has at least `least`
    characters. A rule's version is a hash of all that."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]


#: The base rules. Runs of the classes in `access` and `hex` can't overlap a longer run, so
#: demanding the length in the pattern gives the matches that a later check would leave.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
RULES = BASE + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: What the ledger keeps: a rule's place and name come from the rules of the scan that reads it.
_SPANS = "array<struct<start:int,end:int,version:string>>"


def running(lengths: Column) -> Column:
    """The sums of the ints before each of an array's. Blocks of about the square root of their
    number are summed apart, so a long array isn't copied once an element."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def inside(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def blocks(x: Column) -> Column:
        per = F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), per)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: inside(F.slice(x, k, per)))

    def shifted(parts: Column) -> Column:
        offsets = inside(F.transform(parts, lambda p: p["at"]))["out"]
        return bound(offsets, lambda o: F.flatten(F.transform(parts, lambda p, i: F.transform(p["out"], lambda n: n + F.get(o, i)))))

    return bound(bound(lengths, blocks), shifted)


def spans(text: Column, rule: Rule) -> Column:
    """(start, end, version) of a rule's matches, in code points, by what lies between them."""
    pattern = F.lit(rule.pattern)
    whole, group = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    sizes = F.zip_with(whole, group, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g")))
    gaps = F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)), lambda g: F.length(g))
    rows = F.zip_with(gaps, sizes, lambda gap, m: F.struct(gap.alias("gap"), m["m"].alias("m"), m["g"].alias("g")))

    def located(r: Column) -> Column:
        one = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["m"]).alias("end"), F.lit(rule.version).alias("version"), x["g"].alias("g"))
        every = F.zip_with(r, running(F.transform(r, lambda x: x["gap"] + x["m"])), one)
        return F.transform(F.filter(every, lambda x: x["g"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["version"].alias("version")))

    return F.when(text.rlike(rule.pattern), bound(rows, located)).otherwise(F.array().cast(_SPANS))


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = f"blob binary, versions array<string>, spans {_SPANS}"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan(versions: DataFrame, path_col: str, text_col: str, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, spans) of every row of `versions`, which may hold any number of versions of a path;
    spans: (start, rank, kind, end) by start and by the rule's place in `rules`.

    Contents are addressed by SHA-256. Only contents, and rules for a content, that the ledger
    hasn't seen are scanned, each content once however many rows have it; what is found, or that
    nothing is, is appended to the ledger, and joined back to all rows. Ledger spans carry their
    rule's version, and only those of the versions in `rules` come back, so a rule that was
    changed, dropped or moved leaves nothing of its former self. Copies are merged before they
    are shuffled, and contents that many rows share are looked up by broadcast. Null text is
    empty; null and repeated paths are carried along; no rows give none."""
    spark = versions.sparkSession
    known = [r.version for r in rules]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("blob", F.unhex(F.sha2(F.col("text"), 256)))
    seen = _ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
    blobs = rows.groupBy("blob").agg(F.any_value("text").alias("text")).join(seen, "blob", "left")
    todo = F.array_except(F.array(*map(F.lit, known)), F.coalesce("seen", F.array().cast("array<string>")))
    blobs = blobs.withColumn("versions", todo).where(F.size("versions") > 0)
    none = F.array().cast(_SPANS)
    found = F.concat(*[F.when(F.array_contains("versions", r.version), spans(F.col("text"), r)).otherwise(none) for r in rules])
    blobs.select("blob", "versions", found.alias("spans")).write.mode("append").parquet(ledger)
    place = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.version), F.struct(F.lit(k).alias("rank"), F.lit(r.kind).alias("kind")))])
    named = lambda s: F.struct(s["start"].alias("start"), place[s["version"]]["rank"].alias("rank"), place[s["version"]]["kind"].alias("kind"), s["end"].alias("end"))
    current = F.array(*map(F.lit, known))
    all_found = (
        _ledger(spark, ledger)
        .where(F.arrays_overlap("versions", current))
        .groupBy("blob")
        .agg(F.array_sort(F.array_distinct(F.transform(F.filter(F.flatten(F.collect_list("spans")), lambda s: F.array_contains(current, s["version"])), named))).alias("spans"))
    )
    keys = materialise(rows.select("path", "blob"))
    found = keys.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).join(all_found, "blob")
    return skew_safe_lookup(keys, found, "blob", "n").select("path", "spans")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; the ledger defaults
    to a new one in the shared folder. Spans are kind:start:end by start, then in the order of
    the rules, joined by commas; base_sha256 is of those of the base rules. No rows give none."""
    found = scan(docs, id_col, text_col, ledger or shared_dir(docs.sparkSession))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def text(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"),
        *[count(r.kind) for r in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
