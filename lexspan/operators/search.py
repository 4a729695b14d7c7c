"""Content search: candidates, line matches, ordered cut, answer.

Every answer is verified line by line; an index only narrows what is read. The scan and the
index path therefore give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ITEM_OVERHEAD
from ..functions.globs import overrides
from ..functions.regex_dialect import Parsed, parse, parse_literal, required_literal
from ..plans import trigram_plan

#: Bytes of a line that an answer shows.
LINE_BYTES = 2000


@dataclass(frozen=True)
class Search:
    pattern: str
    regex: bool = False
    ci: bool = False
    globs: tuple[str, ...] = ()
    unit: str | None = None
    sub: str = ""
    files_only: bool = False
    max_matches: int = 1000
    max_files: int = 20_000
    max_result_bytes: int = 64 << 20

    def parsed(self) -> Parsed:
        return parse(self.pattern, self.ci) if self.regex else parse_literal(self.pattern, self.ci)


def in_sub(rel: Column, sub: str) -> Column:
    return F.lit(True) if not sub else (rel == sub) | F.startswith(rel, F.lit(sub + "/"))


def path_of() -> Column:
    return F.concat_ws("/", "unit", "rel")


def path_order() -> list[Column]:
    """Unit, then path by components: a directory's files come before a sibling whose name
    goes on where the directory's ends."""
    return [F.col("unit"), F.split("rel", "/")]


def strip_cr(line: Column) -> Column:
    return F.when(F.endswith(line, F.lit("\r")), F.left(line, F.length(line) - 1)).otherwise(line)


def shown(line: Column) -> Column:
    """The first bytes of a line; a character cut in two is replaced."""
    cut = F.make_valid_utf8(F.substring(line.cast("binary"), 1, LINE_BYTES).cast("string"))
    return F.when(F.octet_length(line) <= LINE_BYTES, line).otherwise(cut)


def scope(docs: DataFrame, s: Search) -> DataFrame:
    """Documents under the search's root that its globs keep. Globs see paths relative to the
    root."""
    rel = F.col("rel") if not s.sub else F.when(F.col("rel") == s.sub, F.element_at(F.split("rel", "/"), -1)).otherwise(F.substring(F.col("rel"), len(s.sub) + 2, 1 << 30))
    kept = in_sub(F.col("rel"), s.sub) & overrides(rel, list(s.globs))
    return docs.where(kept if s.unit is None else kept & (F.col("unit") == s.unit))


def prefilter(docs: DataFrame, s: Search, parsed: Parsed) -> DataFrame:
    """Drops documents without the literal that every match holds; that filter reaches the
    Parquet scan."""
    literal = required_literal(parsed.tree)
    return docs.where(F.contains("content", F.lit(literal))) if literal and "\n" not in literal else docs


def line_matches(docs: DataFrame, s: Search) -> DataFrame:
    """``unit, rel, line, text`` of every matching line."""
    parsed = s.parsed()
    d = prefilter(scope(docs, s), s, parsed).select("unit", "rel", F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw"))
    d = d.select("unit", "rel", (F.col("pos") + 1).cast("long").alias("line"), strip_cr(F.col("raw")).alias("raw"))
    return d.where(F.rlike("raw", F.lit(parsed.java))).select("unit", "rel", "line", shown(F.col("raw")).alias("text"))


def file_matches(docs: DataFrame, s: Search) -> DataFrame:
    """``unit, rel`` of documents with a matching line; no line is kept or exploded."""
    parsed = s.parsed()
    d = prefilter(scope(docs, s), s, parsed)
    return d.where(F.exists(F.split("content", "\n", -1), lambda x: F.rlike(strip_cr(x), F.lit(parsed.java)))).select("unit", "rel")


def through_index(docs: DataFrame, postings: DataFrame, s: Search) -> DataFrame:
    """Documents that can match by the trigram index; the condition is a semi-join, so Spark
    broadcasts the candidates only while they are few."""
    found = trigram_plan.candidates(postings, trigram_plan.plan(s.parsed(), s.ci))
    return docs if found is None else docs.join(found, "doc_id", "left_semi")


def overlay(indexed: DataFrame, pending: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates of the index and documents that changed since it was built, each once."""
    keys = ["unit", "rel"]
    changed = docs.join(pending.select(*keys).distinct(), keys, "left_semi")
    return indexed.join(pending.select(*keys).distinct(), keys, "left_anti").unionByName(changed)


@dataclass
class Answer:
    """Rows, and what is known about them."""

    rows: DataFrame
    truncated: bool
    backend: str = "scan"
    covered: bool = False
    fresh: bool = True
    uncovered: list[dict] = field(default_factory=list)

    @property
    def complete(self) -> bool:
        return self.covered and self.fresh and not self.truncated


def cut_rows(found: DataFrame, s: Search) -> DataFrame:
    """The ordered prefix that the limits allow, and one row more, marked ``kept = false``, if
    there is more. Only ``limit + 1`` ordered rows ever meet in one task."""
    files = s.files_only
    order = path_order() if files else [*path_order(), F.col("line")]
    rows = found.orderBy(*order).limit((s.max_files if files else s.max_matches) + 1)
    rows = rows.select("*", path_of().alias("path"))
    cost = F.octet_length("path") + ITEM_OVERHEAD + (F.lit(0) if files else F.octet_length("text"))
    w = Window.orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nr", F.row_number().over(w)).withColumn("bytes", F.sum(cost).over(upto)).withColumn("file_nr", F.dense_rank().over(Window.orderBy(*path_order())))
    return rows.withColumn("kept", (F.col("file_nr") <= s.max_files) & (F.col("nr") <= (s.max_files if files else s.max_matches)) & (F.col("bytes") <= s.max_result_bytes))


def search(docs: DataFrame, s: Search, postings: DataFrame | None = None) -> Answer:
    """The answer to a search over a corpus, through the index if there is one."""
    corpus = docs if postings is None else through_index(docs, postings, s)
    rows = cut_rows(file_matches(corpus, s) if s.files_only else line_matches(corpus, s), s)
    kept = rows.where("kept").select("path", *([] if s.files_only else ["line", "text"]))
    truncated = rows.where(~F.col("kept")).limit(1).count() > 0
    return Answer(kept, truncated, "scan" if postings is None else "index", covered=postings is not None)


def candidates_only(docs: DataFrame, postings: DataFrame, s: Search) -> DataFrame:
    """Unverified candidates in path order, capped."""
    return scope(through_index(docs, postings, s), s).select("unit", "rel").orderBy(*path_order()).limit(s.max_files).select(path_of().alias("path"))
