"""Batch lookup: which documents hold each of many literals, in one job.

Without an index one pass over the corpus runs an automaton over all literals at once; their
number and length are limited, which bounds what executors are sent. With an index each
literal's rarest trigrams are joined with the postings, and what they leave is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_LOOKUP_PATTERNS, MAX_PATTERN_BYTES
from ..functions.trigrams import trigram_rows
from ..shipping import ship
from .search import path_of, path_order, strip_cr

#: Trigrams of a literal that are joined with postings.
RAREST = 4


def literals(patterns: DataFrame) -> list[tuple[int, str]]:
    """Checked patterns; one that holds a line break matches no line."""
    rows = patterns.select("pattern_id", "pattern").limit(MAX_LOOKUP_PATTERNS + 1).collect()
    if len(rows) > MAX_LOOKUP_PATTERNS:
        raise ValueError(f"too many patterns (at most {MAX_LOOKUP_PATTERNS})")
    if any(r["pattern"] and len(r["pattern"].encode()) > MAX_PATTERN_BYTES for r in rows):
        raise ValueError(f"a pattern is longer than {MAX_PATTERN_BYTES} bytes")
    return [(r["pattern_id"], r["pattern"]) for r in rows if r["pattern"] and "\n" not in r["pattern"]]


def hits(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern_id, unit, rel`` for every document that holds a pattern, by one scan."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(literals(patterns))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids: dict[str, list[int]] = {}
        for i, p in sent.value:
            ids.setdefault(p, []).append(i)
        automaton = ahocorasick.Automaton()
        for p in ids:
            automaton.add_word(p, p)
        if ids:
            automaton.make_automaton()
        for b in batches:
            out: list[tuple] = []
            for unit, rel, text in zip(*(b.column(c).to_pylist() for c in ("unit", "rel", "content")), strict=True):
                if text and ids:
                    # a line ends before its carriage return, so none can be matched there
                    text = text.replace("\r\n", "\n")
                    found = {p for _, p in automaton.iter(text[:-1] if text.endswith("\r") else text)}
                    out += [(i, unit, rel) for p in sorted(found) for i in ids[p]]
            yield pa.RecordBatch.from_pydict({"pattern_id": pa.array([x[0] for x in out], pa.int64()), "unit": pa.array([x[1] for x in out], pa.string()), "rel": pa.array([x[2] for x in out], pa.string())})

    return docs.select("unit", "rel", "content").mapInArrow(each, "pattern_id long, unit string, rel string")


#: Expressions that one scan tests at a time.
TOGETHER = 100


def _any_line(java: str) -> Column:
    return F.exists("lines", lambda x: F.rlike(x, F.lit(java)))


def regex_hits(docs: DataFrame, patterns: list[tuple[int, str]]) -> DataFrame:
    """``pattern_id, unit, rel`` for Java patterns, by one scan for each ``TOGETHER`` of them."""
    found = None
    for a in range(0, len(patterns), TOGETHER):
        met = F.array_compact(F.array(*[F.when(_any_line(java), F.lit(i).cast("long")) for i, java in patterns[a : a + TOGETHER]]))
        lines = docs.select("unit", "rel", F.transform(F.split("content", "\n", -1), strip_cr).alias("lines"))
        part = lines.select(F.explode(met).alias("pattern_id"), "unit", "rel")
        found = part if found is None else found.unionByName(part)
    return found


def hits_indexed(docs: DataFrame, postings: DataFrame, patterns: DataFrame) -> DataFrame:
    """The same through the index. Literals of under three bytes ask for all documents."""
    p = patterns.where(F.col("pattern").isNotNull() & (F.length("pattern") > 0) & ~F.contains("pattern", F.lit("\n")))
    asked = trigram_rows(p, "pattern_id", "pattern").select(F.col("doc_id").alias("pattern_id"), "tri", F.col("mask").alias("need"))
    df = postings.join(asked.select("tri").distinct(), "tri", "left_semi").groupBy("tri").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("pattern_id").orderBy(F.coalesce("df", F.lit(0)), "tri")
    asked = asked.join(df, "tri", "left").withColumn("nr", F.row_number().over(rare)).where(F.col("nr") <= RAREST)
    wanted = asked.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("wanted"))
    met = postings.join(asked, "tri").where(F.col("mask").bitwiseAND(F.col("need")) == F.col("need"))
    met = met.groupBy("pattern_id", "doc_id").agg(F.count(F.lit(1)).alias("met")).join(wanted, "pattern_id").where("met = wanted").select("pattern_id", "doc_id")
    texts = docs.select("doc_id", "unit", "rel", "content")
    found = met.join(p, "pattern_id").join(texts, "doc_id").where(F.contains(F.regexp_replace("content", r"\r(?=\n|\z)", ""), F.col("pattern"))).select("pattern_id", "unit", "rel")
    short = p.where(F.octet_length("pattern") < 3)
    return found.unionByName(hits(docs, short))


def answers(patterns: DataFrame, found: DataFrame, max_files: int = 100) -> DataFrame:
    """A row per pattern, also for those without a hit: ``pattern_id, found, files`` (in path
    order, at most ``max_files``) and ``truncated``."""
    rows = found.distinct().withColumn("nr", F.row_number().over(Window.partitionBy("pattern_id").orderBy(*path_order())))
    rows = rows.where(F.col("nr") <= max_files + 1)
    lists = rows.groupBy("pattern_id").agg(F.sort_array(F.collect_list(F.struct("nr", path_of().alias("path")))).alias("all"))
    files = F.coalesce(F.transform(F.slice("all", 1, max_files), lambda x: x["path"]), F.array().cast("array<string>"))
    return patterns.select("pattern_id").join(lists, "pattern_id", "left").select("pattern_id", F.col("all").isNotNull().alias("found"), files.alias("files"), F.coalesce(F.size("all") > max_files, F.lit(False)).alias("truncated"))
