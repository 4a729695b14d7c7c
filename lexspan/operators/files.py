"""Filename search, with fuzzy ranking and recency of use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ITEM_OVERHEAD
from ..functions.fuzzy import fuzzy_score
from ..functions.regex_dialect import parse
from .search import Search, path_of, scope

#: Uses lose half their weight in so many days; so many entries are remembered.
HALF_LIFE_DAYS, REMEMBERED = 30, 10_000
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Files:
    globs: tuple[str, ...] = ()
    regex: str | None = None
    fuzzy: str | None = None
    unit: str | None = None
    sub: str = ""
    max_files: int = 5000
    max_result_bytes: int = 64 << 20


def frecency_score(uses: Column, last_used_ms: Column, now_ms: Column | int) -> Column:
    now = now_ms if isinstance(now_ms, Column) else F.lit(now_ms)
    age = F.greatest(now - last_used_ms, F.lit(0)) / F.lit(DAY_MS)
    return uses * F.pow(F.lit(0.5), age / F.lit(HALF_LIFE_DAYS))


def matching(docs: DataFrame, o: Files) -> DataFrame:
    """``path`` (and ``score`` for a fuzzy query) of the corpus files that the filters keep. A
    corpus holds each path once, so nothing is shuffled to tell them apart."""
    d = scope(docs, Search("", globs=o.globs, unit=o.unit, sub=o.sub))
    rel = F.col("rel") if not o.sub else F.substring(F.col("rel"), len(o.sub) + 2, 1 << 30)
    if o.regex is not None:
        java = parse(o.regex).java
        d = d.where(F.rlike(rel, F.lit(java)) | F.rlike(F.element_at(F.split("rel", "/"), -1), F.lit(java)))
    if o.fuzzy:
        d = d.withColumn("score", fuzzy_score(rel, o.fuzzy)).where("score IS NOT NULL")
    return d.select(path_of().alias("path"), *(["score"] if o.fuzzy else []))


def within_bytes(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The ordered prefix whose paths fit the byte budget; for rows that are already few."""
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_bytes", F.sum(F.octet_length("path") + ITEM_OVERHEAD).over(upto)).where(F.col("_bytes") <= most).drop("_bytes")


def files(docs: DataFrame, o: Files, frecency: DataFrame | None = None, now_ms: int = 0) -> DataFrame:
    """Matching paths: by name, or for a fuzzy query by score, recency of use, then name.
    Limits cut after ordering."""
    found = matching(docs, o)
    if not o.fuzzy:
        return within_bytes(found.orderBy("path").limit(o.max_files), [F.col("path")], o.max_result_bytes)
    found = ranked(found, frecency, now_ms)
    order = [F.desc("score"), F.desc("frecency"), F.col("path")]
    return within_bytes(found.orderBy(*order).limit(o.max_files), order, o.max_result_bytes)


def ranked(found: DataFrame, frecency: DataFrame | None, now_ms: int) -> DataFrame:
    """Adds ``frecency``, 0 for paths that were never used."""
    if frecency is None:
        return found.withColumn("frecency", F.lit(0.0))
    used = frecency.select("path", frecency_score(F.col("uses"), F.col("last_used_ms"), now_ms).alias("frecency"))
    return found.join(used, "path", "left").withColumn("frecency", F.coalesce("frecency", F.lit(0.0)))


def remember(frecency: DataFrame, returned: DataFrame, now_ms: int, most: int = REMEMBERED) -> DataFrame:
    """The store after an answer: uses counted up, the most recently used kept."""
    now = returned.select("path", F.lit(now_ms).cast("long").alias("last_used_ms"), F.lit(1).cast("long").alias("uses"))
    old = frecency.select("path", F.col("last_used_ms").cast("long").alias("last_used_ms"), F.col("uses").cast("long").alias("uses"))
    both = old.unionByName(now).groupBy("path").agg(F.max("last_used_ms").alias("last_used_ms"), F.sum("uses").alias("uses"))
    return both.orderBy(F.desc("last_used_ms"), "path").limit(most)
