"""How far an answer can be trusted: coverage, freshness, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Backends, best first; a merged answer has the worst of its parts.
BACKENDS = ["index", "scan", "none"]


def ancestors(path: Column) -> Column:
    """A path and every directory above it, the shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def unit_of(paths: DataFrame, units: DataFrame, split_roots: tuple[str, ...] = ()) -> DataFrame:
    """``path, unit``: the nearest unit above each path, null if there is none. A split root
    owns only files that lie directly in it."""
    p = paths.select("path").distinct().withColumn("unit", F.explode(ancestors(F.col("path"))))
    p = p.join(units.select("unit").distinct(), "unit")
    if split_roots:
        below = F.regexp_replace("path", r"/[^/]*$", "")
        p = p.where(~F.col("unit").isin(*split_roots) | (below == F.col("unit")) | (F.col("path") == F.col("unit")))
    best = p.groupBy("path").agg(F.max_by("unit", F.length("unit")).alias("unit"))
    return paths.select("path").distinct().join(best, "path", "left")


def status(units: DataFrame) -> DataFrame:
    """One row over all units: counts, sums, and whether every one is fresh. Nothing indexed
    is not fresh."""
    return units.agg(
        F.count(F.lit(1)).alias("units_total"),
        F.count_if("ready").alias("units_ready"),
        F.count_if("dirty").alias("units_dirty"),
        F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.bool_and(F.col("ready") & ~F.col("dirty")), F.lit(False)).alias("fresh"),
    )


def window_ms(rescan_secs: int) -> int:
    """A unit listed within this time counts as recent."""
    return 2000 * max(rescan_secs, 30)


def writer_alive(beat_ms: Column, now_ms: Column, rescan_secs: int) -> Column:
    return now_ms - beat_ms < window_ms(rescan_secs) + 60_000


def freshness(units: DataFrame, now_ms: int, rescan_secs: int, writer: bool, watch: bool) -> DataFrame:
    """Adds ``fresh``: ready, exact (clean, or only known files pending) and tracked (watched,
    or listed recently by a writer that lives)."""
    now = F.lit(now_ms)
    alive = F.lit(True) if writer else writer_alive(F.col("beat_ms"), now, rescan_secs)
    recent = now - F.col("indexed_at_ms") < window_ms(rescan_secs)
    tracked = (F.col("watched") & alive) | (F.lit(not writer or not watch) & alive & recent)
    exact = ~F.col("dirty") | ~F.col("pending_unknown")
    return units.withColumn("fresh", F.col("ready") & exact & tracked)


def uncovered_reason(secret: Column, exists: Column, reaches: Column, has_docs: Column) -> Column:
    """Why a root inside a unit isn't covered; null if it is."""
    return F.when(has_docs, None).when(secret, "secret").when(~exists, None).when(~reaches, "excluded")


def flags(answers: DataFrame) -> DataFrame:
    """``complete`` from the other flags."""
    return answers.withColumn("complete", F.col("covered") & F.col("fresh") & ~F.col("truncated"))


def merge_roots(answers: DataFrame) -> DataFrame:
    """One answer over several roots: everything must be covered and fresh, anything truncated
    truncates, candidates add up, the worst backend names it."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, BACKENDS)), F.col("backend")), F.lit(len(BACKENDS)))
    merged = answers.agg(F.bool_and("covered").alias("covered"), F.bool_and("fresh").alias("fresh"), F.bool_or("truncated").alias("truncated"), F.sum("candidates").cast("long").alias("candidates"), F.max(rank).alias("_rank"))
    return flags(merged).withColumn("backend", F.element_at(F.array(*map(F.lit, BACKENDS)), F.col("_rank").cast("int"))).drop("_rank")


def merge_rows(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several roots, each key once, from the first root that has it."""
    from functools import reduce

    tagged = reduce(lambda a, b: a.unionByName(b), (p.withColumn("_root", F.lit(i)) for i, p in enumerate(parts)))
    others = [c for c in parts[0].columns if c not in keys]
    if not others:
        return tagged.select(*keys).distinct()
    first = tagged.groupBy(*keys).agg(F.min_by(F.struct(*others), "_root").alias("_first"))
    return first.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others])
