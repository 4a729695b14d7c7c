"""Mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents are ordered by that
key; as the keys are uniform, ranges of equal width hold equal shares, so the range bounds
need no sampling and are the same on every run. Sums of the ranges give each range its
offset, a running sum inside the range gives each document its position, and the source is
cut at its budget. Budgets above the source's size repeat whole epochs first.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a
source of its own, ordered last; equal documents (same id and text) share a key and are
ordered arbitrarily among themselves, which changes no count; an empty table gives an empty
result. Only ``doc_id``, ``text`` and ``source`` are used; other columns pass through
``mix`` untouched except that names starting with ``_mix_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Ranges of a source; each task sorts one of them. More suit sources of over 10**10 documents.
RANGES = 2048


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``sizes``: a row per source with ``source`` and ``source_size``. Adds ``target``.

    Sources by code point (null last) weigh ``weights``, repeating. ``share`` times all words
    is dealt by weight; none gets over ``most`` times its size, the excess goes to the others.
    That is a water level: a source is full below the level where ``most * size / weight``
    lies under it. Sources sorted by that ratio, running sums give the level directly.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("weight", weight).withColumn("full", F.lit(float(most)) * F.col("source_size"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # the level if this source were the first that isn't full
    s = s.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("open", F.col("full") > F.col("level") * F.col("weight"))
    # levels rise up to the first open source and fall after it
    s = s.withColumn("water", F.max(F.when(F.col("open"), F.col("level"))).over(every))
    return s.withColumn("target", F.when(F.col("water").isNull(), F.col("full")).otherwise(F.least(F.col("full"), F.col("water") * F.col("weight")))).select("source", "source_size", "target")


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, size: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """A row per document: ``doc_id, source, size, source_size, target, copies, taken, mix_key``.

    ``copies``: how often the mix repeats the document. A document on the cut is taken if at
    least half of it fits, so a source misses its target by half a document at most.
    """
    key = mix_key(F.col("doc_id"), F.col("text"))
    d = docs.select("doc_id", "source", (text_size(F.col("text")) if size is None else size.cast("long")).alias("size"), key.alias("mix_key"))
    # keys are uniform: the first 32 bits give the range
    part = F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    # texts are read once; what follows works on these narrow rows
    d = stored(d.withColumn("_fine", F.floor(part * ranges).cast("int")), "mix-sizes")
    sums = d.groupBy("source", "_fine").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("source").orderBy("_fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("s").over(ahead), F.lit(0))).select("source", "_fine", "_offset")
    # a row per source, in one partition: all its windows run there without further exchanges
    targets = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")).coalesce(1), weights, share, most)
    ranges_ = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "_fine", "_offset", "source_size", "target")
    own = Window.partitionBy("source", "_fine").orderBy("mix_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_ahead", F.coalesce(F.sum("size").over(own), F.lit(0)))
    d = d.alias("d").join(ranges_.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d._fine") == F.col("r._fine"))).select("d.doc_id", "d.source", "size", "mix_key", "source_size", "target", (F.col("_offset") + F.col("_ahead")).alias("_at"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - F.col("_epochs") * F.col("source_size")
    last = (F.col("_at") < left) & (2 * F.col("_at") + F.col("size") <= 2 * left)
    d = d.withColumn("_epochs", epochs).withColumn("copies", F.col("_epochs") + F.when(last, 1).otherwise(0))
    return d.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), "mix_key")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, same columns."""
    # equal documents (id, text and source) may differ in copies: they are numbered to pair up
    same = Window.partitionBy("_mix_key", "source").orderBy("_mix_copies")
    plan = plan_mix(docs, weights, share, most).select(F.col("source"), F.col("mix_key").alias("_mix_key"), F.col("copies").alias("_mix_copies"))
    plan = plan.withColumn("_mix_nr", F.row_number().over(same))
    d = docs.withColumn("_mix_key", mix_key(F.col("doc_id"), F.col("text")))
    d = d.withColumn("_mix_nr", F.row_number().over(Window.partitionBy("_mix_key", "source").orderBy(F.lit(1))))
    both = d.alias("d").join(plan.alias("p"), (F.col("d._mix_key") == F.col("p._mix_key")) & (F.col("d._mix_nr") == F.col("p._mix_nr")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    return both.where("_mix_copies > 0").withColumn("_mix_again", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*[F.col(f"d.`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS "full",
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
      FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())
        - coalesce(sum("full") OVER (ORDER BY "full" / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY "full" / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w),
v AS (SELECT *, max(CASE WHEN "full" > level * weight THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN "full" ELSE least("full", water * weight) END AS target FROM v),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN pos < target - epochs * source_size AND 2 * pos + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
