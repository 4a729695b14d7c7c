"""Line dedup by distinct-site spread.

A line that stands on many sites (``source``) is boilerplate. Per line hash, HyperLogLog
sketches of the sites merge by aggregation; lines whose estimate lies near the threshold get
an exact distinct count, the rest are decided by the estimate. Boilerplate lines go from
every document but the first that holds them (smallest doc_id, then earliest line), so no
content disappears from the corpus altogether, and a document copied to many sites keeps one
whole copy.

Lines are compared after trimming spaces and tabs; blank lines always stay. A null source
counts as no site, so lines seen there alone are never boilerplate. A null text stays null,
an empty one stays empty; a null doc_id sorts last. Rows that repeat wholly are treated
alike. Columns besides ``doc_id``, ``text`` and ``source`` pass through, but that ``n_lines`` and
``n_removed`` are replaced; names starting with ``_ld_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Lines on this many distinct sites or more are boilerplate.
MIN_SITES = 10
#: log2 of the sketch's buckets: a relative standard error of 1.04 / sqrt(2**12) = 1.6 %.
LG_K = 12
#: Estimates within this part of the threshold (6 standard errors) are counted exactly.
NEAR = 0.1


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_rows(docs: DataFrame) -> DataFrame:
    """A row per line that isn't blank: row key (doc_id and text hash), place, hash, site."""
    d = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "source", F.split(F.col("text"), "\n", -1).alias("lines"))
    d = d.select("doc_id", "text_hash", "source", F.posexplode("lines").alias("pos", "line"))
    return d.where(F.trim("line") != "").select("doc_id", "text_hash", "pos", "source", _line_hash(F.regexp_replace("line", r"\t", " ")).alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The hashes of lines on at least ``min_sites`` sites, exactly: the sketches decide what
    is far from the threshold, a distinct count what is near. With the hash comes the first
    document that holds the line (``first_doc``: doc_id null last, text hash, place)."""
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"), F.col("pos").alias("d"))
    sketched = lines.groupBy("h").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    # a line on that many sites stands there that many times: cheaper than the estimate
    sketched = sketched.where(F.col("n") >= min_sites).select("h", F.hll_sketch_estimate("sketch").alias("sites"), "first")
    found = stored(sketched, "line-spread")
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    near = lines.join(found.where((F.col("sites") >= low) & (F.col("sites") <= high)).select("h"), "h", "left_semi")
    exact = near.select("h", "source").distinct().groupBy("h").agg(F.count("source").alias("exact"))
    clear = found.where(F.col("sites") > high).select("h", "first")
    return clear.unionByName(found.join(exact.where(F.col("exact") >= min_sites), "h").select("h", "first"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text``, plus ``n_lines`` (lines that aren't
    blank) and ``n_removed``. No document is dropped."""
    lines = line_rows(docs)
    bad = boilerplate(lines, min_sites)
    place = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"), F.col("pos").alias("d"))
    gone = lines.join(bad, "h").where(~place.eqNullSafe(F.col("first"))).groupBy(F.col("doc_id").alias("_ld_id"), F.col("text_hash").alias("_ld_hash")).agg(F.collect_set("pos").alias("_ld_gone"))
    d = docs.withColumn("_ld_text", F.xxhash64("text"))
    d = d.join(gone, F.col("doc_id").eqNullSafe(F.col("_ld_id")) & (F.col("_ld_text") == F.col("_ld_hash")), "left")
    # the kept places, by hashing, then their lines: time grows with a text's lines alone
    d = d.withColumn("_ld_parts", F.split(F.col("text"), "\n", -1))
    drop = F.coalesce(F.col("_ld_gone"), F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), F.size("_ld_parts") - 1), F.col("_ld_gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("_ld_parts"), i)), "\n")
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.coalesce(F.size(F.filter("_ld_parts", lambda x: F.trim(F.regexp_replace(x, r"\t", " ")) != "")), F.lit(0))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(n_lines)
    return d.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")], n_lines.cast("long").alias("n_lines"), F.size(drop).cast("long").alias("n_removed"))


ORACLE = """
WITH l AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT *, trim(replace(line, chr(9), ' ')) AS t FROM l),
b AS (SELECT t, min(doc_id) AS first_doc FROM k WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
f AS (SELECT b.t, b.first_doc, min(k.pos) AS first_pos FROM b JOIN k ON b.t = k.t AND b.first_doc = k.doc_id GROUP BY ALL),
g AS (SELECT k.doc_id, k.pos, k.line, k.t, f.t IS NOT NULL AND NOT (k.doc_id = f.first_doc AND k.pos = f.first_pos) AS gone FROM k LEFT JOIN f ON k.t = f.t)
SELECT d.doc_id, coalesce(string_agg(g.line, chr(10) ORDER BY g.pos) FILTER (NOT g.gone), CASE WHEN d.text IS NULL THEN NULL ELSE '' END) AS text,
       CAST(count(*) FILTER (g.t <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (g.gone) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id, d.text
"""
