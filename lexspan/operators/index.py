"""The trigram index: build, open, update, compact.

An index is a folder of segments and of numbered versions. A segment holds ``docs`` and
``postings`` as Parquet, and ``dropped``: ids of documents in earlier segments that it replaces
or that are gone. A version is a small file that lists segments, oldest first; it is written
aside and renamed to the next number, and nothing that a version names is ever changed. So
readers see one whole version, whatever a writer does or fails to do, a second writer fails
instead of overwriting, and an update writes only what has changed. A query resolves its version
once.

Postings are ranged by trigram and document, so a frequent trigram has many files, and row
groups prune by it. Documents are partitioned by unit and by a hash of their id, in chunks of a
bounded size: a query's candidates name the chunks that are read, and dynamic partition pruning
leaves the others alone.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regex_dialect import Parsed
from ..functions.trigrams import trigram_rows
from ..plans import trigram_plan
from ..shipping import ship
from .maintenance import merge_from

#: Files whose stamp lies this close to the time they were read may have changed within it.
RACY_NS = 2_000_000_000
#: Bytes of content in a chunk of documents, and of a postings file, about.
CHUNK_BYTES, FILE_BYTES = 128 << 20, 64 << 20
#: What no version of the last two names goes after this time; a writer may still be at younger ones.
KEEP_MS = 3_600_000


def postings(docs: DataFrame) -> DataFrame:
    """``doc_id, tri, mask`` of a corpus."""
    ship(docs.sparkSession)
    return trigram_rows(docs)


def posting_lists(rows: DataFrame) -> DataFrame:
    """Compact form: a row per trigram and chunk of documents, so that no list is unbounded."""
    chunk = F.floor(F.col("doc_id") / 65536)
    return rows.groupBy("tri", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "mask"))).alias("docs"))


def document_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tri").agg(F.count(F.lit(1)).alias("df"), F.bit_or("mask").alias("mask"))


def settled_stamp(stamp_ns: Column, read_at_ns: Column) -> Column:
    """-1 for a stamp too close to the time of reading: the file is read again next time."""
    return F.when(stamp_ns > read_at_ns - RACY_NS, F.lit(-1).cast("long")).otherwise(stamp_ns)


def incremental_plan(listing: DataFrame, indexed: DataFrame, pending: DataFrame) -> DataFrame:
    """``unit, rel, action``: ``alive`` if a listed file is indexed with the same size and
    stamp and isn't pending, ``reindex`` for other listed files, ``drop`` for indexed files
    that aren't listed."""
    keys = ["unit", "rel"]
    now = listing.select(*keys, F.col("size").alias("new_size"), F.col("stamp_ns").alias("new_stamp"))
    old = indexed.select(*keys, F.col("size").alias("old_size"), F.col("stamp_ns").alias("old_stamp"))
    changed = pending.select(*keys).distinct().withColumn("changed", F.lit(True))
    both = now.join(old, keys, "full_outer").join(changed, keys, "left")
    same = (F.col("new_size") == F.col("old_size")) & (F.col("new_stamp") == F.col("old_stamp")) & F.col("changed").isNull()
    return both.select(*keys, F.when(F.col("new_size").isNull(), "drop").when(same, "alive").otherwise("reindex").alias("action"))


def merge_later_wins(pieces: DataFrame) -> DataFrame:
    """Of documents with one path the one from the latest generation (``gen``)."""
    w = Window.partitionBy("unit", "rel").orderBy(F.desc("gen"))
    return pieces.withColumn("_nr", F.row_number().over(w)).where("_nr = 1").drop("_nr")


def fingerprint(listing: DataFrame) -> DataFrame:
    """A unit's listing as one number that doesn't depend on order; for equality only. A sum, so
    that a row that stands there twice counts twice."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", "rel", F.col("size").cast("string"), F.col("stamp_ns").cast("string"))), 1, 15), 16, 10).cast("decimal(38,0)")
    return listing.groupBy("unit").agg(F.sum(row).cast("string").alias("fingerprint"), F.count(F.lit(1)).alias("files"))


def unit_sync(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """``unit, action``: add, drop or keep."""
    a, b = desired.select("unit").distinct().withColumn("want", F.lit(True)), existing.select("unit").distinct().withColumn("have", F.lit(True))
    return a.join(b, "unit", "full_outer").select("unit", F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "drop").otherwise("keep").alias("action"))


def _chunk(chunks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")


PARTS = {"postings": "doc_id long, tri int, mask int", "dropped": "doc_id long"}


@dataclass(frozen=True)
class Segment:
    name: str
    chunks: int
    bytes: int
    columns: str  # of its documents; a segment that only drops has no file that says so
    drops: bool = False


@dataclass
class Snapshot:
    """One version, and its segments as frames."""

    index: Index
    number: int
    segments: tuple[Segment, ...]

    def _read(self, s: Segment, part: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(s.columns)) if part == "docs" else PARTS[part]
        return self.index.spark.read.schema(schema).parquet(f"{self.index.path}/segments/{s.name}/{part}")

    def _alive(self, at: int, rows: DataFrame) -> DataFrame:
        """A segment's rows without those that later segments drop."""
        later = [self._read(s, "dropped") for s in self.segments[at + 1 :] if s.drops]
        return rows.join(reduce(DataFrame.unionByName, later).distinct(), "doc_id", "left_anti") if later else rows

    def _each(self, make: Callable[[Segment], DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._alive(i, make(s)) for i, s in enumerate(self.segments)])

    def docs(self) -> DataFrame:
        return self._each(lambda s: self._read(s, "docs").drop("chunk"))

    def postings(self) -> DataFrame:
        return self._each(lambda s: self._read(s, "postings"))

    def candidate_docs(self, parsed: Parsed, ci: bool = False) -> DataFrame:
        """Documents that can match; chunks without any aren't read."""
        asked = trigram_plan.plan(parsed, ci)

        def found(s: Segment) -> DataFrame:
            docs, met = self._read(s, "docs"), trigram_plan.candidates(self._read(s, "postings"), asked)
            return (docs if met is None else docs.join(met.withColumn("chunk", _chunk(s.chunks)), ["chunk", "doc_id"], "left_semi")).drop("chunk")

        return self._each(found)

    def may_hold(self, sub: str) -> bool:
        """Whether any indexed document lies at or below a path."""
        below = (F.col("rel") == sub) | F.startswith("rel", F.lit(sub + "/"))
        return not self.docs().where(below).select("rel").limit(1).isEmpty()


@dataclass
class Index:
    """An index in a folder that Spark's file systems reach."""

    spark: SparkSession
    path: str

    def _at(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, int]]:
        """(name, time of change) of what lies in a folder."""
        p, fs = self._at(folder)
        return [(x.getPath().getName(), x.getModificationTime()) for x in fs.listStatus(p)] if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n, _ in self._names("versions") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def _load(self, number: int) -> Snapshot:
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{number:012d}.json").collect())
        return Snapshot(self, number, tuple(Segment(**x) for x in json.loads(text)))

    def snapshot(self) -> Snapshot | None:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else None

    def version(self) -> str | None:
        numbers = self._numbers()
        return f"{numbers[-1]:012d}" if numbers else None

    def _current(self) -> Snapshot:
        s = self.snapshot()
        if s is None:
            raise ValueError(f"no index in {self.path}")
        return s

    def _publish(self, segments: tuple[Segment, ...], based_on: int) -> str:
        """Writes the version after ``based_on``; fails if there is one already."""
        aside, fs = self._at(f"versions/{uuid.uuid4().hex}.tmp")
        to, _ = self._at(f"versions/{based_on + 1:012d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps([vars(s) for s in segments]).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(aside, to):
            fs.delete(aside, False)
            raise RuntimeError(f"another writer published version {based_on + 1}")
        return f"{based_on + 1:012d}"

    def _segment(self, docs: DataFrame, dropped: DataFrame | None = None, rows: DataFrame | None = None, chunk_bytes: int = CHUNK_BYTES) -> Segment:
        """Writes a segment. Postings are made from the documents as written, so both are of one
        reading; stamps too close to it are unsettled, and such files are read again next time."""
        read_at, name = F.lit(time.time_ns()), uuid.uuid4().hex
        home = f"{self.path}/segments/{name}"
        size = docs.agg(F.sum("size")).first()[0] or 0
        chunks = max(1, -(-size // chunk_bytes))
        settled = docs.withColumn("stamp_ns", settled_stamp(F.col("stamp_ns"), read_at)).withColumn("chunk", _chunk(chunks))
        settled.repartition("unit", "chunk").write.partitionBy("unit", "chunk").parquet(f"{home}/docs")
        rows = postings(self.spark.read.schema(settled.schema).parquet(f"{home}/docs")) if rows is None else rows
        rows.repartitionByRange(max(1, -(-size // FILE_BYTES)), "tri", "doc_id").sortWithinPartitions("tri", "doc_id").write.parquet(f"{home}/postings")
        if dropped is not None:
            dropped.select("doc_id").distinct().coalesce(1 + size // CHUNK_BYTES).write.parquet(f"{home}/dropped")
        return Segment(name, chunks, size, settled.schema.json(), dropped is not None)

    def write(self, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> str:
        """A version of these documents alone."""
        numbers = self._numbers()
        return self._publish((self._segment(docs, chunk_bytes=chunk_bytes),), numbers[-1] if numbers else 0)

    def docs(self) -> DataFrame:
        return self._current().docs()

    def postings(self) -> DataFrame:
        return self._current().postings()

    def candidate_docs(self, parsed: Parsed, ci: bool = False) -> DataFrame:
        return self._current().candidate_docs(parsed, ci)

    def update(self, listing: DataFrame, pending: DataFrame) -> str:
        """A new version with a segment of the new and changed documents of a listing (with the
        corpus columns), which drops their old selves and those that aren't listed. Without any
        change the version stays. Segments that are small beside later ones are merged."""
        now = self._current()
        old = now.docs().select("unit", "rel", "doc_id", "size", "stamp_ns")
        plan = incremental_plan(listing, old, pending).where("action <> 'alive'").persist()
        if plan.isEmpty():
            plan.unpersist()
            return f"{now.number:012d}"
        fresh = listing.join(plan.where("action = 'reindex'").select("unit", "rel"), ["unit", "rel"], "left_semi").select(*now.docs().columns)
        dropped = old.join(plan.select("unit", "rel"), ["unit", "rel"], "left_semi")
        version = self._publish((*now.segments, self._segment(fresh, dropped)), now.number)
        plan.unpersist()
        first = merge_from([s.bytes for s in self._current().segments])
        return version if first is None else self.compact(first)

    def compact(self, first: int = 0) -> str:
        """The same documents and postings, with the segments from the ``first`` on in one."""
        now = self._current()
        tail = Snapshot(self, now.number, now.segments[first:])
        drops = [tail._read(s, "dropped") for s in tail.segments if s.drops] if first else []
        docs = tail.docs()
        rows = tail.postings()
        merged = self._segment(docs, reduce(DataFrame.unionByName, drops) if drops else None, rows)
        return self._publish((*now.segments[:first], merged), now.number)

    def vacuum(self, keep_ms: int = KEEP_MS, now_ms: int | None = None) -> list[str]:
        """Deletes versions but the last two, and segments and leftovers that no remaining version
        names, unless they are younger than ``keep_ms``."""
        before = (int(time.time() * 1000) if now_ms is None else now_ms) - keep_ms
        numbers, gone = self._numbers(), []
        named = {s.name for n in numbers[-2:] for s in self._load(n).segments}
        kept = {f"{n:012d}.json" for n in numbers[-2:]}
        for folder, used in (("versions", kept), ("segments", named)):
            for name, changed in self._names(folder):
                if name not in used and changed <= before:
                    p, fs = self._at(f"{folder}/{name}")
                    fs.delete(p, True)
                    gone.append(name)
        return gone

    def beat(self, now_ms: int) -> None:
        """Says that the writer lives, in a file of a few bytes beside the index."""
        p, fs = self._at("beat")
        out = fs.create(p, True)
        out.write(bytearray(str(now_ms).encode()))
        out.close()

    def last_beat_ms(self) -> int:
        p, fs = self._at("beat")
        return int(self.spark.read.text(f"{self.path}/beat").first()[0]) if fs.exists(p) else 0
