"""N-gram Jaccard join with Bayesian candidate pruning.

A document is its set of hashed word shingles (five words). Documents with equal sets form a
class of copies, and classes are what is joined. Bands of MinHash values bring classes
together; a pair that meets has its MinHash values compared a few at a time, and is dropped
as soon as the posterior probability that its similarity reaches the threshold falls below
the tolerance. What stays connects classes into candidate components, and inside these all
pairs that survive the same comparison are verified exactly on the shingle sets. Pairs are
never written out: tasks give links as counts per class and as a spanning forest.

A band or component with many classes is dealt out as pairs of blocks, so no task holds more
than two blocks; there is no cap on members, candidates or partners. Its work still grows
with the square of the number of *different* texts that are near copies of each other, as
counting every one's links must; copies cost nothing.

Chance of missing a link: with bands of 4 values, 24 of them, a pair at similarity 0.8 meets
nowhere with probability (1 - 0.8**4)**24 = 3e-6, at 0.9 with 1e-11; the tolerance adds 1e-6.
A pair that is missed in its bands is still found if both are in one candidate component.

A text of fewer than five words has one shingle, all its words; null texts and texts without
words have none, form one class of copies and link to nothing else. Null doc_ids are
allowed. Rows that repeat are copies. Other columns pass through ``keep_one``; names starting
with ``_nj_`` are reserved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: MinHash values compared before each look at the posterior.
STEP = 16
#: Classes in a block of a large band or component; shingles in a component's block, about.
BAND_BLOCK, VERIFY_BLOCK, BLOCK_SHINGLES = 512, 256, 2_000_000
#: Words whose hashes a task keeps at a time.
CACHE = 250_000

_WORD = re.compile(WORD)
_U = np.uint64
_rng = np.random.default_rng(20240229)
_MULTIPLY = (_rng.integers(0, 2**63, HASHES, dtype=np.uint64) << _U(1)) | _U(1)
_ADD = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


class Shingler:
    """Sets of hashed shingles; keeps the hashes of words it has seen."""

    def __init__(self):
        self.cache: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes."""
        words = _WORD.findall(text or "")
        if not words:
            return np.empty(0, np.uint64)
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        n = min(SHINGLE, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            out ^= h[j : len(h) - n + 1 + j]
            out *= _PLACE[j]
            out ^= out >> _U(31)
        return np.unique(out)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value under each hash function, its upper 32 bits."""
    best = np.full(HASHES, np.iinfo(np.uint64).max)
    for a in range(0, len(shingles), 2048):
        np.minimum(best, (shingles[a : a + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=best)
    return (best >> _U(32)).astype(np.uint32)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, fewest matches with which a pair stays) for each look. With a uniform
    prior the posterior after m matches of n is Beta(m + 1, n - m + 1); that it exceeds t has
    the probability that a binomial of n + 1 tries at t is at most m."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray, looks: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs (left[i] of a, right[i] of b) that no look drops."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    for n, least in looks:
        matches = matches + (a[left[alive], n - STEP : n] == b[right[alive], n - STEP : n]).sum(axis=1, dtype=np.int32)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is connected with."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups from batches sorted by key, with where each group starts (and the
    end). A group is held until it is whole; groups are bounded by the blocks."""
    held: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows - 1, bool)
        for k in key:
            c = t.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        s = starts(held)
        if len(s) > 1:
            yield held.slice(0, int(s[-1])), s
            held = held.slice(int(s[-1]))
    if held is not None:
        yield held, np.concatenate([starts(held), [held.num_rows]])


def _pairs(starts: np.ndarray, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs inside each group, some groups at a time."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a < 2:
            continue
        i, j = np.triu_indices(b - a, 1)
        left.append(i + a)
        right.append(j + a)
        held += len(i)
        if held >= most:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _signatures(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, HASHES)


def _dealt(df: DataFrame, blocks: Column, part: Column) -> DataFrame:
    """Rows of a group of so many blocks as block pairs ``bi <= bj``, with the row's own
    ``side``."""
    d = df.withColumn("blocks", F.greatest(F.lit(1), blocks).cast("int")).withColumn("side", F.pmod(part, F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other")).drop("other")


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, key`` (of the shingle set), ``n`` (shingles) and ``sig``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_hash": b.column("text_hash"), "key": pa.array([set_key(s) for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int32()), "sig": pa.array([min_hashes(s).astype("<u4").tobytes() if len(s) else None for s in sets], pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(each, "doc_id long, text_hash long, key binary, n int, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = _signatures(pa.Table.from_batches([b])).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), 1))
            for j in range(ROWS):
                h = (h ^ sig[:, :, j]) * _PLACE[j]
                h ^= h >> _U(29)
            keys = b.column("key").take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))
            yield pa.RecordBatch.from_pydict({"band": pa.array(h.reshape(-1).astype(np.int64)), "key": keys})

    return classes.select("key", "sig").mapInArrow(each, "band long, key binary")


def candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``u, v``: a spanning forest of the pairs that meet in a band and survive."""
    looks = least_matches(threshold, tolerance)
    bands = stored(_bands(classes), "bands")
    many = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = bands.join(many, "band")
    rows = _dealt(met, F.ceil(F.col("members") / BAND_BLOCK), F.xxhash64("key")).join(classes.select("key", "sig"), "key")
    order = ["band", "bi", "bj"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches, order):
            sig, keys = _signatures(t), t.column("key").to_pylist()
            found = [np.empty((2, 0), np.int64)]
            for i, j in _pairs(starts):
                alive = surviving(sig, sig, i, j, looks)
                label = roots(len(keys), i[alive], j[alive])
                to = np.flatnonzero(label != np.arange(len(keys)))
                found.append(np.array([to, label[to]]))
            edges = {(keys[i], keys[j]) for i, j in np.concatenate(found, axis=1).T}
            yield pa.RecordBatch.from_pydict({"u": pa.array([e[0] for e in edges], pa.binary()), "v": pa.array([e[1] for e in edges], pa.binary())})

    return rows.select(*order, "key", "sig").repartition(*order).sortWithinPartitions(*order).mapInArrow(each, "u binary, v binary")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of the pairs."""
    if len(left) <= 3 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], dtype=np.int64)
    sizes = np.array([len(s) for s in sets])
    token, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[inverse] > 1
    place = np.cumsum(counts > 1) - 1
    column, owner = place[inverse[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = 8192  # shared shingles at a time
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - a] = 1
        total += m @ m.T
    return total[left, right].astype(np.int64)


def verified(members: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``members``: rows of components in block pairs, with ``key, sig, weight, text``. Gives,
    per class and block pair, ``key, root, texts, docs``: a class it is linked with through
    links seen here, how many classes it links to, and how many documents those are."""
    looks = least_matches(threshold, tolerance)
    order = ["root", "bi", "bj"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler()
        for t, starts in _groups(batches, order):
            keys, sig = t.column("key").to_pylist(), _signatures(t)
            weight, side = t.column("weight").to_numpy(), t.column("side").to_numpy()
            cross = t.column("bi").to_numpy() != t.column("bj").to_numpy()
            out: dict[str, list] = {"key": [], "root": [], "texts": [], "docs": []}
            text = t.column("text")
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                i, j = np.triu_indices(b - a, 1)
                if cross[a]:  # pairs inside a block are another task's
                    apart = side[a:b][i] != side[a:b][j]
                    i, j = i[apart], j[apart]
                alive = surviving(sig[a:b], sig[a:b], i, j, looks)
                i, j = i[alive], j[alive]
                sets = [shingles(x.as_py()) for x in text.slice(int(a), int(b - a))]
                sizes = np.array([len(s) for s in sets])
                both = _overlaps(sets, i, j)
                # similarity >= threshold, in whole numbers as far as the threshold allows
                linked = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
                i, j = i[linked], j[linked]
                label = roots(b - a, i, j)
                texts = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
                docs = np.bincount(i, weight[a:b][j], b - a) + np.bincount(j, weight[a:b][i], b - a)
                out["key"] += keys[a:b]
                out["root"] += [keys[a + k] for k in label]
                out["texts"] += texts.tolist()
                out["docs"] += docs.astype(np.int64).tolist()
            yield pa.RecordBatch.from_pydict({"key": pa.array(out["key"], pa.binary()), "root": pa.array(out["root"], pa.binary()), "texts": pa.array(out["texts"], pa.int64()), "docs": pa.array(out["docs"], pa.int64())})

    return members.select(*order, "side", "key", "sig", "weight", "text").repartition(*order).sortWithinPartitions(*order).mapInArrow(each, "key binary, root binary, texts long, docs long")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per document: ``doc_id``, ``text_hash``, ``class_id`` (the least doc_id of its
    near-copy class; a hash if none has an id or that id already names another class), ``n_links`` (other documents at or above the
    threshold, copies counted), ``n_text_links`` (different shingle sets among them),
    ``n_copies`` (documents with the same set, itself included), and ``first``: whether its
    (doc_id, text_hash) is the class's least, nulls last."""
    rows = stored(sketches(docs), "sketches")
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").isNull().alias("empty"), F.col("text_hash").alias("text_hash"))
    sets = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min(who).alias("who"), F.first("sig").alias("sig"), F.first("n").alias("n")), "classes")
    some = sets.where(F.col("sig").isNotNull())
    nodes = components(candidate_edges(some, threshold, tolerance))
    member = nodes.withColumnRenamed("node", "key").join(some, "key")
    # blocks are bounded in classes and in shingles, so long texts make more of them
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / VERIFY_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = member.groupBy("root").agg(needed.alias("needed"))
    member = member.join(sizes, "root").select("root", "key", "needed", "weight", "sig", F.col("who.doc_id").alias("_nj_id"), F.col("who.text_hash").alias("_nj_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", F.xxhash64("text"))
    # one document of each class brings its text; rows that repeat wholly bring it once
    member = member.join(texts, F.col("_nj_id").eqNullSafe(F.col("doc_id")) & (F.col("_nj_hash") == F.col("text_hash"))).dropDuplicates(["key"])
    found = stored(verified(_dealt(member, F.col("needed"), F.xxhash64("key")), threshold, tolerance), "links")
    final = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    labelled = sets.select("key", "weight", "who").join(final.select(F.col("node").alias("key"), F.col("root").alias("label")), "key", "left").join(links, "key", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "key"))
    first = labelled.groupBy("label").agg(F.min("who").alias("least"))
    # a doc_id that stands with several texts may be the least of several classes: it names one
    named = first.where("least.doc_id IS NOT NULL").groupBy("least.doc_id").agg(F.min("label").alias("label"))
    first = first.join(named.select("label", F.col("doc_id").alias("named")), "label", "left")
    first = first.withColumn("class_id", F.coalesce("named", F.xxhash64("label")))
    labelled = labelled.join(first, "label").select("key", "weight", "class_id", "least", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("docs", F.lit(0)).alias("docs"))
    out = rows.drop("sig").withColumn("who", who).join(labelled, "key")
    return out.select(
        "doc_id",
        "text_hash",
        "class_id",
        (F.col("docs") + F.col("weight") - 1).cast("long").alias("n_links"),
        F.col("texts").cast("long").alias("n_text_links"),
        F.col("weight").cast("long").alias("n_copies"),
        F.col("who").eqNullSafe(F.col("least")).alias("first"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with one document of each near-copy class, the one with the least doc_id."""
    first = near_classes(docs, threshold, tolerance).where("first").select(F.col("doc_id").alias("_nj_id"), F.col("text_hash").alias("_nj_hash")).distinct()
    d = docs.withColumn("_nj_text", F.xxhash64("text"))
    d = d.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col("_nj_id")) & F.col("_nj_text").eqNullSafe(F.col("_nj_hash")), "left_semi")
    return d.withColumn("_nj_key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).dropDuplicates(["_nj_key", "_nj_text"]).drop("_nj_key", "_nj_text")
