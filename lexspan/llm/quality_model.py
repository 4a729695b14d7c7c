"""Quality classifier from supervised subword embeddings.

Each word has hashed features: itself, its character n-grams, and its pair with the word
before it (a word that repeats its predecessor gives one feature of its own, whichever word
it is). Every feature has a learned vector; a document is the mean of its features' vectors,
and a softmax over that mean gives the class. Vectors and softmax are trained together by
stochastic gradient descent in numpy.

Training reads a bounded sample of labelled rows (``SAMPLE`` of each class, chosen by hash),
as feature counts that executors compute from whole texts, and of these at most
``SAMPLE_FEATURES`` a class, in the order of the hash, so what the driver holds is bounded
however long the texts are. Scoring is linear in the features: the
model reduces to one number per feature, which is all that executors get (``BUCKETS``
doubles, whatever the corpus). Every document is scored over its whole text.

A null or empty text has no features and gets the score of the softmax bias alone. Rows
without a label, or with labels other than 0 and 1, teach nothing. If a class has no
labelled row, every score is the other class's certainty, 0.5 if neither has one. Documents
whose labels disagree teach both. Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, stored

#: Hashed features; words, n-grams and pairs share the table.
BUCKETS = 1 << 17
GRAMS = (3, 4)
DIMENSIONS = 16
#: Labelled rows of each class that training reads at most.
SAMPLE = 1000
#: Distinct features that the sampled rows of a class have in all, at most: 8 bytes each.
SAMPLE_FEATURES = 8_000_000
EPOCHS = 10
RATE = 0.5
#: Scores at or above this are class 1.
THRESHOLD = 0.7
#: Words whose features a task keeps at a time.
CACHE = 300_000

_WORD = re.compile(WORD)


def _bucket(s: str) -> int:
    return xxhash.xxh32_intdigest(s.encode("utf-8", "surrogatepass")) % BUCKETS


_REPEAT = _bucket("\x00again")


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' own buckets; the buckets of all their n-grams, with marks at a word's ends;
    and the places of the words that those belong to."""
    first = np.array([_bucket(w) for w in words], dtype=np.int64)
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters left in the word
    grams, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        grams.append((h % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[at])
    return first, np.concatenate(grams), np.concatenate(owners)


def _pairs(first: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words' pairs, from the words' own buckets."""
    a, b = first[:-1], first[1:]
    return np.where(a == b, _REPEAT, (a * 0x9E3779B1 + b * 0x85EBCA77 & 0x7FFFFFFF) % BUCKETS)


def feature_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text, and how often each occurs."""
    first, grams, _ = word_features(_WORD.findall(text or ""))
    return np.unique(np.concatenate([first, grams, _pairs(first)]), return_counts=True)


class Model:
    """What scoring needs: a weight per feature, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.index: dict[str, int] = {}
        self.sums, self.counts, self.first = np.zeros(CACHE), np.zeros(CACHE, dtype=np.int64), np.zeros(CACHE, dtype=np.int64)

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def _learn(self, words: list[str]) -> None:
        at = len(self.index)
        while at + len(words) > len(self.sums):  # one text may hold more words than the cache
            self.sums, self.counts, self.first = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.counts, self.first))
        self.index.update(zip(words, range(at, at + len(words)), strict=True))
        first, grams, owners = word_features(words)
        to = slice(at, at + len(words))
        self.sums[to] = self.weights[first] + np.bincount(owners, self.weights[grams], len(words))
        self.counts[to], self.first[to] = 1 + np.bincount(owners, minlength=len(words)), first

    def score(self, text: str | None) -> float:
        """The softmax's share of class 1."""
        if len(self.index) > CACHE * 3 // 4:
            self.__init__(self.weights, self.bias)
        words, total = _WORD.findall(text or ""), 0.0
        if words:
            at = list(map(self.index.get, words))
            if None in at:
                self._learn(list({w: None for w, k in zip(words, at, strict=True) if k is None}))
                at = list(map(self.index.get, words))
            at = np.array(at)
            total = (self.sums[at].sum() + self.weights[_pairs(self.first[at])].sum()) / (self.counts[at].sum() + len(at) - 1)
        return float(1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500))))


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, counts, class)."""
    classes = {y for _, _, y in examples}
    if len(classes) < 2:
        return Model(np.zeros(BUCKETS), {0: -20.0, 1: 20.0}[classes.pop()] if classes else 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    out, bias = np.zeros((DIMENSIONS, 2)), np.zeros(2)
    share = [sum(y == c for *_, y in examples) / len(examples) for c in (0, 1)]
    turns, total = 0, EPOCHS * len(examples)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            ids, counts, y = examples[k]
            rate = RATE * (1 - turns / total)
            turns += 1
            if not len(ids):
                continue
            part = counts / counts.sum()
            hidden = part @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= 0.5 / share[y]  # both classes weigh alike
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= 0.1 * rate * p
            vectors[ids] -= (rate * part)[:, None] * back
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def within(sizes: list[int], most: int) -> int:
    """How many rows of these sizes fit, in order; one does always."""
    total = 0
    for k, n in enumerate(sizes):
        total += n
        if total > most and k:
            return k
    return len(sizes)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, most_features: int = SAMPLE_FEATURES) -> Model:
    """Learns from labelled documents for which ``learn`` (over doc_id) holds. The sample is
    picked from ids alone; only its documents' texts are then looked up, so no text is
    shuffled. The ids are at most ``sample`` of each class, which bounds the broadcast. Feature
    counts are written as a table; the driver sees their sizes first, and then reads the rows
    that ``most_features`` has room for."""
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")).where(learn)
    known = marks.distinct().join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    # the smallest hashes of each class: an ordered limit, so no task holds more than it takes
    picked = [known.where(F.col("quality") == c).orderBy("h", "doc_id").limit(sample) for c in (0, 1)]
    texts = docs.where(learn).select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    texts = texts.select(F.xxhash64("doc_id", "text").alias("h"), "quality", "text")
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [feature_counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": b.column("h"), "quality": b.column("quality"), "ids": pa.array([i.astype("<i4").tobytes() for i, _ in both], pa.binary()), "counts": pa.array([c.astype("<i4").tobytes() for _, c in both], pa.binary())})

    rows = stored(texts.mapInArrow(features, schema), "quality-sample").withColumn("key", F.xxhash64("ids", "counts"))
    examples = []
    for c in (0, 1):
        own = rows.where(F.col("quality") == c)
        sizes = own.select("h", "key", F.floor(F.octet_length("ids") / 4).alias("n")).orderBy("h", "key").limit(sample).collect()
        if not sizes:
            continue
        # repeated ids may bring more rows than ids: the limits hold for rows too
        count = within([r["n"] for r in sizes], most_features)
        last = sizes[count - 1]
        upto = (F.col("h") < last["h"]) | (F.col("h") == last["h"]) & (F.col("key") <= last["key"])
        for r in own.where(upto).select("h", "key", "ids", "counts").orderBy("h", "key").limit(count).collect():
            examples.append((np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4").astype(np.float32), c))
    return train(examples)


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([model.score(t) for t in b.column("text").to_pylist()], dtype=np.float64)
            columns = {n: b.column(n) for n in b.schema.names}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))})

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(each, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no training sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
