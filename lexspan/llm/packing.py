"""Packing with lexical retrieval.

Documents become token ids with an end mark. Whole windows of a long document are sequences
of their own; what is left of each document (a unit, under a window) is packed so that a
sequence holds documents that belong together. The inverted index is sharded: all units of
the corpus are ordered by a lexical key, and every contiguous run of ``SHARD_ROWS`` units or
``SHARD_TOKENS`` tokens, about, is a shard with postings of its own. In a shard, each seed
asks with all terms of its unit; BM25 over the shard's postings, with the document
frequencies and mean length of all documents, ranks the unused units, and they fill the
seed's window greedily, the last one cut to fit, its rest staying available. When no unused
unit shares a term, the next ones in the key's order fill the window.

The key puts neighbours into one shard: first the path through a tree of two-way splits
(TF-IDF directions, fitted on a bounded sample, ``SAMPLE`` units chosen by hash; every unit
of the corpus is then sent down the tree), then a MinHash of token pairs, so near copies are
adjacent within a leaf, then the row's own hash. The order is cut at exact quantiles of the
key, so a leaf of any size is split, copies that hold a third of all rows too; rows that repeat
wholly and fill more than a shard are dealt over the shards that their key spans. Neighbours
beyond a shard's border aren't found: the README has the measured share.

What remains of a shard goes into sequences of descending powers of two, which need no
padding; so there is no padding at all. Results are the same however the input is partitioned
(rows that repeat wholly are interchangeable), but for rows that repeat wholly and fill more
than a shard: those are dealt by their places in the input's partitions. A null text counts as empty: its one token is the end mark. Null
ids are allowed. Every document yields at least one piece. Columns besides ``doc_id`` and
``text`` aren't used.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

WINDOW = 4096
END = 2
#: Units and tokens of a shard of the index, about.
SHARD_ROWS, SHARD_TOKENS = 10_000, 8_000_000
#: Units that the tree of the lexical key is fitted on, and hashed dimensions of its directions.
SAMPLE, DIMS = 2048, 4096
#: Levels of the tree, and units of the sample that a node needs to be split.
DEPTH, LEAST = 12, 16
K1, B = 1.2, 0.75
_LOG = np.log1p(np.arange(1 << 12))
#: Seeds scored at a time, neighbours sorted first, and bytes of the matrix that holds a
#: shard's frequent terms.
SEEDS, FIRST, MATRIX_BYTES = 32, 64, 48 << 20
#: Words, and parts of words, whose ids a worker keeps; the first ones stay, for the frequent
#: ones come early.
WORDS, PARTS = 150_000, 350_000
#: Characters of text whose words are told apart at a time.
CHUNK = 6_000_000

#: Texts of these characters alone split into words at white space for this tokenizer, which
#: lower-cases, drops white space and never joins tokens across it.
_PLAIN = re.compile(r"[^\t-\r -~\xa1-įı-ɏ]")
# A fixed value: how the tokenizer parts lower-cased text before it looks at letters.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = regex.compile(_SPLIT)
_MARKS = set(".,:;!?")
#: The printable stand-ins of byte-level tokenizers: bytes that print in Latin-1 stand for
#: themselves, the others follow from 256 on.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STANDS = {b: chr(b) for b in _PRINTS} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTS)))}


class Ids:
    """Token ids as little-endian 16-bit numbers; keeps the ids of words it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("more than 65536 tokens")
        self.model = self.tokenizer.model
        self.by_parts = self._known_kind()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _known_kind(self) -> bool:
        """Whether text may be taken apart here, as this kind of tokenizer would do itself."""
        spec = json.loads(self.tokenizer.to_str())
        kinds = lambda x, many: [y["type"] for y in (x or {}).get(many, [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        bpe = spec["model"]
        return (
            kinds(spec["normalizer"], "normalizers") == ["NFC", "Replace", "Lowercase"]
            and kinds(spec["pre_tokenizer"], "pretokenizers") == ["Split", "ByteLevel"]
            and parts[0].get("pattern") == {"Regex": _SPLIT}
            and not parts[1]["add_prefix_space"]
            and bpe["type"] == "BPE"
            and not bpe["dropout"]
        )

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            # the merges alone: the part is normal already and can't be parted further
            shown = part if part.isascii() else "".join(map(_STANDS.__getitem__, part.encode()))
            ids = [t.id for t in self.model.tokenize(shown)]
            found = struct.pack(f"<{len(ids)}H", *ids)
            if len(self.parts) < PARTS:
                self.parts[part] = found
        return found

    def word(self, word: str) -> bytes:
        low = word.lower()
        if low.isalpha():  # letters alone, or with one mark behind them: nothing to part
            found = self.part(low)
        elif low[-1:] in _MARKS and low[:-1].isalpha():
            found = self.part(low[:-1]) + self.part(low[-1])
        # the special tokens are the only ones that a part can't show
        else:
            found = self.whole(word) if "<|" in word else b"".join(map(self.part, _PARTS.findall(low)))
        if len(self.words) < WORDS:
            self.words[word] = found
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Words are parted, told apart and put together again by Arrow;
        only the distinct words of some megabytes of text at a time are looked up here."""
        out = [b""] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if t and (not self.by_parts or _PLAIN.search(t)):
                out[i] = self.whole(t)
            elif t:
                held.append(i)
                size += len(t)
            if size > CHUNK or i == len(texts) - 1 and held:
                for k, ids in zip(held, self._plain(pa.array([texts[k] for k in held], pa.large_string())), strict=True):
                    out[k] = ids
                held, size = [], 0
        return out

    def _plain(self, texts: pa.Array) -> list[bytes]:
        words = pc.ascii_split_whitespace(texts)
        coded = words.values.dictionary_encode()
        known = self.words.get
        ids = [known(w) or self.word(w) for w in coded.dictionary.to_pylist()]
        joined = pa.array(ids, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(joined.buffers()[1], np.int64)[words.offsets.to_numpy()]
        data = memoryview(joined.buffers()[2] or b"")
        return [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One per worker process, so its cache outlives a task."""
    return Ids(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Index:
    """BM25 over a shard's units; ``idf`` by term and ``mean`` length are those of all documents
    if given, else the shard's own. Frequent terms stand in a matrix, so that seeds are scored
    by matrix products; the others in posting lists. Every term counts."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray | None = None, mean: float | None = None):
        profiles = [profile(d) for d in docs]
        n, length = len(docs), np.array([len(d) for d in docs], np.int64)
        sizes = [len(t) for t, _ in profiles]
        term = np.concatenate([t for t, _ in profiles])
        count = np.concatenate([c for _, c in profiles])
        del profiles
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        df = np.bincount(term, minlength=1 << 16)
        if idf is None:
            idf = inverse(df, n)
        mean = max(1.0, length.mean()) if mean is None else mean
        impact = (idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean)[owner])).astype(np.float32)
        del count
        self.terms = np.split(term, np.cumsum(sizes)[:-1])
        self.live = np.arange(n)  # the units in the index
        frequent = np.argsort(-df, kind="stable")[: min(np.count_nonzero(df > n // 64), MATRIX_BYTES // 4 // n)]
        self.column = np.full(1 << 16, -1)
        self.column[frequent] = np.arange(len(frequent))
        place = self.column[term]
        self.matrix = np.zeros((n, len(frequent)), np.float32)
        self.matrix[owner[place >= 0], place[place >= 0]] = impact[place >= 0]
        term, owner, impact = term[place < 0], owner[place < 0], impact[place < 0]
        order = np.argsort(term, kind="stable")
        self._post(term[order], owner[order], impact[order])

    def _post(self, term: np.ndarray, owner: np.ndarray, impact: np.ndarray) -> None:
        self.term, self.owner, self.impact = term, owner, impact
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=1 << 16))])

    def shrink(self, unused: np.ndarray) -> None:
        """Drops units that are used up."""
        stay = unused[self.live]
        place = (np.cumsum(stay) - 1).astype(np.int32)
        keep = stay[self.owner]
        self._post(self.term[keep], place[self.owner[keep]], self.impact[keep])
        self.matrix, self.live = self.matrix[stay], self.live[stay]

    def scores(self, seeds: list[int]) -> np.ndarray:
        """A row per seed: its whole unit's score against every unit in the index."""
        asked = np.zeros((len(seeds), self.matrix.shape[1]), np.float32)
        for row, k in zip(asked, seeds, strict=True):
            column = self.column[self.terms[k]]
            row[column[column >= 0]] = 1
        out = asked @ self.matrix.T
        for row, k in zip(out, seeds, strict=True):
            spans = [slice(a, b) for a, b in zip(self.start[self.terms[k]].tolist(), self.start[self.terms[k] + 1].tolist(), strict=True) if b > a]
            if spans:
                row += np.bincount(np.concatenate([self.owner[s] for s in spans]), np.concatenate([self.impact[s] for s in spans]), len(row)).astype(np.float32)
        return out

    def best(self, score: np.ndarray, unused: np.ndarray) -> Iterator[int]:
        """Unused units of a score over zero, best first, ties in the index's order. The first
        are sorted alone, as a window seldom takes more."""
        score = np.where(unused[self.live], score, 0)
        if len(score) > FIRST:
            least = max(np.partition(score, len(score) - FIRST)[len(score) - FIRST], np.float32(1e-30))
            at = np.flatnonzero(score >= least)
            yield from self.live[at[np.argsort(-score[at], kind="stable")]].tolist()
            score[at] = 0
        at = np.flatnonzero(score > 0)
        yield from self.live[at[np.argsort(-score[at], kind="stable")]].tolist()

    def neighbours(self, doc: int, unused: np.ndarray) -> np.ndarray:
        """Unused units that share a term, best first."""
        return np.array(list(self.best(self.scores([doc])[0], unused)), np.int64)


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def pack_shard(docs: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) of a corpus of one shard."""
    sequences = [[(k, at, window)] for k, d in enumerate(docs) for at in range(0, len(d) // window * window, window)]
    tails = [d[len(d) // window * window :] for d in docs]
    units = [k for k, t in enumerate(tails) if len(t)]
    if not units:
        return sequences
    packed = fill([tails[k] for k in units], Index([docs[k] for k in units]), window)
    return sequences + [[(units[k], len(docs[units[k]]) // window * window + at, n) for k, at, n in pieces] for pieces in packed]


def fill(units: list[np.ndarray], index: Index, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (unit, start, length) of units of under a window each."""
    sequences: list[list[tuple[int, int, int]]] = []
    left = np.array([len(u) for u in units], np.int64)
    start = np.zeros_like(left)
    unused = left > 0
    total, seed, held = int(left.sum()), 0, int(unused.sum())
    ahead: dict[int, np.ndarray] = {}
    while total >= window:
        while not unused[seed]:
            seed += 1
        pieces, room = [], window

        def take(k: int) -> None:
            nonlocal room
            n = int(min(room, left[k]))
            pieces.append((int(k), int(start[k]), n))
            start[k] += n
            left[k] -= n
            room -= n
            unused[k] = left[k] > 0

        if seed not in ahead:
            # the next seeds together; what this one takes from them costs little
            soon = seed + np.flatnonzero(unused[seed : seed + 8 * SEEDS])[:SEEDS]
            ahead = dict(zip(soon.tolist(), index.scores(soon.tolist()), strict=True))
        take(seed)
        for k in index.best(ahead[seed], unused):
            take(k)
            if not room:
                break
        after = seed
        while room:
            while not unused[after]:
                after += 1
            take(after)
        total -= window
        sequences.append(pieces)
        if int(unused.sum()) * 2 < held:
            held, ahead = int(unused.sum()), {}
            index.shrink(unused)
    # under a window is left: powers of two, largest first
    rest = [(int(k), int(start[k]), int(left[k])) for k in np.flatnonzero(unused)]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        pieces = []
        while room:
            k, at, n = rest.pop(0)
            if n > room:
                rest.insert(0, (k, at + room, n - room))
                n = room
            pieces.append((k, at, n))
            room -= n
        sequences.append(pieces)
    return sequences


def profile(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct tokens and their counts; 16-bit numbers are sorted by their digits."""
    x = np.sort(ids, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[at].astype(np.int32), np.diff(at, append=len(x)).astype(np.int32)


def direction(ids: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF weights of length one: hashed places (some twice) and values."""
    terms, counts = profile(ids)
    weight = idf[terms] * _LOG[np.minimum(counts, len(_LOG) - 1)]
    return terms % DIMS, (weight / max(1e-12, float(np.sqrt(weight @ weight)))).astype(np.float32)


class Tree:
    """Two-way splits by a hyperplane each. A node's plane lies between two means, found by a
    few rounds of 2-means from the node's two most distant units of a fixed pick."""

    def __init__(self, rows: np.ndarray):
        self.planes: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.below: list[tuple[int, int]] = []
        self.root = self._split(rows, np.arange(len(rows)), 0)

    def _split(self, every: np.ndarray, own: np.ndarray, depth: int) -> int:
        """The number of the node made for these rows of the sample, -1 for a leaf."""
        if depth == DEPTH or len(own) < LEAST:
            return -1
        rows = every if len(own) == len(every) else every[own]
        far = rows[int(np.argmin(rows @ rows[0]))]
        a, b = far, rows[int(np.argmin(rows @ far))]
        for _ in range(6):
            plane = (a - b).astype(np.float32)
            cut = float(a @ a - b @ b) / 2
            side = rows @ plane > cut
            if side.all() or not side.any():
                return -1
            # means as products, so that no part of the rows is copied
            a, b = side.astype(np.float32) @ rows / side.sum(), (~side).astype(np.float32) @ rows / (~side).sum()
        del rows  # not held on the way down
        node = len(self.planes)
        self.planes.append(plane)
        self.cuts.append(cut)
        self.below.append((-1, -1))
        self.below[node] = (self._split(every, own[~side], depth + 1), self._split(every, own[side], depth + 1))
        return node

    def path(self, at: np.ndarray, values: np.ndarray) -> int:
        """The turns on the way down, from the highest of ``DEPTH`` bits."""
        node, path = self.root, 0
        for level in range(DEPTH - 1, -1, -1):
            if node < 0:
                break
            turn = float(self.planes[node][at] @ values) > self.cuts[node]
            path |= int(turn) << level
            node = self.below[node][turn]
        return path


def pair_hash(ids: np.ndarray) -> int:
    """24 bits of the least hash of two neighbouring tokens."""
    x = ids.astype(np.uint32)
    x = (x[:-1] << np.uint32(16) | x[1:]) if len(x) > 1 else x
    x = (x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    return int((x * np.uint32(0x297A2D39)).min()) * 0x9E3779B97F4A7C15 >> 40 & 0xFFFFFF


def lexical_key(ids: np.ndarray, h: int, idf: np.ndarray, tree: Tree) -> int:
    """52 bits, which a double holds exactly: the path in the tree, 24 bits of the MinHash of
    token pairs, 16 of the row's hash."""
    return tree.path(*direction(ids, idf)) << 40 | pair_hash(ids) << 16 | h & 0xFFFF


UNIT = "doc_id long, h long, r long, n long, key long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_keys(units: DataFrame, shards: int, rows: int) -> np.ndarray:
    """The keys, ascending, that hold the borders of ``shards`` even shares of ``rows`` units;
    a key of several shares stands as often as borders lie in it. Counts are exact, so the
    borders depend neither on partitions nor on the order in which tasks end. Windows run over
    distinct keys within ranges of the key's top bits; what the driver gets is a count for each
    of at most 65,536 ranges, and the borders."""
    if shards < 2:
        return np.zeros(0, np.int64)
    top = F.shiftright("key", 36)
    counts = stored(units.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "packing-keys").withColumn("top", top)
    ranges = counts.groupBy("top").agg(F.sum("c").alias("c")).toArrow().sort_by("top")
    before = np.cumsum([0, *ranges.column("c").to_pylist()])[:-1]
    base = units.sparkSession.createDataFrame(pa.table({"top": ranges.column("top"), "base": pa.array(before, pa.int64())}))
    upto = F.col("base") + F.sum("c").over(Window.partitionBy("top").orderBy("key"))
    at = counts.join(F.broadcast(base), "top").select("key", "c", upto.alias("upto"))
    at = at.selectExpr("key", f"(upto - c) * {shards} div {rows} AS low", f"least(upto * {shards} div {rows}, {shards - 1}) AS high")
    found = at.where("high > low").select("key", (F.col("high") - F.col("low")).alias("n")).toArrow().sort_by("key")
    return np.repeat(found.column("key").to_numpy(), found.column("n").to_numpy()).astype(np.int64)


def _crc(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())


def _piece_table(rows: list[tuple]) -> dict[str, pa.Array]:
    return {x.split()[0]: pa.array([r[i] for r in rows], pa.int64()) for i, x in enumerate(PIECES.split(", "))}


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, a row per piece."""
    path = tokenizer or default_tokenizer()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("h"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(path), np.array([END], dtype="<u2").tobytes()
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "h": b.column("h"), "ids": pa.array([x + end for x in ids(b.column("text").to_pylist())], pa.binary())})

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for b in batches:
            for x in b.column("ids").to_pylist():
                df[profile(np.frombuffer(x, "<u2"))[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(at, pa.int64()), "df": pa.array(df[at], pa.int64())})

    coded = d.mapInArrow(encode, "doc_id long, h long, ids binary").withColumn("r", F.monotonically_increasing_id())
    coded = stored(coded, "packing-ids").withColumn("n", F.floor(F.octet_length("ids") / 2).cast("long"))
    facts = coded.agg(F.count(F.lit(1)), F.avg("n"), F.count(F.when(F.col("n") % window > 0, 1)), F.sum(F.col("n") % window)).first()
    idf, mean = np.zeros(1 << 16), max(1.0, facts[1] or 0.0)
    # in Arrow, which takes the driver a fraction of what rows do
    found = coded.select("ids").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    idf[found.column("term").to_numpy()] = inverse(found.column("df").to_numpy(), facts[0])

    def directions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [direction(np.frombuffer(x, "<u2"), idf) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"h": b.column("h"), "at": pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()), "values": pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())})

    # about SAMPLE rows by hash, at most that many of them
    share = min(1.0, 1.2 * SAMPLE / max(1, facts[0]))
    picked = coded.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int(share * (1 << 30))).select("h", "ids")
    sample = picked.mapInArrow(directions, "h long, at binary, values binary").orderBy(F.xxhash64("h"), "h", "at", "values").limit(SAMPLE).toArrow()
    rows = np.zeros((sample.num_rows, DIMS), np.float32)
    for row, at, values in zip(rows, sample.column("at"), sample.column("values"), strict=True):
        np.add.at(row, np.frombuffer(at.as_py(), "<u2"), np.frombuffer(values.as_py(), "<f4"))
    tree = Tree(rows)
    del rows, sample, found

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of.cache_clear()  # every text has its ids: the worker's memory is for what follows
        for b in batches:
            every = [np.frombuffer(x, "<u2") for x in b.column("ids").to_pylist()]
            keys = [lexical_key(x, h, idf, tree) for x, h in zip(every, b.column("h").to_pylist(), strict=True)]
            tails = [x[len(x) // window * window :].tobytes() for x in every]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "h": b.column("h"), "r": b.column("r"), "n": b.column("n"), "key": pa.array(keys, pa.int64()), "ids": pa.array(tails, pa.binary())})

    units = coded.where(F.col("n") % window > 0).select("doc_id", "h", "r", "n", "ids").mapInArrow(keyed, UNIT)
    units = stored(units, "packing-units")
    shards = max(1, -(-facts[2] // SHARD_ROWS), -(-(facts[3] or 0) // SHARD_TOKENS))
    cuts = cut_keys(units, shards, facts[2])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, r = b.column("key").to_numpy(), b.column("r").to_numpy()
            first, last = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            # a key on one border stays whole; only rows that repeat wholly make one span more,
            # and are dealt over those shards
            mixed = (r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
            yield b.append_column("shard", pa.array(first + np.where(last > first + 1, mixed % (last - first + 1), 0), pa.int64()))

    def packed(key: tuple, t: pa.Table) -> pa.Table:
        ids_of.cache_clear()
        t = t.sort_by([("key", "ascending"), ("h", "ascending"), ("r", "ascending")])
        ids = [np.frombuffer(x, "<u2") for x in t.column("ids").to_pylist()]
        doc_ids, ns = t.column("doc_id").to_pylist(), t.column("n").to_pylist()
        out: list[tuple] = []
        number, low = key[0].as_py() << 32, 0
        while low < len(ids):
            # a shard of many long units is indexed in runs, which bounds its memory
            high = low + max(1, int(np.searchsorted(np.cumsum([len(x) for x in ids[low : low + 2 * SHARD_ROWS]]), 2 * SHARD_TOKENS, "right")))
            run = ids[low:high]
            for pieces in fill(run, Index(run, idf, mean), window):
                offset = 0
                for k, at, n in pieces:
                    whole = ns[low + k]
                    out.append((doc_ids[low + k], whole // window * window + at, n, _crc(run[k][at : at + n]), whole, number, offset))
                    offset += n
                number += 1
            low = high
        return pa.table(_piece_table(out))

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, hs, rs = [], [], []
            for doc_id, h, r, n, x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h", "r", "n", "ids")), strict=True):
                ids = np.frombuffer(x, "<u2")
                for at in range(0, n // window * window, window):
                    out.append((doc_id, at, window, _crc(ids[at : at + window]), n, 0, 0))
                    hs.append(h)
                    rs.append(r)
            yield pa.RecordBatch.from_pydict({**_piece_table(out), "h": pa.array(hs, pa.int64()), "r": pa.array(rs, pa.int64())})

    tails = units.mapInArrow(dealt, f"{UNIT}, shard long").groupBy("shard").applyInArrow(packed, PIECES)
    # whole windows are numbered within ranges of the hash, from 2**62 on
    bucket = F.shiftrightunsigned("h", 52)
    order = Window.partitionBy(bucket, F.pmod("start", F.lit(window * 64))).orderBy("h", "r", "start")
    nr = (F.row_number().over(order) - 1).cast("long") * 64 + F.floor(F.pmod("start", F.lit(window * 64)) / window)
    every = coded.where(F.col("n") >= window).select("doc_id", "h", "r", "n", "ids").mapInArrow(wholes, f"{PIECES}, h long, r long")
    every = every.withColumn("sequence_id", F.lit(1 << 62) + nr * 4096 + bucket)
    return tails.unionByName(every.select(*(x.split()[0] for x in PIECES.split(", "))))
