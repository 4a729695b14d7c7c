"""Exact top-k search by inner product over norm-sorted, rotated vectors.

Vectors are put into blocks by descending length. A rotation (the eigenvectors of the sum of
outer products over all vectors, which is the SVD's right side) moves most of the weight to
the leading coordinates. A query's k-th best score among the longest vectors is a first
threshold: blocks whose longest vector times the query's length lies under it are never sent
to the query. In a block, runs of vectors are visited by descending length; the partial
product over leading coordinates plus the product of the residual lengths (Cauchy-Schwarz)
bounds each score, and only pairs whose bound reaches the threshold are multiplied out, in
integers. Bounds get a small allowance for rounding, so pruning never loses a result.

Queries go in blocks against blocks of vectors; no task holds more than one block of each,
whatever the corpus, and a length that very many vectors share is split by hash.

Vectors that are null, empty or hold a null or non-finite component, and rows without
vec_id, take no part. Rows that repeat wholly count once; a query never meets a row with its
own vec_id. Shorter vectors are taken as ending in zeros. Components are whole numbers below
2**28 in size after ``floor(scale * x)``; larger ones raise an error, as scores would not fit
a long. Ties go to the smaller vec_id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 64.0
#: Bytes of a block of vectors, about; a block of queries has a quarter of them. The larger the
#: blocks, the fewer copies of a vector are sent: one for each block of queries.
BLOCK_BYTES = 8 << 20
#: Ranges of length; each has its own blocks.
RANGES = 48
#: The longest vectors, which give the first thresholds. A fixed number, so they are broadcast.
LONGEST = 2048
#: Vectors visited at a time in a block.
RUN = 512
LIMIT = 1 << 28


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, v`` (whole numbers as little-endian int32), ``n2`` (squared length)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, n2 = [], [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding"), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(scale * x)
                if np.abs(x).max() >= LIMIT:
                    raise ValueError(f"vector {i}: components of 2**28 or more don't fit")
                ids.append(i)
                out.append(x.astype("<i4").tobytes())
                n2.append(int(np.square(x.astype(np.int64)).sum()))
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "v": pa.array(out, pa.binary()), "n2": pa.array(n2, pa.int64())})

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(each, "vec_id long, v binary, n2 long").dropDuplicates(["vec_id", "v"])


def _matrix(values, dims: int) -> np.ndarray:
    out = np.zeros((len(values), dims))
    for k, v in enumerate(values):
        x = np.frombuffer(v, "<i4")
        out[k, : len(x)] = x
    return out


def rotation(v: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products over all vectors, strongest first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            m = _matrix(b.column("v").to_pylist(), dims)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = v.select("v").mapInArrow(each, "i int, row array<double>")
    sums = parts.groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(dims)]).orderBy("i").collect()
    _, vectors = np.linalg.eigh(np.array([r[1:] for r in sums]))
    return np.ascontiguousarray(vectors[:, ::-1])


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, then smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Block:
    """Vectors by descending length, with what bounds need."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, turn: np.ndarray, lead: int):
        n2 = np.square(m).sum(axis=1)
        order = np.lexsort((ids, -n2))
        self.ids, self.m, self.length = ids[order], m[order], np.sqrt(n2[order])
        rotated = self.m @ turn
        self.lead, self.rest = rotated[:, :lead], np.sqrt(np.square(rotated[:, lead:]).sum(axis=1))
        # float64 sums are exact below 2**53; larger components go through integers
        self.exact = m.shape[1] * float(np.abs(m).max(initial=0)) ** 2 < 2**52


def search(queries: Block, own_floor: np.ndarray, block: Block, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and ids and scores of the block's k best at or above the floor."""
    n = len(queries.ids)
    floor = own_floor.astype(np.float64).copy()
    kept: list[list] = [[np.empty(0, np.int64), np.empty(0, np.int64)] for _ in range(n)]
    slack = 1e-9 * (queries.length * block.length.max(initial=0) + 1)
    for a in range(0, len(block.ids), RUN):
        run = slice(a, a + RUN)
        live = np.flatnonzero(queries.length * block.length[a] + slack >= floor)
        if not len(live):
            break  # what follows is shorter still
        bound = queries.lead[live] @ block.lead[run].T + np.outer(queries.rest[live], block.rest[run])
        hit = bound + slack[live][:, None] >= floor[live][:, None]
        hit &= queries.ids[live][:, None] != block.ids[run][None, :]
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            continue
        q, c = queries.m[live[rows]], block.m[run]
        if queries.exact and block.exact:
            scores = (q @ c.T).astype(np.int64)
        else:
            scores = q.astype(np.int64) @ c.astype(np.int64).T
        for r, row in enumerate(rows):
            at = np.flatnonzero(hit[row])
            i = live[row]
            s = scores[r, at]
            keep = s >= floor[i]
            if not keep.any():
                continue
            ids, s = np.concatenate([kept[i][0], block.ids[run][at[keep]]]), np.concatenate([kept[i][1], s[keep]])
            best = _best(ids, s, k)
            kept[i] = [ids[best], s[best]]
            if len(best) == k:
                floor[i] = max(floor[i], s[best[-1]])
    for i in range(n):
        if len(kept[i][0]):
            yield int(queries.ids[i]), *kept[i]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row where ``is_query`` (over vec_id) holds."""
    spark = vectors.sparkSession
    v = stored(quantised(vectors, scale), "vectors")
    facts = v.agg(F.max(F.octet_length("v")), F.count(F.lit(1)), F.count(F.when(is_query, 1)), F.percentile_approx("n2", [i / RANGES for i in range(1, RANGES)], 10_000)).first()
    if not facts[1] or not facts[2]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = facts[0] // 4
    lead = max(1, dims // 2)
    own_block = max(64, BLOCK_BYTES // (8 * dims))
    query_block = max(16, own_block // 4)
    turn = rotation(v, dims)
    # ranges of squared length, longest first; a range with many vectors is split by hash
    cuts = sorted(set(facts[3]), reverse=True)
    ranged = v.withColumn("range", sum((F.when(F.col("n2") < c, 1).otherwise(0) for c in cuts), F.lit(0)))
    known = {r["range"]: (r["n"], r["most"]) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("n2").alias("most")).collect()}
    splits = F.element_at(F.create_map(*[F.lit(x) for r, (n, _) in known.items() for x in (r, -(-n // own_block))]), F.col("range"))
    blocked = ranged.withColumn("block", F.concat_ws(".", "range", F.pmod(F.xxhash64("vec_id"), splits)))

    # the longest vectors give each query a floor
    longest = v.orderBy(F.desc("n2"), "vec_id").limit(LONGEST).collect()
    first = Block(np.array([r["vec_id"] for r in longest], dtype=np.int64), _matrix([bytes(r["v"]) for r in longest], dims), turn, lead)
    sent = spark.sparkContext.broadcast((first, turn))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, turn = sent.value
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            for a in range(0, len(ids), query_block):
                part = slice(a, a + query_block)
                q = Block(ids[part], _matrix(b.column("v")[part].to_pylist(), dims), turn, lead)
                found = {i: int(s[-1]) for i, _, s in search(q, np.full(len(q.ids), -np.inf), block, k) if len(s) == k}
                # a query's id may stand with several vectors; the lowest floor holds for all
                yield pa.RecordBatch.from_pydict({"vec_id": pa.array(q.ids), "v": pa.array([row.astype("<i4").tobytes() for row in q.m], pa.binary()), "floor": pa.array([found.get(int(i)) for i in q.ids], pa.int64())})

    queries = v.where(is_query).select("vec_id", "v").repartition(max(1, -(-facts[2] // query_block)), "vec_id").mapInArrow(floors, "vec_id long, v binary, floor long")
    queries = stored(queries, "queries")
    groups = max(1, -(-facts[2] // query_block))
    near = [(r, n, float(most) ** 0.5) for r, (n, most) in sorted(known.items())]
    spans = F.array(*[F.struct(F.lit(r).alias("range"), F.lit(most).alias("most"), F.lit(-(-n // own_block)).alias("splits")) for r, n, most in near])
    # a query goes to the blocks whose longest vector can reach its floor
    reached = F.filter(spans, lambda x: F.col("floor").isNull() | (F.sqrt("q2") * x["most"] * (1 + 1e-9) + 1e-6 >= F.col("floor")))
    lengths = v.where(is_query).select("vec_id", "v", F.col("n2").alias("q2"))
    q = queries.join(lengths, ["vec_id", "v"]).withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    q = q.withColumn("to", F.explode(reached)).withColumn("split", F.explode(F.sequence(F.lit(0), F.col("to.splits") - 1)))
    q = q.select("group", F.concat_ws(".", "to.range", "split").alias("block"), "vec_id", "v", "floor")
    pairs = q.select("group", "block").distinct()
    c = blocked.select("block", "vec_id", "v").join(pairs, "block").select(F.col("group").alias("to_group"), F.col("block").alias("own_block"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(left) and len(right):
            _, turn = sent.value
            q = Block(left["vec_id"].to_numpy(np.int64), _matrix(left["v"].tolist(), dims), turn, lead)
            # Block sorts; floors follow their queries
            floor_of = {}
            for i, f in zip(left["vec_id"], left["floor"], strict=True):
                f = -np.inf if f is None or f != f else float(f)
                floor_of[int(i)] = min(floor_of.get(int(i), np.inf), f)
            floor = np.array([floor_of[int(i)] for i in q.ids])
            b = Block(right["vec_id"].to_numpy(np.int64), _matrix(right["v"].tolist(), dims), turn, lead)
            rows = [(i, int(j), int(s)) for i, ids, scores in search(q, floor, b, k) for j, s in zip(ids, scores, strict=True)]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = q.groupBy("group", "block").cogroup(c.groupBy("to_group", "own_block")).applyInPandas(match, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
