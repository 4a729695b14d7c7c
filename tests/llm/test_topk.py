import math
import random

import pytest
from pyspark.sql import functions as F

from lexspan.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k):
    vectors = {}
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        vectors.setdefault((i, tuple(math.floor(64 * x) for x in v)), None)
    out = []
    for q, a in vectors:
        if q % 20:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("shape", ["normal", "ties", "mixed"])
def test_matches_brute_force(spark, shape, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 1)
    monkeypatch.setattr(topk, "LONGEST", 40)
    monkeypatch.setattr(topk, "RUN", 16)
    r = random.Random(shape)
    rows = []
    for i in range(300):
        scale = 10 ** r.uniform(-1, 1) if shape == "mixed" else 1
        v = [0.25, -0.5, 1.0, 0.0] if shape == "ties" and i % 3 else [r.gauss(0, scale) for _ in range(4)]
        rows.append((i, v, i % 5))
    if shape == "mixed":
        rows += [(1000, None, 0), (1020, [], 0), (1040, [1.0, None, 0.0, 0.0], 0), (1060, [1.0, float("nan"), 0.0, 0.0], 0), (1080, [float("inf")] * 4, 0), (None, [1.0] * 4, 0), (1100, [0.0] * 4, 0), (1101, [3.0, 1.0], 1), rows[20], rows[7]]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 20)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [0.5, 0.5], 0), (2, [-1.0, 0.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 20)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0
