import math

from pyspark.sql import Row
from pyspark.sql import types as T

from lexspan.llm import mixing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.LongType())])


def water_fill(sizes, weights, share, most):
    """The contract's words: deal by weight, cap, deal the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def test_targets_and_cuts(spark):
    rows = [Row(doc_id=i, text=" ".join(["w"] * (i % 37)), source=f"s{i % 7}" if i % 5 else "s0", size=0) for i in range(700)]
    rows += [Row(doc_id=None, text=None, source=None, size=0), Row(doc_id=5, text="", source=None, size=0), Row(doc_id=9, text="a b c", source=None, size=0)]
    got = mixing.plan_mix(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = water_fill(sizes, (5, 2, 1), 1.5, 2.0)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 19
    assert sum(want.values()) <= 1.5 * sum(sizes.values()) + 1e-6


def test_equal_on_rerun_and_mix_matches_plan(spark):
    rows = [Row(doc_id=i % 50, text=f"word{i % 50} and more", source="ab"[i % 2], size=7) for i in range(120)]
    d = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, mixing.plan_mix(d).collect())) for _ in range(2))
    assert a == b
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    assert mixed.count() == sum(r[5] for r in a)


def test_empty(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert mixing.plan_mix(d).count() == 0
    assert mixing.mix(d).count() == 0
