import random

from pyspark.sql import functions as F

from lexspan.llm import quality_model

from .helpers import DOCS, awkward, doc, sentence


def good(r):
    return " ".join(r.choice(["the", "river", "walks", "slowly", "house", "under", "green"]) + r.choice(["", ",", "ing"]) for _ in range(r.randrange(20, 60))) + "."


def bad(r):
    return " ".join(r.choice(["BUY", "NOW", "free%%%", "win$$$", "|", "click!!"]) + r.choice(["!!", "%%%", ""]) for _ in range(r.randrange(20, 60)))


def corpus(n, seed=1):
    r = random.Random(seed)
    return [doc(i, good(r) if i % 3 else bad(r)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0), 0) for r in rows], "doc_id long, quality int, toxic int")
    out = quality_model.held_out(F.col("doc_id"))
    model = quality_model.fit(docs, labels, ~out)
    got = quality_model.classify(docs.withColumn("held_out", out), model).where("held_out").collect()
    assert len(got) > 60
    assert all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got)
    # again from the start: the same scores
    again = quality_model.classify(docs.withColumn("held_out", out), quality_model.fit(docs, labels, ~out)).where("held_out")
    assert {r["doc_id"]: r["score"] for r in got} == {r["doc_id"]: r["score"] for r in again.collect()}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    out = quality_model.held_out(F.col("doc_id"))
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0), 0) for r in rows], "doc_id long, quality int, toxic int")
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.fit(docs, x, ~out) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_scores_are_the_mean_of_features(spark):
    """The per-word shortcut against the features one by one."""
    r = random.Random(5)
    model = quality_model.Model(quality_model.np.random.default_rng(0).normal(size=quality_model.BUCKETS), 0.3)
    for text in ["", None, "one", "a a a b", good(r), bad(r), "ü€𝄞 " * 30]:
        ids, counts = quality_model.feature_counts(text)
        want = 0.3 + (float((model.weights[ids] * counts).sum() / counts.sum()) if len(ids) else 0)
        assert abs(model.score(text) - 1 / (1 + quality_model.np.exp(-want))) < 1e-9


def test_awkward_rows_and_missing_classes(spark):
    docs = spark.createDataFrame(awkward(sentence), DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = quality_model.fit(docs, none, F.lit(True))
    got = quality_model.classify(docs, m)
    assert got.columns == [f.name for f in DOCS if f.name != "score"] + ["score", "predicted"]
    assert {r["score"] for r in got.collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 7, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 1 for r in quality_model.classify(docs, quality_model.fit(docs, one, F.lit(True))).collect())
    assert quality_model.classify(spark.createDataFrame([], DOCS), m).count() == 0


def test_training_against_a_plain_version():
    """The same gradient steps, feature by feature over plain lists."""
    import math

    import numpy as np

    r = random.Random(4)
    examples = []
    for k in range(12):
        ids, counts = quality_model.feature_counts((good if k % 3 else bad)(r))
        examples.append((ids[:9].astype(np.int32), counts[:9].astype(np.float32), int(k % 3 > 0)))
    model = quality_model.train(examples, seed=3)
    rng, d = np.random.default_rng(3), quality_model.DIMENSIONS
    vectors = rng.uniform(-1 / d, 1 / d, (quality_model.BUCKETS, d))
    used = {int(i): list(vectors[i]) for ids, _, _ in examples for i in ids}
    out, bias = [[0.0, 0.0] for _ in range(d)], [0.0, 0.0]
    share = [sum(y == c for *_, y in examples) / len(examples) for c in (0, 1)]
    step = 0
    for _ in range(quality_model.EPOCHS):
        for k in rng.permutation(len(examples)):
            ids, counts, y = examples[k]
            rate = quality_model.RATE * (1 - step / (quality_model.EPOCHS * len(examples)))
            step += 1
            part = [float(c) / float(sum(counts)) for c in counts]
            hidden = [sum(p * used[int(i)][j] for p, i in zip(part, ids)) for j in range(d)]
            z = [sum(hidden[j] * out[j][c] for j in range(d)) + bias[c] for c in (0, 1)]
            e = [math.exp(x - max(z)) for x in z]
            g = [(e[c] / sum(e) - (c == y)) * 0.5 / share[y] for c in (0, 1)]
            back = [out[j][0] * g[0] + out[j][1] * g[1] for j in range(d)]
            for j in range(d):
                for c in (0, 1):
                    out[j][c] -= rate * hidden[j] * g[c]
            bias = [bias[c] - 0.1 * rate * g[c] for c in (0, 1)]
            for p, i in zip(part, ids):
                used[int(i)] = [v - rate * p * b for v, b in zip(used[int(i)], back)]
    assert abs(model.bias - (bias[1] - bias[0])) < 1e-5
    for i, v in used.items():
        assert abs(model.weights[i] - sum(v[j] * (out[j][1] - out[j][0]) for j in range(d))) < 1e-5


def test_sample_is_bounded_in_features(spark):
    assert quality_model.within([], 5) == 0 and quality_model.within([9, 9], 5) == 1
    assert quality_model.within([3, 2, 1], 5) == 2 and quality_model.within([1] * 7, 7) == 7
    rows = corpus(60) + [doc(1000, "x" + " many different words".join(str(k) for k in range(5000)))]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0), 0) for r in rows], "doc_id long, quality int, toxic int")
    few = quality_model.fit(docs, labels, F.lit(True), most_features=2000)
    again = quality_model.fit(docs.repartition(5), labels, F.lit(True), most_features=2000)
    every = quality_model.fit(docs, labels, F.lit(True))
    assert (few.weights == again.weights).all() and (few.weights != every.weights).any()


def test_accuracy_on_the_driver_s_labels(spark):
    """Held-out labelled rows, which no training saw."""
    import os

    import pytest

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(f"{sf}/labels.parquet"):
        pytest.skip("no tables")
    from lexspan.llm import queries

    got = queries.op3_quality_model(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality IS NOT NULL"), "doc_id").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)
