"""The pipeline against a plain version of each stage, on its own input."""

import random
from collections import Counter

import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

import corpus_pipeline
from lexspan.llm import mixing, packing

from .test_jaccard import brute, near
from .test_line_operators import brute_dedup
from .test_packing import check as check_pieces
from .test_quality_model import bad, good

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    r = random.Random(11)
    home = str(tmp_path_factory.mktemp("sf"))
    rows = []
    for i in range(360):
        lines = [good(r) if i % 6 else bad(r) for _ in range(4)]
        if i % 6 and i % 4 == 0:
            lines.append("This line stands on every site of all.")
        rows.append((i, "\n".join(lines), "en", f"site{i % 13}"))
    originals = [x for x in rows if x[0] % 6][:20]
    rows += [(1000 + k, near(r, originals[k % 20][1], k % 2 * 2), "en", f"site{k % 13}") for k in range(60)]
    rows += [(2000, None, None, None), (2001, "", "en", "site1"), (2002, good(r), None, None), rows[1], rows[1]]
    docs = [(*x, None if x[1] is None else len(x[1])) for x in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(360)], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    found, d = [[tuple(x) for x in docs]], spark.read.parquet(f"{home}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, d, home).write.parquet(f"{home}/out{k}")
        d = spark.read.parquet(f"{home}/out{k}")
        found.append(d.collect())
        if k < 4:
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return home, found


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mixed", "packed"]


def test_quality_keeps_clean_documents(stages):
    _, (docs, kept, *_) = stages
    ids = {r["doc_id"] for r in kept}
    assert all(i in ids for i in range(360) if i % 6) and not any(i in ids for i in range(0, 360, 6))
    assert {(r["doc_id"], r["text"]) for r in kept} <= {(x[0], x[1]) for x in docs}


def test_lines(stages):
    _, (_, before, after, *_) = stages
    want = brute_dedup([tuple(r)[:2] + ("en", r["source"]) for r in before], 10)
    had = Counter((r["doc_id"], r["text"]) for r in before)
    emptied = Counter({k: n for k, n in want.items() if k not in had and not (k[1] or "").strip()})
    assert Counter((r["doc_id"], r["text"]) for r in after) == want - emptied
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in after)
    assert sum((r["text"] or "").split("\n").count("This line stands on every site of all.") for r in after) == 1


def test_one_of_each_group_stays(stages):
    _, (_, _, before, after, *_) = stages
    rows = [tuple(r) for r in before]
    _, groups = brute(rows)
    least = Counter(min(((rows[i][0] is None, rows[i][0]), rows[i][1]) for i in g)[0][1] for g in groups)
    assert Counter(r["doc_id"] for r in after) == least


def test_mixed(spark, stages):
    home, (_, _, _, before, after, _) = stages
    plan = mixing.plan_mix(spark.createDataFrame(before, SCHEMA)).collect()
    assert Counter(r["doc_id"] for r in after) == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    texts = {r["doc_id"]: r["text"] for r in before}
    assert all(r["text"] == texts[r["doc_id"]] for r in after)


def test_packed(stages):
    from tokenizers import Tokenizer

    _, (*_, before, after) = stages
    check_pieces([tuple(r) for r in before], after, Tokenizer.from_file(packing.default_tokenizer()))


def test_run_equals_the_stages(spark, stages):
    home, found = stages
    got = corpus_pipeline.run(spark, home).collect()
    # document ids that repeat are interchangeable; all else is the same on every run
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in found[-1])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
