import random
import re

import numpy as np
import pytest

from lexspan.llm import components, jaccard

from .helpers import DOCS, awkward, doc, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    """(doc_id, text) -> (links, class as the least row in it), over all pairs."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return links, list(groups.values())


def near(r, text, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def check(spark, rows):
    got = jaccard.near_classes(spark.createDataFrame(rows, DOCS)).collect()
    links, groups = brute(rows)
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["n_links"]) for r in got) == sorted((r[0] or -1, n) for r, n in zip(rows, links))
    found = {}
    for r in got:
        found.setdefault(r["class_id"], []).append(-1 if r["doc_id"] is None else r["doc_id"])
    assert sorted(map(sorted, found.values())) == sorted(sorted(-1 if rows[i][0] is None else rows[i][0] for i in g) for g in groups)
    ids = [r[0] for r in rows]
    assert all(c == min(x for x in m if x >= 0) for c, m in found.items() if max(m) >= 0 and all(ids.count(x) == 1 for x in m))
    return got, groups


def test_matches_brute_force(spark):
    r = random.Random(4)
    bases = [" ".join(f"w{r.randrange(5000)}" for _ in range(r.randrange(30, 200))) for _ in range(12)]
    rows = awkward(sentence)
    for k in range(160):
        b = bases[k % 12]
        rows.append(doc(1000 + k, near(r, b, r.randrange(0, 6))))
    shared = " ".join(f"common{k}" for k in range(25))
    rows += [doc(2000 + k, f"{shared} " + " ".join(f"u{k}x{j}" for j in range(20))) for k in range(40)]
    rows += [doc(3000 + k, "a b c") for k in range(3)] + [doc(3010, "a b c d")]
    got, groups = check(spark, rows)
    kept = jaccard.keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [f.name for f in DOCS]
    # a doc_id that stands with several texts may be first in several classes
    assert kept.count() == len(groups)


@pytest.mark.parametrize("blocks", [(4, 4), (16, 3)])
def test_large_groups_go_in_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(jaccard, "BAND_BLOCK", blocks[0])
    monkeypatch.setattr(jaccard, "VERIFY_BLOCK", blocks[1])
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1000 * blocks[1] // 4)
    r = random.Random(9)
    base = " ".join(f"v{k}" for k in range(150))
    check(spark, [doc(k, near(r, base, k % 5)) for k in range(60)])


def test_empty(spark):
    assert jaccard.near_classes(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_table():
    looks = jaccard.least_matches()
    assert [n for n, _ in looks] == list(range(jaccard.STEP, jaccard.HASHES + 1, jaccard.STEP))
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (2000, jaccard.HASHES), dtype=np.uint64).astype(np.uint32)
    pairs = np.arange(2000)
    for similarity, low, high in ((0.8, 2000, 2000), (0.3, 0, 0)):
        b = np.where(rng.random(a.shape) < similarity, a, a + 1)
        assert low <= len(jaccard.surviving(a, b, pairs, pairs, looks)) <= high


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, 100 + k) for k in range(1, 40)] + [(500 + r.randrange(40), 500 + r.randrange(40)) for _ in range(60)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(100):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    alone = {n for n in label if not any(n in e and e[0] != e[1] for e in edges)}
    assert got == {n: x for n, x in label.items() if n not in alone}


def test_no_link_of_the_driver_s_table_is_lost(spark):
    """All pairs of ``documents`` that share a shingle, counted exactly."""
    import os
    from collections import Counter, defaultdict

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(f"{sf}/documents.parquet"):
        pytest.skip("no tables")
    from lexspan.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    both = Counter()
    for h in holders.values():
        both.update((a, b) for k, a in enumerate(h) for b in h[k + 1 :])
    links, label = Counter(), {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            low, high = sorted((find(a), find(b)))
            label[high] = low
    got = queries.op7_jaccard_join(spark, sf).collect()
    assert sum(links.values()) > 100
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == {i: (links[i], find(i)) for i in sets}
