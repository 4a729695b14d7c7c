import random
import zlib
from collections import Counter, defaultdict

import pytest

from lexspan.llm import sharding

from .helpers import DOCS, awkward, doc, sentence


def brute_capacity(sizes, shards):
    """Least largest part over all ways to cut, by dynamic programming."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = ends[:]
    for _ in range(shards - 1):
        best = [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))]
    return best[-1]


@pytest.mark.parametrize("seed", range(8))
def test_smallest_capacity(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 5, 50, 400]) + r.randrange(30) for _ in range(r.randrange(1, 40))]
    shards = r.randrange(1, 8)
    assert sharding.smallest_capacity(sizes, shards) == brute_capacity(sizes, shards)


@pytest.mark.parametrize("most_groups", [8, 50, 100_000])
def test_find_cuts_is_exact_at_every_level(spark, most_groups):
    r = random.Random(3)
    groups = [(r.getrandbits(64) - 2**63, 8 + r.randrange(300)) for _ in range(700)] + [(5, 90_000), (-9, 40_000)]
    alone, begins = sharding.find_cuts(spark.createDataFrame(groups, "g long, bytes long"), 6, most_groups)
    assert alone == [5, -9]
    rest = sorted((g & (2**64 - 1), b) for g, b in groups if g not in alone)
    loads = [0] * 4
    for g, b in rest:
        loads[sum(g - 2**63 >= x for x in begins)] += b
    assert len(begins) == 3
    assert max(loads) == brute_capacity([b for _, b in rest], 4)


def test_shards(spark):
    rows = awkward(sentence) + [doc(500 + k, sentence(1000), "hot") for k in range(300)]
    got = sharding.shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        of_text[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
