import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from lexspan.llm import packing

from .helpers import DOCS, awkward, doc, sentence


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def test_ids_equal_the_tokenizer(tokenizer):
    coder = packing.Ids(packing.default_tokenizer())
    texts = ["it's 'tis _-_ ½² a_b <|endoftext|>x I'LL ''s don't", "", None, "  ", "Straße ǅ ŉ ĳ İ", "日本語 text ٣ 𝄞", "a\x1cb\x85c\xa0d", "é accent", "Hello, World! 123", "x<|startoftext|>", "ΑΣ ς"] + [sentence(k) for k in range(50)]
    for t, got in zip(texts, coder(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t
    # once more with everything known
    assert coder(texts) == packing.Ids(packing.default_tokenizer())(texts)


def test_other_tokenizers_do_their_own_parting():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, whole = packing.Ids(path), Tokenizer.from_file(path)
    assert packing.Ids(packing.default_tokenizer()).by_parts and not coder.by_parts
    for t in ("Hello, World!  two", "It's été\n"):
        assert np.frombuffer(coder([t])[0], "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


def check(rows, got, tokenizer):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    by_id = defaultdict(list)
    for i, text, *_ in rows:
        by_id[i].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4"))
    assert set(pieces) == set(by_id)
    for i, docs in by_id.items():
        if len(docs) > 1:  # several rows share the id: only sums are told apart
            assert sum(p["length"] for p in pieces[i]) == sum(map(len, docs))
            continue
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(docs[0])
            assert p["ids_crc32"] == zlib.crc32(docs[0][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(docs[0])
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == 4096 or at < 4096 and at & (at - 1) == 0


def test_pack(spark, tokenizer, monkeypatch):
    rows = awkward(sentence) + [doc(5000 + k, " ".join(sentence(k + j) for j in range(k % 9))) for k in range(120)]
    d = spark.createDataFrame(rows, DOCS)
    got = packing.pack(d).collect()
    check(rows, got, tokenizer)
    assert sorted(map(repr, got)) == sorted(map(repr, packing.pack(d.repartition(3)).collect()))
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    check(rows, packing.pack(d).collect(), tokenizer)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_neighbours_share_windows():
    """Two themes of documents: windows hold one theme, but for the shard's last ones."""
    r = np.random.default_rng(3)
    docs = [r.integers(0, 300, 900).astype("<u2") + (10_000 if k % 2 else 20_000) for k in range(80)]
    own = [[k % 2 for k, _, _ in s] for s in packing.pack_shard(docs) if sum(n for *_, n in s) == 4096]
    pure = sum(len(set(s)) == 1 for s in own)
    assert len(own) >= 15 and pure >= len(own) - 2


def test_neighbours_match_plain_bm25():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 60, r.integers(5, 40)).astype("<u2") for _ in range(30)]
    index = packing.Index(docs)
    mean = np.mean([len(d) for d in docs])
    df = {t: sum(t in d for d in docs) for t in range(60)}

    def weight(t, d):
        f = int((d == t).sum())
        idf = np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5))
        return idf * f * (packing.K1 + 1) / (f + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))

    unused = np.ones(30, bool)
    unused[[3, 4]] = False
    for q in range(30):
        terms = set(docs[q].tolist())  # all of them, none left out
        scores = {k: sum(weight(t, docs[k]) for t in terms) for k in range(30) if unused[k]}
        got = index.neighbours(q, unused).tolist()
        assert set(got) == {k for k, s in scores.items() if s > 0}
        assert all(scores[a] >= scores[b] - 1e-9 for a, b in zip(got, got[1:]))
        index.shrink(unused)
        assert index.neighbours(q, unused).tolist() == got


def test_keys_bring_near_copies_together(spark):
    """Shards of a few units: a near copy lies in its original's shard."""
    r = np.random.default_rng(9)
    idf, mean = np.ones(1 << 16), 200.0
    docs = [r.integers(0, 3000, 200).astype("<u2") for _ in range(600)]
    near = [np.where(r.random(200) < 0.03, r.integers(0, 3000, 200), d).astype("<u2") for d in docs]
    rows = np.zeros((600, packing.DIMS), np.float32)
    for row, d in zip(rows, docs, strict=True):
        at, values = packing.direction(d, idf)
        np.add.at(row, at, values)
    tree = packing.Tree(rows)
    keys = np.array([packing.lexical_key(d, k, idf, tree) for k, d in enumerate([*docs, *near])])
    place = np.empty(1200, np.int64)
    place[np.argsort(keys)] = np.arange(1200)
    together = (place[:600] // 100 == place[600:] // 100).mean()
    assert together > 0.85, together


def test_rows_that_repeat_wholly_are_dealt_over_shards(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    rows = [doc(None, sentence(1))] * 200 + [doc(k, sentence(k)) for k in range(100)]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    check(rows, got, tokenizer)
    assert len({p["sequence_id"] >> 32 for p in got if p["doc_id"] is None}) > 5


def test_neighbours_are_found_in_the_whole_corpus(spark, monkeypatch):
    """Far more shards than documents of a theme: windows hold one theme all the same."""
    monkeypatch.setattr(packing, "SHARD_ROWS", 20)
    r = np.random.default_rng(7)
    rows = [doc(k, " ".join(f"{'abcdefghijkl'[k % 12] * 3}{'nopqrstuvwxyz'[j]}{'aeiou'[i]}" for i, j in zip(r.integers(0, 5, 300), r.integers(0, 13, 300)))) for k in range(240)]
    windows = defaultdict(list)
    for p in packing.pack(spark.createDataFrame(rows, DOCS)).collect():
        windows[p["sequence_id"]].append(p)
    full = [w for w in windows.values() if sum(p["length"] for p in w) == 4096]
    tokens = sum(p["length"] for w in full for p in w)
    own = sum(max(sum(p["length"] for p in w if p["doc_id"] % 12 == theme) for theme in range(12)) for w in full)
    assert len(full) >= 40 and own > 0.7 * tokens, own / tokens


def test_seeds_go_on_with_weaker_terms():
    """The strongest terms stand nowhere else; those after them do."""
    own = np.arange(20)
    seed = np.concatenate([np.repeat(100 + own, 3), 500 + own])
    others = [np.concatenate([500 + own, np.repeat(1000 + 50 * k + own, 3)]) if k % 2 else np.repeat(1000 + 50 * k + own, 4) for k in range(8)]
    first = packing.pack_shard([x.astype("<u2") for x in [seed, *others]], 400)[0]
    assert [k % 2 for k, *_ in first[1:]] == [0] * 4


def test_shards_do_not_depend_on_partitions(spark, monkeypatch):
    # several shards, near copies beside each other, and rows that repeat
    monkeypatch.setattr(packing, "SHARD_ROWS", 40)
    rows = [doc(k, " ".join(sentence(k // 3 + j) for j in range(12)) + f" {k}") for k in range(600)] + [doc(7, "same text")] * 5
    docs = spark.createDataFrame(rows, DOCS)

    def pieces(d):
        return sorted(tuple(-1 if x is None else x for x in r) for r in packing.pack(d).collect())

    assert pieces(docs.repartition(3)) == pieces(docs.orderBy("text").repartition(7, "n_chars"))


def test_cuts_are_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    # many distinct keys, a hot key over a third of them, ranges of one key and of many
    keys = np.concatenate([rng.integers(0, 1 << 52, 3000), rng.integers(0, 1 << 20, 500), np.full(2000, 12345 << 30)])
    rng.shuffle(keys)
    for shards in (2, 7, 60):
        for n in (1, 4):
            units = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(n)
            got = packing.cut_keys(units, shards, len(keys))
            ordered = np.sort(keys)
            # border i lies in the key that holds the row of rank ceil(i * rows / shards)
            want = [ordered[-(-i * len(keys) // shards) - 1] for i in range(1, shards)]
            assert got.tolist() == want
    assert packing.cut_keys(units, 1, len(keys)).tolist() == []
