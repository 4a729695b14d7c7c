import random

import pytest
from pyspark.sql import functions as F

from lexspan.config import SECRET_EXCLUDES, Config
from lexspan.engine import Engine, RequestError, Unit, call
from lexspan.functions.globs import ignored, overrides, secret
from lexspan.functions.fuzzy import score
from lexspan.operators import coverage, files, index, lookup, search
from lexspan.operators.index import Index
from lexspan.operators.search import Search
from lexspan.sources import corpus

#: (path, content, whether the corpus holds it)
TREE = [
    (".gitignore", b"ignored/\n*.log\n", True),
    ("src/a.rs", b"fn hello_world() {}\n// foo.bar here\n", True),
    ("src/b.txt", b"Hello World\nsecond line fooXbar\n", True),
    ("src/nested/deep/c.md", b"# Title\nhello_world in docs\n", True),
    ("ignored/x.rs", b"hello_world\n", False),
    ("debug.log", b"hello_world\n", False),
    ("node_modules/pkg/index.js", b"hello_world\n", False),
    (".hidden/h.md", b"hello_world hidden\n", True),
    (".env", b"HELLO_WORLD=secret\n", False),
    ("keys/id_rsa", b"hello_world private\n", False),
    ("config/secrets.json", b'{"hello_world": 1}\n', False),
    ("data.bin.dat", b"hello_world\x00\x01\x02", False),
    ("unicode.txt", "Grüße ΑΒΓ hello_world\n".encode(), True),
    ("big.txt", b"hello_world\n" + b"x" * 300_000, False),
]
CFG = Config(max_file_size=100_000)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    home = tmp_path_factory.mktemp("tree")
    for path, content, _ in TREE:
        f = home / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content)
    return str(home)


@pytest.fixture(scope="module")
def docs(spark, root):
    return corpus.tree_corpus(spark, root, CFG, unit="u").cache()


def rels(df):
    return sorted(r["rel"] for r in df.select("rel").collect())


def test_corpus_rules(docs, root):
    want = sorted(p for p, _, kept in TREE if kept)
    assert rels(docs) == want
    # the driver's walk leaves binaries in: only reading tells
    assert [p for p, *_ in corpus.list_tree(root, CFG)] == sorted([*want, "data.bin.dat"])


HELLO = [".hidden/h.md", "src/a.rs", "src/nested/deep/c.md", "unicode.txt"]


@pytest.mark.parametrize(
    "s, want",
    [
        (Search("hello_world"), HELLO),
        (Search("foo.bar"), ["src/a.rs"]),
        (Search("foo.bar", regex=True), ["src/a.rs", "src/b.txt"]),
        (Search("hello world", ci=True), ["src/b.txt"]),
        (Search("hello world"), []),
        (Search("αβγ", ci=True), ["unicode.txt"]),
        (Search("αβγ"), []),
        (Search("hello", ci=True, globs=("*.rs",)), ["src/a.rs"]),
        (Search("hello", ci=True, globs=("!*.rs",)), [".hidden/h.md", "src/b.txt", "src/nested/deep/c.md", "unicode.txt"]),
        (Search("hello_world", sub="src/nested"), ["src/nested/deep/c.md"]),
        (Search(r"^#\s+\w+$", regex=True), ["src/nested/deep/c.md"]),
    ],
)
def test_golden(docs, s, want):
    assert rels(search.file_matches(docs, s)) == want
    assert sorted({r["rel"] for r in search.line_matches(docs, s).collect()}) == want
    assert rels(search.file_matches(search.through_index(docs, index.postings(docs), s), s)) == want


def test_line_numbers(docs):
    (row,) = search.line_matches(docs, Search("second")).collect()
    assert (row["rel"], row["line"], row["text"]) == ("src/b.txt", 2, "second line fooXbar")


@pytest.mark.parametrize("text, pattern, want", [("foo\r\nbar\r\n", "foo$", [1]), ("alpha\nbeta fn main", "fn main", [2]), ("a\n", "^$", [2]), ("a\n\n", "^$", [2, 3]), ("fn\n main\nfn main\n", r"fn\s+main", [3]), ("x\r\r\n", "x\r$", [1])])
def test_lines(spark, text, pattern, want):
    d = spark.createDataFrame([(1, "u", "r", text, 1, 0)], corpus_schema())
    assert sorted(r["line"] for r in search.line_matches(d, Search(pattern, regex=True)).collect()) == want


def corpus_schema():
    return "doc_id long, unit string, rel string, content string, size long, stamp_ns long"


def test_long_lines_are_cut_at_bytes(spark):
    d = spark.createDataFrame([(1, "u", "r", "é" * 1500, 1, 0), (2, "u", "s", "a" + "é" * 1500, 1, 0)], corpus_schema())
    got = {r["rel"]: r["text"] for r in search.line_matches(d, Search("é")).collect()}
    assert got["r"] == "é" * 1000 and got["s"] == "a" + "é" * 999 + "�"


def test_path_order(spark):
    names = ["ab", "a-b", "a/b/c", "a.c", "a", "a/b"]
    d = spark.createDataFrame([(i, "u", n, "x", 1, 0) for i, n in enumerate(names)], corpus_schema())
    assert [r["rel"] for r in d.orderBy(*search.path_order()).collect()] == ["a", "a/b", "a/b/c", "a-b", "a.c", "ab"]


def test_cut_prefix(spark):
    d = spark.createDataFrame([(i, "u", f"f{i}", "hit\nhit\nhit", 1, 0) for i in range(5)], corpus_schema())
    every = [(f"u/f{i}", n) for i in range(5) for n in (1, 2, 3)]
    cost = 4 + 3 + 48
    for s, n in ((Search("hit", max_matches=7), 7), (Search("hit", max_files=2), 6), (Search("hit", max_result_bytes=cost * 4 + 1), 4), (Search("hit", max_matches=15), 15), (Search("hit", max_matches=0), 0)):
        a = search.search(d, s)
        assert [(r["path"], r["line"]) for r in a.rows.orderBy("path", "line").collect()] == every[:n]
        assert a.truncated == (n < 15)
    a = search.search(d, Search("hit", files_only=True, max_files=5))
    assert a.rows.count() == 5 and not a.truncated


def test_random_corpora_index_equals_scan(spark):
    r = random.Random(8)
    words = ["foo", "Bar", "fn", "main", "x1", "hello_world", "ÉTÉ", "straße", "a.b", "[x]", "\t", "ab", "tion", "K", "k"]
    rows = [(i, f"u{i % 3}", f"d{i % 7}/f{i}", "".join(r.choice(words) + r.choice([" ", "\n", "\r\n", ""]) for _ in range(r.randrange(40))), 1, 0) for i in range(120)]
    d = spark.createDataFrame(rows, corpus_schema()).cache()
    p = index.postings(d).cache()
    for pattern, regex in (("foo", False), ("hello_world", False), ("main.*tion", True), ("(foo|bar)x1", True), ("étéfn", False), ("straße|hello", True), ("k ?hel", True), ("[xy]1fn", True)):
        for ci in (False, True):
            s = Search(pattern, regex, ci)
            scan = sorted(map(tuple, search.line_matches(d, s).collect()))
            assert sorted(map(tuple, search.line_matches(search.through_index(d, p, s), s).collect())) == scan


def test_globs(spark):
    paths = ["a.rs", "src/a.rs", "src/x/b.rs", "src/a.txt", "target/c.rs", "x/target/d.rs", "[z].md"]
    d = spark.createDataFrame([(p,) for p in paths], "rel string")
    kept = lambda c: sorted(r["rel"] for r in d.where(c).collect())
    rel = F.col("rel")
    assert kept(overrides(rel, ["*.rs", "!src/**"])) == ["a.rs", "target/c.rs", "x/target/d.rs"]
    assert kept(overrides(rel, ["/src/*.rs"])) == ["src/a.rs"]
    assert kept(overrides(rel, ["src/**/*.rs"])) == ["src/a.rs", "src/x/b.rs"]
    assert kept(overrides(rel, ["*.{txt,md}"])) == ["[z].md", "src/a.txt"]
    assert kept(~ignored(rel, ["target/", "*.md"])) == ["a.rs", "src/a.rs", "src/a.txt", "src/x/b.rs"]
    # a file under a directory that is out doesn't come back; one that is out itself does
    assert kept(~ignored(rel, ["target/", "!target/c.rs", "*.txt", "!a.txt"])) == ["[z].md", "a.rs", "src/a.rs", "src/a.txt", "src/x/b.rs"]
    assert kept(~ignored(rel, ["/*", "!/a.rs"])) == ["a.rs"]
    with pytest.raises(ValueError):
        overrides(rel, ["[a"])
    names = spark.createDataFrame([(p,) for p in ("a/.SSH/x", "b/.env.local", "my.env", "envx", "x/Credentials/y", "id_rsa.pub", "src/key.rs")], "rel string")
    assert [r[0] for r in names.select(secret(F.col("rel"), SECRET_EXCLUDES)).collect()] == [True, True, True, False, True, True, False]


def test_secrets_cannot_be_negated(spark):
    d = spark.createDataFrame([(".env", 1), ("a.txt", 1)], "rel string, size long")
    assert [r["rel"] for r in d.where(corpus.member(Config(excludes=("!.env",)))).collect()] == ["a.txt"]


def test_files_and_fuzzy(spark, docs):
    paths = lambda o: [r["path"] for r in files.files(docs, o).collect()]
    assert paths(files.Files(globs=("*.md",))) == ["u/.hidden/h.md", "u/src/nested/deep/c.md"]
    assert paths(files.Files(regex="^uni")) == ["u/unicode.txt"]
    assert paths(files.Files(fuzzy="uni")) == ["u/unicode.txt"]
    assert paths(files.Files(max_files=2)) == ["u/.gitignore", "u/.hidden/h.md"]
    assert score("src/main.rs", "mrs") > score("src/more/tiers.rs.bak", "mrs") > 0
    assert score("src/main.rs", "xyz") is None and score("Ünicode", "unic") and score("unicode", "ünic") is None
    assert score("src/main.rs", "!main") is None and score("src/main.rs", "^src rs$") and score("src/main.rs", "'main")
    used = spark.createDataFrame([("u/src/b.txt", 0, 5)], "path string, last_used_ms long, uses long")
    ranked = files.ranked(files.matching(docs, files.Files(fuzzy="txt")), used, 30 * files.DAY_MS).collect()
    assert {r["path"]: r["frecency"] for r in ranked} == {"u/src/b.txt": 2.5, "u/unicode.txt": 0.0}


def test_lookup(spark, docs):
    p = spark.createDataFrame([(0, "hello_world"), (1, "fooXbar"), (2, "missing"), (3, "here\n//"), (4, ""), (5, None), (6, "fn")], "pattern_id long, pattern string")
    for found in (lookup.hits(docs, p), lookup.hits_indexed(docs, index.postings(docs), p)):
        got = {r["pattern_id"]: r for r in lookup.answers(p, found, 3).collect()}
        assert got[0]["files"] == ["u/.hidden/h.md", "u/src/a.rs", "u/src/nested/deep/c.md"] and got[0]["truncated"]
        assert got[1]["files"] == ["u/src/b.txt"] and not got[1]["truncated"] and got[6]["files"] == ["u/src/a.rs"]
        assert not any(got[i]["found"] for i in (2, 3, 4, 5))


def test_index_versions(spark, tmp_path):
    rows = [(i, f"u{i % 2}", f"f{i}", f"token{i} common", 10, 100) for i in range(30)]
    d = spark.createDataFrame(rows, corpus_schema())
    ix = Index(spark, str(tmp_path / "ix"))
    assert ix.version() is None
    first = ix.write(d)
    assert ix.docs().count() == 30
    # one changed, one pending with the same stamp, one gone, one new
    new = [(i, u, r, c + " changed" if i in (3, 4) else c, s, 200 if i == 3 else t) for i, u, r, c, s, t in rows if i != 5] + [(99, "u1", "f99", "token99", 10, 100)]
    listing = spark.createDataFrame(new, corpus_schema())
    pending = spark.createDataFrame([("u0", "f4")], "unit string, rel string")
    plan = {(r["rel"]): r["action"] for r in index.incremental_plan(listing, ix.docs(), pending).collect()}
    assert {k: v for k, v in plan.items() if v != "alive"} == {"f3": "reindex", "f4": "reindex", "f5": "drop", "f99": "reindex"}
    second = ix.update(listing, pending)
    assert second != first and ix.version() == second
    fresh = Index(spark, str(tmp_path / "other"))
    fresh.write(listing)
    same = lambda f: sorted(map(tuple, f.select("doc_id", "tri", "mask").collect()))
    assert same(ix.postings()) == same(fresh.postings())
    assert sorted(r["rel"] for r in ix.docs().collect()) == sorted(r[2] for r in new)
    # the update wrote the changed documents alone, in a segment of its own
    base, change = ix.snapshot().segments
    assert sorted(r["rel"] for r in ix.snapshot()._read(change, "docs").collect()) == ["f3", "f4", "f99"]
    assert ix.update(listing, pending.limit(0)) == second  # nothing changed since
    assert [r["rel"] for r in search.file_matches(ix.candidate_docs(Search("token5").parsed()), Search("token5")).collect()] == []
    assert [r["rel"] for r in search.file_matches(ix.candidate_docs(Search("token3 common changed").parsed()), Search("token3 common changed")).collect()] == ["f3"]
    third = ix.compact()
    assert third > second and len(ix.snapshot().segments) == 1 and same(ix.postings()) == same(fresh.postings())
    # the last two versions stay whole; what is young may still be written
    assert ix.vacuum() == [] and sorted(ix.vacuum(keep_ms=-1000)) == [f"{first}.json"] and ix.docs().count() == 30
    fourth = ix.write(listing)
    assert fourth > third and set(ix.vacuum(keep_ms=-1000)) == {f"{second}.json", base.name, change.name}


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(i, "u", f"f{i}", f"token{i}", 10, 100) for i in range(5)], corpus_schema())
    ix = Index(spark, str(tmp_path / "ix"))
    first = ix.write(d)

    def dies(*a):
        raise OSError("lost")

    with monkeypatch.context() as mp:
        mp.setattr(Index, "_publish", dies)
        with pytest.raises(OSError):
            ix.update(d.limit(2), d.limit(0).select("unit", "rel"))
    assert ix.version() == first and ix.docs().count() == 5
    # two writers start from the same version: the second one fails, the first one's stays
    seen = ix.snapshot()
    second = ix.update(d.where("doc_id < 3"), d.limit(0).select("unit", "rel"))
    with pytest.raises(RuntimeError):
        ix._publish(seen.segments, seen.number)
    assert ix.version() == second and ix.docs().count() == 3 and seen.docs().count() == 5


def test_files_written_while_they_are_indexed_are_read_again(spark, tmp_path):
    import time

    now = time.time_ns()
    d = spark.createDataFrame([(1, "u", "old", "a b c", 5, now - 10**10), (2, "u", "young", "a b c", 5, now)], corpus_schema())
    ix = Index(spark, str(tmp_path / "ix"))
    ix.write(d)
    plan = {r["rel"]: r["action"] for r in index.incremental_plan(d, ix.docs(), d.limit(0)).collect()}
    assert plan == {"old": "alive", "young": "reindex"}


def test_candidates_name_the_chunks_that_are_read(spark, tmp_path):
    d = spark.createDataFrame([(i, "u", f"f{i}", f"common token{i} end", 100, 0) for i in range(200)], corpus_schema())
    ix = Index(spark, str(tmp_path / "ix"))
    ix.write(d, chunk_bytes=500)
    s = Search("token77 end")
    found = ix.candidate_docs(s.parsed())
    assert "dynamicpruning" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).lower()
    assert [r["rel"] for r in search.line_matches(found, s).collect()] == ["f77"]
    assert sorted(r["rel"] for r in search.file_matches(ix.candidate_docs(Search("t.*n", True).parsed()), Search("t.*n", True)).collect()) == sorted(f"f{i}" for i in range(200))


def test_coverage(spark):
    units = spark.createDataFrame([("/a",), ("/a/b",), ("/s",), ("/s/x",)], "unit string")
    paths = spark.createDataFrame([("/a/f",), ("/a/b/c/f",), ("/z",), ("/s/f",), ("/s/y/f",), ("/s/x/f",)], "path string")
    got = {r["path"]: r["unit"] for r in coverage.unit_of(paths, units, ("/s",)).collect()}
    assert got == {"/a/f": "/a", "/a/b/c/f": "/a/b", "/z": None, "/s/f": "/s", "/s/y/f": None, "/s/x/f": "/s/x"}
    assert coverage.status(spark.createDataFrame([], "ready boolean, dirty boolean, files long, bytes long")).first().asDict() == {"units_total": 0, "units_ready": 0, "units_dirty": 0, "files": 0, "bytes": 0, "fresh": False}


@pytest.fixture
def engine(spark, root, tmp_path):
    cfg = Config(roots=(root,), max_file_size=100_000, watch=False)
    e = Engine(spark, cfg, [Unit(root, corpus.tree_corpus(spark, root, cfg), Index(spark, str(tmp_path / "ix")), ready=False)])
    call(e, "reindex", {})
    return e


def test_engine(engine, root):
    r = call(engine, "search", {"pattern": "hello_world"})["result"]
    assert r["files"] == [f"{root}/{p}" for p in (".hidden/h.md", "src/a.rs", "src/nested/deep/c.md", "unicode.txt")]
    assert r["backend"] == "index" and r["covered"] and r["fresh"] and r["complete"] and len(r["matches"]) == 4
    assert call(engine, "search", {"pattern": "hello_world", "max_matches": 2})["result"]["truncated"]
    sub = call(engine, "search", {"q": "HELLO_W", "ci": "1", "root": f"{root}/src/nested", "files_only": True})["result"]
    assert sub["files"] == [f"{root}/src/nested/deep/c.md"] and sub["matches"] == []
    out = call(engine, "search", {"pattern": "x", "root": "/elsewhere"})["result"]
    assert not out["covered"] and out["uncovered"] == [{"path": "/elsewhere", "reason": "not_indexed"}] and out["backend"] == "none"
    assert call(engine, "search", {"pattern": "x", "root": f"{root}/.ssh"})["result"]["uncovered"][0]["reason"] == "secret"
    assert call(engine, "files", {"regex": "^uni"})["result"]["files"] == [f"{root}/unicode.txt"]
    k = call(engine, "lookup", {"patterns": "fooXbar\nnothing here"})["result"]["results"]
    assert [x["found"] for x in k] == [True, False] and k[0]["complete"]
    assert call(engine, "lookup", {"patterns": ["FOOXBAR"], "ci": True})["result"]["results"][0]["found"]
    s = call(engine, "status", {})
    assert s["units_total"] == 1 and s["files"] == 6 and s["fresh"]
    for method, p in (("search", {}), ("search", {"pattern": "(", "regex": True}), ("lookup", {}), ("nope", {})):
        with pytest.raises(RequestError):
            call(engine, method, p)
    with pytest.raises(RequestError):
        call(engine, "search", {"pattern": "x", "root": "/etc"}, confined=True)
    with pytest.raises(RequestError):
        call(engine, "search", {"pattern": "x" * 20_000}, confined=True)


def test_pending_files_are_seen_before_the_index_is_rebuilt(spark, engine, root):
    (unit,) = engine.units.values()
    with open(f"{root}/src/new.txt", "w") as f:
        f.write("brand_new_token\n")
    try:
        unit.corpus = corpus.tree_corpus(spark, root, engine.cfg)
        assert call(engine, "search", {"pattern": "brand_new_token"})["result"]["files"] == []
        unit.pending, unit.dirty = ["src/new.txt"], True
        r = call(engine, "search", {"pattern": "brand_new_token"})["result"]
        assert r["files"] == [f"{root}/src/new.txt"] and r["complete"]
        unit.pending_unknown = True
        assert not call(engine, "search", {"pattern": "brand_new_token"})["result"]["fresh"]
        call(engine, "reindex", {})
        assert call(engine, "search", {"pattern": "brand_new_token"})["result"]["complete"]
    finally:
        __import__("os").remove(f"{root}/src/new.txt")


def test_files_made_later_are_found(spark, root, tmp_path):
    """An engine whose units list themselves: scans see new files at once, a watcher's listing
    brings them into the index."""
    import os

    from lexspan.streaming.watcher import Pace, Watcher

    cfg = Config(roots=(root,), max_file_size=100_000, watch=False)
    relist = lambda: corpus.tree_corpus(spark, root, cfg)
    exists = lambda sub: os.path.lexists(os.path.join(root, sub))
    scans = Engine(spark, cfg, [Unit(root, relist(), relist=relist)])
    e = Engine(spark, cfg, [Unit(root, relist(), Index(spark, str(tmp_path / "ix")), relist, exists, ready=False)])
    call(e, "reindex", {})
    watcher = Watcher(e, Pace(quiet_ms=0, patience_ms=0))
    ask = lambda engine, **p: call(engine, "search", {"pattern": "made_later", **p})["result"]
    path = f"{root}/src/later.txt"
    with open(path, "w") as f:
        f.write("made_later\n")
    try:
        assert ask(scans)["files"] == [path] and ask(scans)["fresh"] and ask(e)["files"] == []
        assert watcher.tick(1) == [root]
        got = ask(e, count_candidates=True)
        assert got["files"] == [path] and got["backend"] == "index" and got["candidates"] == 1 and got["roots"][0]["files"] == 1
        for p in ({"patterns": ["made_later", "none of it"]}, {"patterns": ["made_l.t", "zzz"], "mode": "regex"}):
            assert [x["found"] for x in call(e, "lookup", p)["result"]["results"]] == [True, False]
    finally:
        os.remove(path)
    assert ask(scans)["files"] == []
    assert watcher.relist(2) >= 1 and watcher.tick(10**9) == [root] and ask(e)["files"] == []
    # below a unit: refused by the rules, missing, and a directory that no unit holds
    assert ask(e, root=f"{root}/node_modules")["uncovered"] == [{"path": f"{root}/node_modules", "reason": "excluded"}]
    assert ask(e, root=f"{root}/nowhere")["covered"]
    other = tmp_path / "other"
    other.mkdir()
    (other / "f.txt").write_text("made_later\n")
    got = ask(e, root=str(other))
    assert got["files"] == [str(other / "f.txt")] and got["backend"] == "scan" and got["fresh"] and not got["covered"]
    assert ask(e, root=str(other), scan_fallback=False)["backend"] == "none"
