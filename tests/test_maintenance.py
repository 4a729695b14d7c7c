from lexspan.config import Config
from lexspan.operators import maintenance as m
from lexspan.operators.index import Index


def test_segments_to_merge():
    assert m.merge_from([]) is None and m.merge_from([5]) is None
    assert m.merge_from([100, 40, 10]) is None
    assert m.merge_from([100, 40, 50]) == 1 and m.merge_from([100, 60, 50]) == 0
    assert m.merge_from([2**k for k in range(20, 11, -1)]) == 4


def test_relevance(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    events = t([("u", "", True), ("u", "a/.gitignore", False), ("u", "a/x", False), ("u", "new", False), ("u", "noise", False), ("u", "dir", True), ("s", "dir", True), ("u", "gone", True)], "unit string, rel string, is_dir boolean")
    keys = "unit string, rel string"
    got = m.relevant(events, t([("u", "a/x")], keys), t([("u", "new"), ("u", "dir/f"), ("s", "dir/f")], keys), t([("u", "gone")], keys), ("s",))
    assert {(r["unit"], r["rel"]): r["kind"] for r in got.collect()} == {("u", ""): "unknown", ("u", "a/.gitignore"): "unknown", ("u", "a/x"): "file", ("u", "new"): "file", ("u", "dir"): "unknown", ("u", "gone"): "unknown"}


def test_reach_and_entries(spark):
    paths = spark.createDataFrame([("u", x) for x in ("src/a", "node_modules/x/y", ".ssh/k", ".hidden/z", "top")], "unit string, rel string")
    assert {r["rel"]: r["reached"] for r in m.reached(paths, Config()).collect()} == {"src/a": True, "node_modules/x/y": False, ".ssh/k": False, ".hidden/z": True, "top": True}
    assert not {r["rel"]: r["reached"] for r in m.reached(paths, Config(hidden=False)).collect()}[".hidden/z"]
    assert {(r["name"], r["is_dir"]) for r in m.entries(paths, "u").collect()} == {("src", True), ("node_modules", True), (".ssh", True), (".hidden", True), ("top", False)}
    assert [r["name"] for r in m.entries(paths, "u", "node_modules").collect()] == ["x"]
    assert [r["rel"] for r in m.loose_files(paths).collect()] == ["top"]
    assert sorted(r["name"] for r in m.hidden_children(paths).collect()) == [".hidden", ".ssh"]


def test_compact_and_beat(spark, tmp_path):
    d = spark.createDataFrame([(i, f"u{i % 3}", f"f{i}", f"some text {i}", 9, 0) for i in range(20)], "doc_id long, unit string, rel string, content string, size long, stamp_ns long").repartition(5)
    ix = Index(spark, str(tmp_path))
    ix.write(d)
    rows = lambda: (sorted(map(tuple, ix.docs().select("doc_id", "content").collect())), sorted(map(tuple, ix.postings().select("doc_id", "tri", "mask").collect())))
    before = rows()
    ix.compact()
    assert rows() == before and len(ix.docs().inputFiles()) == 3 and len(ix.postings().inputFiles()) == 1
    assert ix.last_beat_ms() == 0
    ix.beat(123)
    ix.beat(456)
    assert ix.last_beat_ms() == 456
