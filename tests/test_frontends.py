import json
import threading
import urllib.error
import urllib.request

import pytest

from lexspan import frontends
from lexspan.config import Config, as_bool, as_count, as_globs, as_patterns, normalize_root
from lexspan.engine import Engine, RequestError, Unit
from lexspan.streaming import freshness
from lexspan.streaming.watcher import Clock, Pace, Watcher


@pytest.fixture(scope="module")
def engine(spark):
    d = spark.createDataFrame([(1, "/r", "a.txt", "needle here", 11, 0), (2, "/r", "b.txt", "other", 5, 0)], "doc_id long, unit string, rel string, content string, size long, stamp_ns long")
    return Engine(spark, Config(roots=("/r",)), [Unit("/r", d, watched=True)])


def test_rpc(engine):
    ask = lambda **m: json.loads(frontends.rpc(engine, json.dumps({"jsonrpc": "2.0", **m})))
    assert ask(id=1, method="search", params={"pattern": "needle"})["result"]["result"]["files"] == ["/r/a.txt"]
    assert ask(id=2, method="nope")["error"]["code"] == -32601
    assert ask(id=3, method="search", params={})["error"]["code"] == -32602
    assert json.loads(frontends.rpc(engine, "{"))["error"]["code"] == -32700
    assert frontends.rpc(engine, json.dumps({"method": "status"})) is None


def test_mcp(engine):
    assert frontends.mcp(engine, {"method": "initialized"}) is None
    assert frontends.mcp(engine, {"id": 1, "method": "initialize", "params": {}})["result"]["protocolVersion"] == frontends.PROTOCOL
    assert [t["name"] for t in frontends.mcp(engine, {"id": 1, "method": "tools/list"})["result"]["tools"]] == ["search", "find_files", "index_status"]
    tool = lambda name, **a: frontends.mcp(engine, {"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})["result"]
    assert tool("search", pattern="n..dle", regex=True)["structuredContent"]["result"]["files"] == ["/r/a.txt"]
    assert tool("search", pattern="n..dle")["structuredContent"]["result"]["files"] == []
    assert len(tool("find_files")["structuredContent"]["result"]["files"]) == 2
    assert "units" not in tool("index_status")["structuredContent"]
    assert tool("nope")["isError"]
    assert frontends.mcp(engine, {"id": 1, "method": "nope"})["error"]["code"] == -32601


def test_http(engine):
    server = frontends.http_server(engine, "127.0.0.1:0", token="t0k")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, token="t0k", data=None, host=None):
        r = urllib.request.Request(base + path, data=data, headers={"X-Token": token} | ({"Host": host} if host else {}))
        try:
            with urllib.request.urlopen(r, timeout=60) as x:
                return x.status, json.load(x)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    try:
        assert get("/health", token="")[0] == 200
        assert get("/search?pattern=needle")[1]["result"]["files"] == ["/r/a.txt"]
        assert get("/files?glob=a*&glob=!b*")[1]["result"]["files"] == ["/r/a.txt"]
        assert get("/status")[1]["units_total"] == 1
        assert get("/search?pattern=x", token="bad")[0] == 401
        assert get("/search?pattern=x", host="evil.example")[0] == 403
        assert get("/search")[0] == 400 and get("/nope")[0] == 404
        assert get("/search?pattern=x&root=/etc")[0] == 400
        body = json.dumps({"jsonrpc": "2.0", "id": 7, "method": "search", "params": {"pattern": "other"}}).encode()
        assert get("/rpc", data=body)[1]["result"]["result"]["files"] == ["/r/b.txt"]
        assert get("/rpc", data=b"x" * (frontends.MAX_BODY + 1))[0] == 413
    finally:
        server.shutdown()


def test_hosts():
    assert all(frontends.host_allowed(h, "10.0.0.5:80") for h in ("localhost:1", "127.0.0.1", "[::1]:80", "10.0.0.5:80"))
    assert not any(frontends.host_allowed(h, "10.0.0.5:80") for h in ("evil.example", "10.0.0.6", ""))


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('roots = ["/a"]\nhidden = false\nmax_file_size = 5\n')
    c = Config.load(str(f), env={"LEXSPAN_MAX_FILE_SIZE": "7"}, gitignore=False)
    assert (c.roots, c.hidden, c.max_file_size, c.gitignore) == (("/a",), False, 7, False)
    assert normalize_root("/a/./b/../c") == "/a/c"
    assert [as_bool(x, False) for x in ("yes", "1", "no", 2, None)] == [True, True, False, True, False]
    assert [as_count(x, 9) for x in (3, "4", "x", -1, True, None)] == [3, 4, 9, 9, 9, 9]
    assert as_globs(" *.a, ,!b") == ["*.a", "!b"] and as_patterns("a,b\r\n\nc") == ["a,b", "c"]


def test_clock():
    c = Clock(Pace(quiet_ms=300, patience_ms=5000, share=5, rest_ms=60_000))
    assert c.due() is None
    c.change(1000)
    assert c.due() == 1300
    for t in range(1100, 9000, 100):
        c.change(t)  # never quiet: patience ends
    assert c.due() == 6000
    c.built(6000, 6100)
    assert c.due() is None and c.rest == 500
    c.change(6150)
    assert c.due() == 6600  # after the rest, though quiet since 6450
    c.built(6600, 6700)
    assert c.rest == 1000  # close on the last one: twice the rest
    for k in range(12):
        c.change(c.ended + 1)
        c.built(c.due(), c.due() + 100)
    assert c.rest == 60_000
    c.change(c.ended + 500_000)
    c.built(c.due(), c.due() + 100)
    assert c.rest == 500  # a pause ends the row
    c.change(c.ended + 1)
    c.built(c.due(), c.due() + 40, known=False)
    assert c.rest == 80  # everything listed: twice its time
    calm = Clock(Pace(share=0))
    calm.change(0)
    calm.built(500, 900)
    assert calm.rest == 0


def test_clock_after_failures():
    c = Clock(Pace(quiet_ms=0, patience_ms=0))
    c.change(0)
    pauses = []
    for _ in range(9):
        at = c.due()
        c.fail(at)
        pauses.append(c.due() - at)
    assert pauses == [1000, 2000, 4000, 8000, 16_000, 32_000, 60_000, 60_000, 60_000]
    c.built(c.due(), c.due())
    assert c.failed == []


class Fake:
    """An engine whose units are sets of paths."""

    def __init__(self):
        self.cfg = Config(rescan_secs=300)
        index = type("I", (), {"beat": lambda s, n: None, "vacuum": lambda s, now_ms: []})()
        self.units = {"u": Unit("u", None, index), "plain": Unit("plain", None)}
        self.stale, self.built, self.fails = [], [], 0

    def stale_paths(self, u, most):
        return self.stale[:most]

    def rebuild(self, u, pending):
        if self.fails:
            self.fails -= 1
            raise OSError("disk full")
        self.built.append(pending)
        self.stale = []


def test_watcher():
    e = Fake()
    w = Watcher(e, Pace(quiet_ms=300, relist_ms=300_000))
    u = e.units["u"]
    assert w.tick(0) == [] and u.watched and not u.dirty
    w.changed("u", ["a", "b"], 100)
    w.changed("u", ["a"], 200)
    w.changed("plain", ["x"], 200)  # no index to keep fresh
    assert w.tick(400) == [] and u.pending == ["a", "b"] and u.dirty
    assert w.tick(500) == ["u"] and e.built == [["a", "b"]] and u.pending == [] and not u.dirty
    # a failure keeps the changes and is tried again after a pause
    e.fails = 1
    w.changed("u", ["c"], 10_000)
    assert w.tick(20_000) == [] and u.pending == ["c"] and u.dirty and u.error == "disk full"
    assert w.tick(20_900) == [] and w.tick(21_000) == ["u"] and u.error == ""
    # too many paths, or an unknown one: everything is compared
    w.changed("u", [f"f{k}" for k in range(3000)], 30_000)
    assert u.pending_unknown and u.pending == []
    assert w.tick(60_000) == ["u"] and not u.pending_unknown
    # a listing finds what no event told, and the next one comes soon; quiet ones space out
    e.stale = ["lost"]
    assert w.relist(300_000) == 1 and u.pending == ["lost"] and w.next_relist() == 600_000
    w.tick(301_000)
    gaps = []
    for _ in range(6):
        at = w.next_relist()
        w.tick(at)
        gaps.append((w.next_relist() - at) // 300_000)
    assert gaps == [1, 2, 4, 8, 8, 8]


def test_changes_during_a_rebuild_belong_to_the_next_one():
    e = Fake()
    w = Watcher(e, Pace(quiet_ms=0, patience_ms=0))
    w.tick(0)
    real = e.rebuild

    def rebuild(u, pending):
        assert u.overlay() == ["a"]  # still seen as changed while the rebuild runs
        w.changed("u", ["late"], 15)
        assert u.overlay() == ["a", "late"]
        real(u, pending)

    e.rebuild = rebuild
    w.changed("u", ["a"], 10)
    assert w.tick(10) == ["u"]
    assert e.units["u"].pending == ["late"] and e.units["u"].dirty and w.clocks["u"].due() is not None


def test_servers_that_others_reach_need_a_token(engine):
    with pytest.raises(RequestError):
        frontends.http_server(engine, "0.0.0.0:0")
    with pytest.raises(RequestError):
        frontends.http_server(engine, ":0")
    frontends.http_server(engine, "0.0.0.0:0", token="t").server_close()
    frontends.http_server(engine, "localhost:0").server_close()


def test_streams(spark, tmp_path):
    rows = [(f"u{i % 2}", f"f{i % 7}") for i in range(40)] + [("u2", None)] + [("u3", f"g{i}") for i in range(9)]
    spark.createDataFrame(rows, "unit string, rel string").repartition(3).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("unit string, rel string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = freshness.drain(freshness.pending_state(events, 8), str(tmp_path / "out"), str(tmp_path / "cp"), "update")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r["trigger"]):
        last[r["unit"]] = (r["pending"], r["unknown"])
    assert last == {"u0": (7, False), "u1": (7, False), "u2": (0, True), "u3": (0, True)}
