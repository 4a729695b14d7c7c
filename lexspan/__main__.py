"""Command line: index, search, files, lookup, status, excludes, watch, serve, rpc, mcp.

    python -m lexspan --root DIR search 'fn \\w+' --text
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config, normalize_root
from .engine import Engine, RequestError, Unit, call
from .frontends import http_server, serve_lines
from .operators.index import Index
from .sources.corpus import tree_corpus
from .streaming.freshness import MOST_PENDING, follow
from .streaming.watcher import Watcher


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexspan")
    p.add_argument("--root", action="append", help="a directory to search; may be repeated")
    p.add_argument("--config", help="a TOML file")
    p.add_argument("--index", help="a folder for indexes; without one every search scans")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("pattern")
    s.add_argument("path", nargs="?")
    s.add_argument("-F", "--literal", action="store_true")
    s.add_argument("-i", "--ignore-case", dest="ci", action="store_true")
    s.add_argument("-s", "--case-sensitive", dest="ci", action="store_false")
    s.add_argument("-g", "--glob", action="append", default=[])
    s.add_argument("-l", "--files-with-matches", dest="files_only", action="store_true")
    s.add_argument("-m", "--max-matches", type=int, default=1000)
    s.add_argument("--max-files", type=int, default=20_000)
    s.add_argument("--candidates", action="store_true")
    s.add_argument("--all-roots", action="store_true")
    s.add_argument("--text", action="store_true", help="lines as path:line:text")
    f = sub.add_parser("files")
    f.add_argument("path", nargs="?")
    f.add_argument("-g", "--glob", action="append", default=[])
    f.add_argument("--regex")
    f.add_argument("--fuzzy")
    f.add_argument("--frecency", action="store_true")
    f.add_argument("--max-files", type=int, default=5000)
    f.add_argument("--text", action="store_true")
    k = sub.add_parser("lookup")
    k.add_argument("patterns", nargs="+")
    for name in ("index", "status", "excludes", "rpc", "mcp"):
        sub.add_parser(name)
    w = sub.add_parser("watch")
    w.add_argument("--events", help="a folder of JSON files with unit and rel of each change")
    w.add_argument("--seconds", type=float, help="end after so long")
    serve = sub.add_parser("serve")
    serve.add_argument("--listen", default="127.0.0.1:7700")
    serve.add_argument("--token", default=os.environ.get("LEXSPAN_AUTH_TOKEN"))
    return p


def open_engine(spark: SparkSession, cfg: Config, index: str | None) -> Engine:
    units = []
    for root in cfg.roots:
        home = Index(spark, f"{index.rstrip('/')}/{root.strip('/').replace('/', '_')}") if index else None
        relist = lambda root=root: tree_corpus(spark, root, cfg)
        u = Unit(root, relist(), home, relist, lambda sub, root=root: os.path.lexists(os.path.join(root, sub)), ready=home is None or home.version() is not None)
        units.append(u)
    return Engine(spark, cfg, units)


def keep_fresh(engine: Engine, events: str | None = None, seconds: float | None = None) -> None:
    """Rebuilds what changes, until the time is over."""
    now = lambda: int(time.time() * 1000)
    watcher, began, query = Watcher(engine), time.time(), None
    if events:
        stream = engine.spark.readStream.schema("unit string, rel string").json(events)

        def changed(batch: DataFrame, _: int) -> None:
            # a unit with very many changes counts as unknown; no more of its paths are needed
            most = F.row_number().over(Window.partitionBy("unit").orderBy("rel")) <= MOST_PENDING + 1
            rows = batch.withColumn("_few", most).where("_few").collect()
            for unit in {r["unit"] for r in rows}:
                watcher.changed(unit, [r["rel"] for r in rows if r["unit"] == unit], now())

        query = follow(stream, changed, f"{events.rstrip('/')}/_checkpoint")
    try:
        while seconds is None or time.time() - began < seconds:
            watcher.tick(now(), now)
            time.sleep(0.2)
    finally:
        if query is not None:
            query.stop()


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    roots = tuple(normalize_root(r) for r in a.root) if a.root else None
    cfg = Config.load(None if a.root else a.config, roots=roots)
    if a.command == "excludes":
        print("\n".join(cfg.effective_excludes()))
        return 0
    if not cfg.roots:
        cfg = Config.load(a.config, roots=(normalize_root("."),))
    spark = SparkSession.builder.appName("lexspan").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = open_engine(spark, cfg, a.index)
    if a.index and any(not u.ready for u in engine.units.values()):
        call(engine, "reindex", {})
    path = {"root": normalize_root(a.path)} if getattr(a, "path", None) else {}
    try:
        if a.command == "search":
            p = {**path, "pattern": a.pattern, "mode": "literal" if a.literal else "regex", "ci": a.ci, "glob": a.glob, "files_only": a.files_only, "candidates_only": a.candidates, "max_matches": a.max_matches, "max_files": a.max_files, "all_roots": a.all_roots}
            got = call(engine, "search", p)
            if not a.text:
                print(json.dumps(got))
                return 0
            r = got["result"]
            rows = r["files"] if a.files_only or a.candidates else [f"{m['path']}:{m['line']}:{m['text']}" for m in r["matches"]]
            print("\n".join(rows), end="\n" if rows else "")
            return 0 if r["files"] else 1
        if a.command == "files":
            got = call(engine, "files", {**path, "glob": a.glob, "regex": a.regex, "fuzzy": a.fuzzy, "frecency": a.frecency, "max_files": a.max_files})
            print("\n".join(got["result"]["files"]) if a.text else json.dumps(got))
        elif a.command == "lookup":
            print(json.dumps(call(engine, "lookup", {"patterns": a.patterns, "all_roots": True})))
        elif a.command in ("index", "status"):
            print(json.dumps(call(engine, "reindex" if a.command == "index" else "status", {})))
        elif a.command == "watch":
            if not a.index:
                raise RequestError("watch needs --index")
            keep_fresh(engine, a.events, a.seconds)
        elif a.command == "serve":
            if a.index and cfg.watch:
                threading.Thread(target=keep_fresh, args=(engine,), daemon=True).start()
            http_server(engine, a.listen, a.token).serve_forever()
        else:
            serve_lines(engine, sys.stdin, sys.stdout, a.command)
    except RequestError as e:
        print(json.dumps({"ok": False, "error": str(e)}))
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
