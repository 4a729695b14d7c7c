"""Requests and answers: one engine for library, command line and servers.

An engine knows its units (a name and a corpus each, with an index or without) and answers
``search``, ``files``, ``lookup``, ``status`` and ``reindex`` from parameter dictionaries.
Only limited answers are collected; the work in between stays in DataFrames.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .config import Config, as_bool, as_count, as_globs, as_patterns
from .functions.globs import secret
from .operators import coverage, files, lookup, maintenance, search
from .operators.index import Index, incremental_plan
from .operators.search import Search
from .sources.corpus import tree_corpus


class RequestError(ValueError):
    """A request that can't be answered; its text is meant for whoever asked."""


class UnknownMethod(RequestError):
    """A request for something that no engine does."""


@dataclass
class Unit:
    """A part of the corpus that is built and listed on its own."""

    name: str
    corpus: DataFrame
    index: Index | None = None
    #: lists the corpus anew; without it ``corpus`` is what there is
    relist: Callable[[], DataFrame] | None = None
    #: whether a path below the unit exists at all
    exists: Callable[[str], bool] = lambda sub: False
    ready: bool = True
    dirty: bool = False
    pending_unknown: bool = False
    pending: list[str] = field(default_factory=list)
    watched: bool = False
    indexed_at_ms: int = 0
    files: int = 0
    bytes: int = 0
    error: str = ""
    #: while a rebuild runs: the paths that it takes, and whether it takes everything
    building: tuple[list[str], bool] | None = None

    def listing(self) -> DataFrame:
        if self.relist is not None:
            self.corpus = self.relist()
        return self.corpus

    def overlay(self) -> list[str]:
        """Paths that the index doesn't hold as they are now."""
        return sorted({*self.pending, *(self.building[0] if self.building else [])})

    def unknown(self) -> bool:
        return self.pending_unknown or self.building is not None and self.building[1]


class Engine:
    def __init__(self, spark: SparkSession, cfg: Config, units: list[Unit], writer: bool = True):
        self.spark, self.cfg, self.writer = spark, cfg, writer
        self.units = {u.name: u for u in units}
        self.frecency = spark.createDataFrame([], "path string, last_used_ms long, uses long")

    # coverage

    def resolve(self, root: str) -> tuple[list[Unit], str]:
        """The units that hold a root and the path below them; no unit if none does."""
        root = root.rstrip("/")
        if root in self.cfg.split_roots:
            return [u for n, u in sorted(self.units.items()) if n == root or n.startswith(root + "/")], ""
        above = [n for n in self.units if root == n or root.startswith(n + "/")]
        if not above:
            return [], ""
        best = max(above, key=len)
        return [self.units[best]], root[len(best) + 1 :]

    def refused(self, root: str) -> bool:
        """Whether a root below a configured one lies in a secret place."""
        base = next((r for r in sorted(self.cfg.roots, key=len, reverse=True) if root == r or root.startswith(r + "/")), "")
        below = root[len(base) :].strip("/")
        return bool(below) and self.spark.range(1).select(secret(F.lit(below), config.SECRET_EXCLUDES)).first()[0]

    def _uncovered(self, root: str, found: list[Unit], sub: str) -> list[dict]:
        """What of a root no index covers, and why. A path below a unit is covered if documents
        lie there, or if it doesn't exist (nothing is all there is); else the rules refuse it."""
        if self.refused(root):
            return [{"path": root, "reason": "secret"}]
        if not found:
            return [{"path": root, "reason": "not_indexed"}]
        unit = found[0]
        if not sub or unit.index is None or not unit.exists(sub):
            return []
        now = unit.index.snapshot()
        # lines such as build/ refuse what lies below a path, and that is what is asked for
        reached = maintenance.reached(self.spark.createDataFrame([(f"{sub}/any",)], "rel string"), self.cfg)
        held = F.lit(now is not None and now.may_hold(sub))
        reason = reached.select(coverage.uncovered_reason(F.lit(False), F.lit(True), F.col("reached"), held)).first()[0]
        return [{"path": root, "reason": reason}] if reason else []

    def _fresh(self, found: list[Unit]) -> bool:
        now = int(time.time() * 1000)
        recent = lambda u: now - u.indexed_at_ms < coverage.window_ms(self.cfg.rescan_secs)
        alive = lambda u: self.writer or u.index is None or now - u.index.last_beat_ms() < coverage.window_ms(self.cfg.rescan_secs) + 60_000
        tracked = lambda u: u.watched or ((not self.writer or not self.cfg.watch) and recent(u) and alive(u))
        return bool(found) and all(u.ready and not u.unknown() and tracked(u) for u in found)

    def stale_paths(self, u: Unit, most: int) -> list[str]:
        """Paths of a unit, at most so many, that its index doesn't hold as they are listed now."""
        none = self.spark.createDataFrame([], "unit string, rel string")
        now = u.index.snapshot()
        listing = u.listing().select("unit", "rel", "size", "stamp_ns")
        rows = listing if now is None else incremental_plan(listing, now.docs(), none).where("action <> 'alive'")
        return [r["rel"] for r in rows.select("rel").limit(most).collect()]

    def rebuild(self, u: Unit, pending: list[str], whole: bool = False) -> None:
        """Brings a unit's index up to its listing."""
        now = int(time.time() * 1000)
        if whole or u.index.version() is None:
            u.index.write(u.listing())
        else:
            u.index.update(u.listing(), self.spark.createDataFrame([(u.name, r) for r in pending], "unit string, rel string"))
        total = u.index.docs().agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        u.files, u.bytes, u.indexed_at_ms, u.ready = total[0], total[1], now, True

    # answers

    def _options(self, p: dict) -> Search:
        pattern = p.get("pattern", p.get("q"))
        if not isinstance(pattern, str):
            raise RequestError("a search needs a pattern")
        return Search(pattern, p.get("mode") == "regex" or as_bool(p.get("regex"), False), as_bool(p.get("ignore_case"), as_bool(p.get("ci"), False)), tuple(as_globs(p.get("glob", p.get("globs")))), files_only=as_bool(p.get("files_only"), False), max_matches=as_count(p.get("max_matches"), 1000), max_files=as_count(p.get("max_files"), 20_000), max_result_bytes=self.cfg.max_result_bytes)

    def _corpus(self, u: Unit, s: Search) -> DataFrame:
        """What a search of one unit reads: index candidates and changed documents, or all."""
        if u.index is None:
            return u.listing()
        indexed = u.index.candidate_docs(s.parsed(), s.ci).select(*u.corpus.columns)
        changed = u.overlay()
        if not changed:
            return indexed
        pending = self.spark.createDataFrame([(u.name, r) for r in changed], "unit string, rel string")
        return search.overlay(indexed, pending, u.listing())

    def _unlisted(self, p: dict, root: str, uncovered: list[dict]) -> Unit | None:
        """A directory in no unit, as a unit for one scan, if the request lets it."""
        if not as_bool(p.get("scan_fallback"), True) or [x["reason"] for x in uncovered] != ["not_indexed"] or not os.path.isdir(root):
            return None
        return Unit(root, tree_corpus(self.spark, root, self.cfg))

    def _roots(self, p: dict) -> list[str]:
        if as_bool(p.get("all_roots"), False) or p.get("root") == "*":
            return sorted(set(self.cfg.roots or self.units))
        return [p["root"] if isinstance(p.get("root"), str) else next(iter(self.cfg.roots or self.units), "")]

    def search(self, p: dict) -> dict:
        began, s = time.time(), self._options(p)
        try:
            s.parsed()
        except ValueError as e:
            raise RequestError(str(e)) from e
        parts = []
        for root in self._roots(p):
            found, sub = self.resolve(root)
            uncovered = self._uncovered(root, found, sub)
            secret_root = bool(uncovered) and uncovered[0]["reason"] == "secret"
            own = Search(**{**s.__dict__, "sub": sub})
            rows, counted = None, 0
            scanned = self._unlisted(p, root, uncovered)
            found = [scanned] if scanned else found
            for u in [] if secret_root else found:
                docs = self._corpus(u, own)
                if as_bool(p.get("count_candidates"), False):
                    counted += search.scope(docs, own).count()
                if as_bool(p.get("candidates_only"), False):
                    part = search.scope(docs, own).select("unit", "rel")
                else:
                    part = search.file_matches(docs, own) if s.files_only else search.line_matches(docs, own)
                rows = part if rows is None else rows.unionByName(part)
            backend = "none" if rows is None else "index" if all(u.index for u in found) else "scan"
            parts.append({"root": root, "rows": rows, "backend": backend, "candidates": counted, "covered": not uncovered and backend == "index", "uncovered": uncovered, "fresh": rows is not None and (backend == "scan" or self._fresh(found))})
        files_only = s.files_only or as_bool(p.get("candidates_only"), False)
        frames = [x["rows"] for x in parts if x["rows"] is not None]
        matches, truncated = [], False
        if frames:
            keys = ["unit", "rel"] if files_only else ["unit", "rel", "line"]
            got = search.cut_rows(coverage.merge_rows(frames, keys), Search(**{**s.__dict__, "files_only": files_only})).collect()
            matches = [r for r in got if r["kept"]]
            truncated = len(matches) < len(got)
        rank = max((coverage.BACKENDS.index(x["backend"]) for x in parts), default=2)
        covered, fresh = all(x["covered"] for x in parts), all(x["fresh"] for x in parts)
        return {
            "backend": coverage.BACKENDS[rank],
            "covered": covered,
            "fresh": fresh,
            "truncated": truncated,
            "complete": covered and fresh and not truncated,
            "files": list(dict.fromkeys(r["path"] for r in matches)),
            "matches": [] if files_only else [{"path": r["path"], "line": r["line"], "text": r["text"]} for r in matches],
            "uncovered": [u for x in parts for u in x["uncovered"]],
            "candidates": sum(x["candidates"] for x in parts) if as_bool(p.get("count_candidates"), False) else None,
            "roots": [{k: x[k] for k in ("root", "backend", "covered", "fresh")} | {"files": len({r["path"] for r in matches if r["path"] == x["root"] or r["path"].startswith(x["root"].rstrip("/") + "/")})} for x in parts],
            "elapsed_ms": (time.time() - began) * 1000,
        }

    def files(self, p: dict) -> dict:
        began, root = time.time(), self._roots(p)[0]
        found, sub = self.resolve(root)
        uncovered = self._uncovered(root, found, sub)
        o = files.Files(tuple(as_globs(p.get("glob", p.get("globs")))), p.get("regex", p.get("name")), p.get("fuzzy") or None, sub=sub, max_files=as_count(p.get("max_files"), 5000) + 1, max_result_bytes=self.cfg.max_result_bytes)
        got: list = []
        if found and not (uncovered and uncovered[0]["reason"] == "secret"):
            docs = found[0].listing()
            for u in found[1:]:
                docs = docs.unionByName(u.listing())
            ranked = as_bool(p.get("frecency"), False)
            now = int(time.time() * 1000)
            try:
                got = files.files(docs, o, self.frecency if ranked else None, now).collect()
            except ValueError as e:
                raise RequestError(str(e)) from e
            if ranked and self.writer and o.fuzzy and got:
                used = self.spark.createDataFrame([(r["path"],) for r in got[: o.max_files - 1]], "path string")
                kept = files.remember(self.frecency, used, now).collect()
                self.frecency = self.spark.createDataFrame(kept, "path string, last_used_ms long, uses long")
        truncated = len(got) >= o.max_files
        covered, fresh = bool(found) and not uncovered, self._fresh(found)
        return {"backend": "index" if covered else "none", "covered": covered, "fresh": fresh, "files": [r["path"] for r in got[: o.max_files - 1]], "truncated": truncated, "complete": covered and fresh and not truncated, "uncovered": uncovered, "elapsed_ms": (time.time() - began) * 1000}

    def lookup(self, p: dict) -> dict:
        began, patterns = time.time(), as_patterns(p.get("patterns"))
        if not patterns:
            raise RequestError("a lookup needs patterns: a list, or a line each")
        if len(patterns) > config.MAX_LOOKUP_PATTERNS:
            raise RequestError(f"a lookup takes {config.MAX_LOOKUP_PATTERNS} patterns at most")
        most = as_count(p.get("max_files"), 100)
        plain = not (p.get("mode") == "regex" or as_bool(p.get("regex"), False) or as_bool(p.get("ignore_case"), as_bool(p.get("ci"), False)))
        table = self.spark.createDataFrame(list(enumerate(patterns)), "pattern_id long, pattern string")
        found_rows, units, uncovered = None, [], []
        for root in self._roots(p):
            found, sub = self.resolve(root)
            uncovered += self._uncovered(root, found, sub)
            units += found
            for u in found:
                scope = Search("", globs=tuple(as_globs(p.get("glob"))), sub=sub)
                now = None if u.index is None or u.overlay() else u.index.snapshot()
                if plain and now is not None:
                    part = lookup.hits_indexed(search.scope(now.docs(), scope), now.postings(), table)
                elif plain:
                    part = lookup.hits(search.scope(u.listing(), scope), table)
                else:
                    asked = [(i, self._options({**p, "pattern": pattern}).parsed().java) for i, pattern in enumerate(patterns)]
                    part = lookup.regex_hits(search.scope(u.listing() if now is None else now.docs(), scope), asked)
                found_rows = part if found_rows is None else found_rows.unionByName(part)
        rows = {} if found_rows is None else {r["pattern_id"]: r for r in lookup.answers(table, found_rows, most).collect()}
        covered, fresh = not uncovered and all(u.index for u in units), self._fresh(units)
        results = []
        for i, pattern in enumerate(patterns):
            r = rows.get(i)
            cut = bool(r and r["truncated"])
            results.append({"pattern": pattern, "found": bool(r and r["found"]), "files": list(r["files"]) if r else [], "covered": covered, "fresh": fresh, "truncated": cut, "complete": covered and fresh and not cut})
        return {"results": results, "roots": self._roots(p), "covered": covered, "fresh": fresh, "uncovered": uncovered, "elapsed_ms": (time.time() - began) * 1000}

    def status(self, p: dict | None = None) -> dict:
        units = [{"path": u.name, "ready": u.ready, "dirty": u.dirty, "watched": u.watched, "indexed_at_ms": u.indexed_at_ms, "files": u.files} for _, u in sorted(self.units.items())]
        return {"units_total": len(units), "units_ready": sum(u["ready"] for u in units), "units_dirty": sum(u["dirty"] for u in units), "files": sum(u["files"] for u in units), "bytes": sum(u.bytes for u in self.units.values()), "fresh": self._fresh(list(self.units.values())), "units": units}

    def reindex(self, p: dict) -> dict:
        if not self.writer:
            raise RequestError("only the process that writes the index can rebuild it")
        wanted = p.get("unit")
        for u in self.units.values():
            if u.index is None or wanted and u.name != wanted:
                continue
            taken, u.pending, u.pending_unknown = u.pending, [], False
            self.rebuild(u, taken, as_bool(p.get("force"), False))
            u.dirty = bool(u.pending) or u.pending_unknown
            u.index.beat(int(time.time() * 1000))
        return self.status()


METHODS = ("search", "files", "lookup", "status", "reindex")


def call(engine: Engine, method: str, params: dict[str, Any] | None, confined: bool = False) -> dict:
    """Dispatches a request. Confined callers stay inside the configured roots and within
    limits; others may ask for anything."""
    p = dict(params or {})
    if method not in METHODS:
        raise UnknownMethod(f"there is no method {method!r}")
    if confined:
        pattern = p.get("pattern", p.get("q"))
        for text in (pattern, p.get("regex")):
            if isinstance(text, str) and len(text.encode()) > config.MAX_PATTERN_BYTES:
                raise RequestError("pattern too long")
        if len(as_globs(p.get("glob", p.get("globs")))) > config.MAX_GLOBS:
            raise RequestError("too many globs")
        for name, most in (("max_files", config.MAX_RESULT_FILES), ("max_matches", config.MAX_RESULT_MATCHES)):
            if name in p:
                p[name] = min(as_count(p[name], most), most)
        root = p.get("root")
        if isinstance(root, str) and root != "*" and not any(root == r or root.startswith(r.rstrip("/") + "/") for r in (*engine.cfg.roots, *engine.units)) or isinstance(root, str) and ".." in root.split("/"):
            raise RequestError("root is outside the configured roots")
    result = getattr(engine, method)(p)
    return result if method in ("status", "reindex") else {"ok": True, "result": result}
