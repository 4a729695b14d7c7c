"""Front ends over one engine: JSON-RPC lines, MCP, HTTP."""

from __future__ import annotations

import datetime
import hmac
import ipaddress
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import BoundedSemaphore
from typing import Any, TextIO
from urllib.parse import parse_qsl, urlsplit

from .engine import Engine, RequestError, UnknownMethod, call

PROTOCOL = "2025-06-18"
MAX_BODY, MAX_URL = 1 << 20, 64 * 1024


def _reply(ident: Any, **body: Any) -> dict:
    return {"jsonrpc": "2.0", "id": ident, **body}


def rpc(engine: Engine, line: str, confined: bool = False) -> str | None:
    """Answers one JSON-RPC line; notifications get no answer."""
    try:
        message = json.loads(line)
    except ValueError as e:
        return json.dumps(_reply(None, error={"code": -32700, "message": f"parse error: {e}"}))
    message = message if isinstance(message, dict) else {}
    ident, method = message.get("id"), message.get("method", "")
    try:
        body = {"result": call(engine, method, message.get("params"), confined)}
    except RequestError as e:
        body = {"error": {"code": -32601 if isinstance(e, UnknownMethod) else -32602, "message": str(e)}}
    return json.dumps(_reply(ident, **body)) if "id" in message else None


def _property(kind: str, about: str = "") -> dict:
    return {"type": kind, **({"items": {"type": "string"}} if kind == "array" else {}), **({"description": about} if about else {})}


TOOLS = [
    {
        "name": "search",
        "description": "Find text, or a regular expression, in the files below a directory. The answer says whether it covers the directory and is fresh.",
        "inputSchema": {"type": "object", "properties": {"pattern": _property("string"), "path": _property("string", "Directory; the first configured root if absent."), "regex": _property("boolean"), "ignore_case": _property("boolean"), "glob": _property("array", "Such as *.py or !tests/**"), "files_only": _property("boolean"), "all_roots": _property("boolean"), "max_matches": _property("integer", "200 if absent.")}, "required": ["pattern"]},
        "annotations": {"readOnlyHint": True},
    },
    {
        "name": "find_files",
        "description": "List files below a directory by glob, by regular expression over path or name, or by fuzzy query.",
        "inputSchema": {"type": "object", "properties": {"path": _property("string"), "glob": _property("array"), "regex": _property("string"), "fuzzy": _property("string"), "frecency": _property("boolean"), "max_files": _property("integer", "500 if absent.")}},
        "annotations": {"readOnlyHint": True},
    },
    {"name": "index_status", "description": "What is indexed, and how fresh it is.", "inputSchema": {"type": "object", "properties": {}}, "annotations": {"readOnlyHint": True}},
]


def _tool(engine: Engine, name: str, arguments: Any) -> dict:
    p = dict(arguments) if isinstance(arguments, dict) else {}
    if "path" in p:
        p["root"] = p.pop("path")
    if name == "search":
        return call(engine, "search", {"max_matches": 200, **p, "mode": "regex" if p.get("regex") is True else "literal"})
    if name == "find_files":
        return call(engine, "files", {"max_files": 500, **p})
    if name == "index_status":
        return {k: v for k, v in call(engine, "status", {}).items() if k != "units"}
    raise RequestError(f"unknown tool '{name}'")


def mcp(engine: Engine, message: dict) -> dict | None:
    """Answers one Model Context Protocol message; notifications get no answer."""
    if "id" not in message:
        return None
    ident, method, p = message["id"], message.get("method", ""), message.get("params") or {}
    if method == "initialize":
        return _reply(ident, result={"protocolVersion": p.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "lexspan", "version": "1"}})
    if method == "ping":
        return _reply(ident, result={})
    if method == "tools/list":
        return _reply(ident, result={"tools": TOOLS})
    if method != "tools/call":
        return _reply(ident, error={"code": -32601, "message": f"method not found: {method}"})
    try:
        found = _tool(engine, p.get("name", ""), p.get("arguments"))
    except RequestError as e:
        return _reply(ident, result={"content": [{"type": "text", "text": str(e)}], "isError": True})
    return _reply(ident, result={"content": [{"type": "text", "text": json.dumps(found)}], "structuredContent": found, "isError": False})


def serve_lines(engine: Engine, source: TextIO, sink: TextIO, protocol: str = "rpc") -> None:
    for line in source:
        if not line.strip():
            continue
        if protocol == "rpc":
            answer = rpc(engine, line)
        else:
            try:
                message = json.loads(line)
            except ValueError as e:
                message = None
                answer = json.dumps(_reply(None, error={"code": -32700, "message": f"parse error: {e}"}))
            if message is not None:
                found = mcp(engine, message)
                answer = None if found is None else json.dumps(found)
        if answer is not None:
            sink.write(answer + "\n")
            sink.flush()


def _loopback(name: str) -> bool:
    try:
        return ipaddress.ip_address(name).is_loopback
    except ValueError:
        return False


def host_allowed(host: str, listen: str) -> bool:
    """Loopback names and the host listened on; anything else may be a rebound name."""
    name = host.strip()
    name = name[1:].split("]")[0] if name.startswith("[") else name.rsplit(":", 1)[0] if ":" in name else name
    own = listen.rsplit(":", 1)[0].strip("[]")
    if name.lower() == "localhost" or name == own:
        return True
    return _loopback(name)


def http_server(engine: Engine, listen: str = "127.0.0.1:0", token: str | None = None, slots: int = 4) -> ThreadingHTTPServer:
    """A server that isn't running yet; ``serve_forever()`` runs it. Addresses that other machines
    reach need a token."""
    address = listen.rpartition(":")[0].strip("[]")
    if not token and not (address == "localhost" or _loopback(address)):
        raise RequestError(f"listening on {address or 'every address'} needs a token")
    limit = BoundedSemaphore(slots)

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: Any) -> None:
            pass

        def answer(self, code: int, body: Any) -> None:
            data = body.encode() if isinstance(body, str) else json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.send_header("Connection", "close")
            self.end_headers()
            self.wfile.write(data)

        def admitted(self) -> bool:
            if not host_allowed(self.headers.get("Host", ""), listen):
                self.answer(403, {"ok": False, "error": "host not allowed"})
                return False
            given = self.headers.get("X-Token") or (self.headers.get("Authorization") or "").removeprefix("Bearer ")
            if token and urlsplit(self.path).path != "/health" and not hmac.compare_digest(given.encode(), token.encode()):
                self.answer(401, {"ok": False, "error": "token missing or wrong"})
                return False
            if len(self.path) > MAX_URL:
                self.answer(414, {"ok": False, "error": "URL too long"})
                return False
            return True

        def run(self, method: str, params: dict) -> None:
            try:
                with limit:
                    self.answer(200, call(engine, method, params, confined=True))
            except RequestError as e:
                self.answer(400, {"ok": False, "error": str(e)})

        def do_GET(self) -> None:
            if not self.admitted():
                return
            parts = urlsplit(self.path)
            params: dict[str, Any] = {}
            for k, v in parse_qsl(parts.query, keep_blank_values=True):
                params[k] = f"{params[k]},{v}" if k == "glob" and k in params else v
            name = parts.path.strip("/")
            if name == "health":
                now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds").replace("+00:00", "Z")
                self.answer(200, {"ok": True, "time": now})
            elif name in ("search", "files", "lookup", "status"):
                self.run(name, params)
            else:
                self.answer(404, {"ok": False, "error": "not found"})

        def do_POST(self) -> None:
            if not self.admitted():
                return
            size = int(self.headers.get("Content-Length") or 0)
            if size > MAX_BODY:
                self.answer(413, {"ok": False, "error": "body too large"})
            elif urlsplit(self.path).path != "/rpc":
                self.answer(404, {"ok": False, "error": "not found"})
            else:
                with limit:
                    self.answer(200, rpc(engine, self.rfile.read(size).decode("utf-8", "replace"), confined=True) or "{}")

    host, _, port = listen.rpartition(":")
    return ThreadingHTTPServer((host.strip("[]"), int(port)), Handler)
