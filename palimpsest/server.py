"""JSON-RPC over the tools of a store, on lines of standard input or by HTTP POST."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from palimpsest.tools import StoreTools

#: Bytes of a request, and rows of an answer, at most.
MOST_BYTES, MOST_ROWS = 10 << 20, 5000
PARSE, METHOD, PARAMS, INTERNAL = -32700, -32601, -32602, -32603


def _error(ident: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": message}}


def answer(request: Any, tools: StoreTools) -> dict | None:
    """The answer to a request; None for notifications, which have no id."""
    if not isinstance(request, dict) or not isinstance(request.get("method"), str):
        return _error(request.get("id") if isinstance(request, dict) else None, METHOD, "no method")
    ident, method, params = request.get("id"), request["method"], request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        result: Any = {"serverInfo": {"name": "palimpsest"}, "capabilities": {"tools": {}}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n} for n in sorted(tools.names())]}
    elif method == "tools/call":
        known = tools.names()
        if params.get("name") not in known:
            return _error(ident, PARAMS, f"no tool {params.get('name')!r}")
        try:
            rows = known[params["name"]](**(params.get("arguments") or {})).limit(MOST_ROWS).collect()
        except (TypeError, ValueError, KeyError) as e:
            return _error(ident, PARAMS, str(e))
        except Exception as e:  # whatever a tool raises is an answer
            return _error(ident, INTERNAL, str(e)[:500])
        result = {"content": [r.asDict(recursive=True) for r in rows]}
    else:
        return _error(ident, METHOD, f"no method {method!r}")
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def answer_text(text: str | bytes, tools: StoreTools) -> str | None:
    try:
        request = json.loads(text)
    except ValueError:
        return json.dumps(_error(None, PARSE, "no JSON"))
    found = answer(request, tools)
    return None if found is None else json.dumps(found, default=str, ensure_ascii=False)


def serve_lines(tools: StoreTools, lines: Iterable[str] | None = None, out=None) -> None:
    out = sys.stdout if out is None else out
    for line in sys.stdin if lines is None else lines:
        found = answer_text(line, tools) if line.strip() else None
        if found:
            out.write(found + "\n")
            out.flush()


def http_server(tools: StoreTools, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that answers POST only; serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                self.send_error(413)
                return
            found = (answer_text(self.rfile.read(size), tools) or "").encode()
            self.send_response(200 if found else 202)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(found)))
            self.end_headers()
            self.wfile.write(found)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
