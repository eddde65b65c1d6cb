"""A thin HTTP service over one long-lived session.

POST /query, /index, /reindex, /remove, /invalidate and /health; GET /health and /list. Every
request reads the generation in force, so nothing has to be told of a build elsewhere. The
service ends after ``idle`` seconds without a request, or on SIGTERM or SIGINT.
"""

from __future__ import annotations

import json
import signal
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

from .operators.library import Library


def _query(library: Library, body: dict) -> tuple[int, object]:
    """Of one index and its children; of those with all of some tags; or, where neither is named, of all."""
    question, directory, tags = body.get("question"), body.get("directory"), body.get("tags") or None
    if not isinstance(question, str) or not question:
        return 400, {"error": "question is missing"}
    everything = bool(body.get("all", directory is None and tags is None))
    if not (directory or tags or everything):
        return 400, {"error": "name a directory or tags, or ask for all"}
    asked = library.route(directory, tags, everything)
    if not asked:
        return 404, {"error": "nothing is indexed"}
    stale = library.stale(asked)
    if set(stale) >= set(asked):
        return (409, {"error": f"{asked[0]} has tables of an older format; build it again"}) if not (tags or everything) else (200, {"results": [], "stale": stale})
    found = library.search(question, asked, int(body.get("top_k", 5)), body.get("folder"))
    rows = [r.asDict() for r in found.drop("rank", "loc").collect()]
    reply = {"results": [{k: v for k, v in r.items() if v is not None} for r in rows]}
    return 200, reply | {"stale": stale} if tags or everything else reply


def answer(library: Library, path: str, body: dict) -> tuple[int, object]:
    """Status and reply of one request."""
    try:
        if path == "/query":
            return _query(library, body)
        if path == "/index":
            if not body.get("directory"):
                return 400, {"error": "directory is missing"}
            return 200, library.build(body["directory"], bool(body.get("force")), body.get("split"), body.get("tags"), body.get("exclude"))
        if path == "/reindex":
            return 200, library.reindex(body.get("directories"), bool(body.get("force")))
        if path == "/remove":
            return (200, {"removed": True}) if library.remove(body.get("directory", "")) else (404, {"error": "not indexed"})
        if path in ("/health", "/invalidate"):
            return 200, {"ok": True}
        if path == "/list":
            return 200, [r.asDict() for r in library.entries().orderBy("directory").collect()]
        return 404, {"error": "no such path"}
    except KeyError as error:
        return 404, {"error": str(error)}
    except (ValueError, OSError) as error:
        return 400, {"error": str(error)}
    except Exception as error:  # a failed build or search must not end the service
        return 500, {"error": str(error)[:500]}


def server(library: Library, port: int = 0) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self, status: int, what: object) -> None:
            raw = json.dumps(what, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self.server.last = time.time()
            self._reply(*answer(library, self.path, {}) if self.path in ("/health", "/list") else (404, {"error": "no such path"}))

        def do_POST(self) -> None:
            self.server.last = time.time()
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(body, dict):
                    raise ValueError
            except ValueError:
                return self._reply(400, {"error": "the body is not a JSON object"})
            self._reply(*answer(library, self.path, body))
            self.server.last = time.time()

        def log_message(self, *_: object) -> None:
            pass

    out = HTTPServer(("127.0.0.1", port), Handler)
    out.last = time.time()
    return out


def serve(library: Library, port: int, idle: float) -> None:
    http = server(library, port)

    def watch() -> None:
        while time.time() - http.last < idle:
            time.sleep(min(30, max(idle / 10, 0.05)))
        http.shutdown()

    threading.Thread(target=watch, daemon=True).start()
    for name in (signal.SIGTERM, signal.SIGINT):
        signal.signal(name, lambda *_: threading.Thread(target=http.shutdown).start())
    try:
        http.serve_forever()
    finally:
        http.server_close()
