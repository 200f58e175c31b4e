"""Queries over a socket, a line each, and the monitor's page over HTTP.

A client sends ``PING`` and gets ``PONG``, or ``EXEC`` and a query on the same line and
gets the two header lines and a line per row, then an empty line.  A line that starts
with ``!`` says what went wrong.  Rows are streamed; nothing is held but a partition.
"""

from __future__ import annotations

import socketserver
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from orrery.runtime import Engine

PAGE = """<!doctype html><title>orrery</title><pre id="q"></pre>
<script>setInterval(async () => { q.textContent = JSON.stringify(await (await fetch("/callback")).json(), null, 1) }, 1000)</script>"""


def query_server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> socketserver.ThreadingTCPServer:
    """A running server; ``shutdown()`` ends it."""

    class Handler(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for raw in self.rfile:
                for line in self.answers(raw.decode("utf-8", "replace").rstrip("\r\n")):
                    self.wfile.write(line.encode() + b"\n")
                self.wfile.flush()

        def answers(self, line: str):
            word, _, rest = line.partition(" ")
            if word == "PING":
                yield "PONG"
            elif word == "EXEC" and rest.strip():
                try:
                    yield from engine.stream(rest)
                    yield ""
                except Exception as e:
                    yield "!" + " ".join(str(e).split())
            else:
                yield "!PING or EXEC and a query are expected"

    return _running(socketserver.ThreadingTCPServer, host, port, Handler)


def monitor_server(engine: Engine, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """The page at ``/`` and its JSON at ``/callback``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = {"/": ("text/html", PAGE), "/callback": ("application/json", engine.monitoring())}.get(self.path.partition("?")[0])
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", found[0] if found else "text/plain")
            self.end_headers()
            self.wfile.write((found[1] if found else "not found").encode())

        def log_message(self, *_) -> None:
            pass

    return _running(ThreadingHTTPServer, host, port, Handler)


def _running(kind, host: str, port: int, handler):
    server = kind((host, port), handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
