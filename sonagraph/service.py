"""HTTP surface over an engine: /health, /songs (GET, POST), /query (POST), with the standard library.

Answers are JSON {ok, data, error}.  A body above the limit is answered with 413, a truncated or
otherwise unreadable recording with 400.
"""

from __future__ import annotations

import itertools
import json
import logging
import re
import signal
import threading
import time
from email.parser import BytesParser
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import functions as F

from .operators.library import DUPLICATE
from .plans.engine import Engine

MAX_BODY = 50 << 20
READ_S, WRITE_S, IDLE_S, DRAIN_S = 30, 60, 120, 10
# The version and the messages that callers compare with.
VERSION = "step5"
BAD_FORM, BAD_AUDIO, INDEXED = "failed to parse multipart form: {}", "invalid audio: {}", "song '{}' is already indexed"
log = logging.getLogger("sonagraph.service")


class HttpError(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


def song_name(given: str | None, file_name: str | None) -> str:
    return (given or "").strip() or re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", file_name or "")[-1]) or "unknown"


def parse_form(content_type: str, body: bytes) -> dict[str, tuple[str | None, bytes]]:
    """Fields of a multipart form: name -> (file name, content)."""
    if not content_type.lower().startswith("multipart/form-data"):
        raise HttpError(400, BAD_FORM.format("the content type isn't multipart/form-data"))
    message = BytesParser().parsebytes(b"Content-Type: " + content_type.encode("latin-1") + b"\r\n\r\n" + body)
    if not message.is_multipart():
        raise HttpError(400, BAD_FORM.format("no part found"))
    return {str(p.get_param("name", header="content-disposition")): (p.get_filename(), p.get_payload(decode=True) or b"") for p in message.get_payload()}


class Service:
    """The routes, apart from HTTP: (method, path, content type, body) -> (status, data or error)."""

    def __init__(self, engine: Engine):
        self.engine, self.spark, self.writing = engine, engine.library.spark, threading.Lock()

    def answer(self, method: str, path: str, content_type: str = "", body: bytes = b"") -> tuple[int, dict]:
        try:
            status, data = self._route(method, path.split("?")[0], content_type, body)
            return status, {"ok": True, "data": data}
        except HttpError as e:
            return e.status, {"ok": False, "error": str(e)}
        except Exception:
            log.exception("%s %s failed", method, path)
            return 500, {"ok": False, "error": "internal server error"}

    def _route(self, method: str, path: str, content_type: str, body: bytes):
        if path == "/health":
            return 200, {"status": "ok", "version": VERSION}
        if path == "/songs" and method == "GET":
            return 200, {"stats": self.engine.stats().first().asDict()}
        if path not in ("/songs", "/query"):
            raise HttpError(404, "not found")
        if method != "POST":
            raise HttpError(405, "method not allowed")
        if len(body) > MAX_BODY:
            raise HttpError(413, "request body too large")
        form = parse_form(content_type, body)
        if "file" not in form:
            raise HttpError(400, "missing 'file' field in form")
        file_name, content = form["file"]
        return self._index(form, file_name, content) if path == "/songs" else self._query(content)

    def _files(self, path: str, content: bytes):
        return self.spark.createDataFrame([(path, bytearray(content))], "path string, content binary")

    def _index(self, form: dict, file_name: str | None, content: bytes):
        name = song_name(form.get("name", (None, b""))[1].decode("utf-8", "replace"), file_name)
        with self.writing:
            row = self.engine.index(self._files(file_name or "upload", content), F.lit(name)).first()
        if row["error"] == DUPLICATE:
            raise HttpError(409, INDEXED.format(name))
        if row["error"]:
            raise HttpError(400, BAD_AUDIO.format(row["error"]))
        return 201, {k: row[k] for k in ("song_id", "name", "peaks", "hashes")}

    def _query(self, content: bytes):
        row = self.engine.query(self._files("clip", content)).first()
        if row["error"]:
            raise HttpError(400, BAD_AUDIO.format(row["error"]))
        if row["song_id"] is None:
            raise HttpError(404, "no match found")
        return 200, {k: row[k] for k in ("song_id", "name", "votes", "confidence", "alignment_frames")}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    numbers = itertools.count(1)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def handle_one_request(self) -> None:
            self.connection.settimeout(IDLE_S)  # between requests
            super().handle_one_request()

        def _serve(self) -> None:
            number, began = f"{next(numbers):08d}", time.monotonic()
            self.connection.settimeout(READ_S)
            given = self.headers.get("Content-Length") or "0"
            length = int(given) if given.isdecimal() else -1
            if length < 0:
                status, out = 400, {"ok": False, "error": "invalid Content-Length"}
                self.close_connection = True
            elif length > MAX_BODY:
                status, out = 413, {"ok": False, "error": "request body too large"}
                self.close_connection = True
            else:
                status, out = service.answer(self.command, self.path, self.headers.get("Content-Type", ""), self.rfile.read(length))
            self.connection.settimeout(WRITE_S)
            data = json.dumps(out).encode()
            self.send_response(status)
            for key, value in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("X-Request-ID", number)):
                self.send_header(key, value)
            self.end_headers()
            self.wfile.write(data)
            log.info("%s %s %s %d %.1f ms", number, self.command, self.path, status, 1000 * (time.monotonic() - began))

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = _serve

        def log_message(self, *args) -> None:
            """Requests are logged in _serve."""

    return Handler


def serve(engine: Engine, port: int = 8080) -> None:
    """Serve until SIGINT or SIGTERM, then let open requests end."""
    server = ThreadingHTTPServer(("", port), handler(Service(engine)))
    server.daemon_threads = False
    thread = threading.Thread(target=server.serve_forever)
    done = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: done.set())
    thread.start()
    done.wait()
    server.shutdown()
    thread.join(DRAIN_S)
    server.server_close()
