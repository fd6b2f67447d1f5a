"""The daemon's endpoints, an HTTP layer over them, and the command line."""

from __future__ import annotations

import argparse
import json
import sys
import threading
from collections.abc import Callable, Sequence
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from weftline.config import Settings
from weftline.observability import logger
from weftline.operators.finalize import to_json
from weftline.operators.refresh import utc_now
from weftline.plans.engine import Engine


class Service:
    """health, status, refresh, suggest.  Refreshes exclude each other; a query reads the snapshot that
    was current when it began, so it need not wait for them."""

    def __init__(self, engine: Engine):
        self.engine, self._lock, self.last_refresh = engine, threading.RLock(), None

    def start(self) -> dict:
        """The first refresh, before anything is served."""
        return self.refresh()

    def health(self) -> dict:
        return {"status": "ok"}

    def status(self) -> dict:
        row = self.engine.store.snapshot().counts().first()
        return {"notes": row.notes, "chunks": row.chunks, "last_refresh": self.last_refresh}

    def refresh(self, rebuild: bool = False) -> dict:
        with self._lock:
            out = self.engine.refresh(rebuild)
            self.last_refresh = utc_now()
            return out

    def suggest(self, buffer: str) -> dict:
        return json.loads(to_json(self.engine.suggest(buffer)).first()[0])


def server(service: Service, host: str = "127.0.0.1", port: int = 8765) -> ThreadingHTTPServer:
    """GET /health and /status, POST /refresh {rebuild} and /suggest {buffer}; JSON both ways.  Call serve_forever() on it."""

    def refresh(body: dict) -> dict:
        return service.refresh(bool(body.get("rebuild", False)))

    def suggest(body: dict) -> dict:
        if not isinstance(body.get("buffer"), str):
            raise ValueError("buffer has to be a string")
        return service.suggest(body["buffer"])

    routes = {("GET", "/health"): lambda _: service.health(), ("GET", "/status"): lambda _: service.status(), ("POST", "/refresh"): refresh, ("POST", "/suggest"): suggest}

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            route = routes.get((self.command, self.path.partition("?")[0]))
            if route is None:
                return self._send(404, {"error": "no such endpoint"})
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                body = json.loads(raw) if raw else {}
                if not isinstance(body, dict):
                    raise ValueError("the body has to be an object")
            except ValueError as e:
                return self._send(400, {"error": str(e)})
            try:
                return self._send(200, route(body))
            except ValueError as e:
                return self._send(400, {"error": str(e)})
            except Exception as e:  # noqa: BLE001 the daemon goes on
                logger().exception("%s failed", self.path)
                return self._send(500, {"error": type(e).__name__})

        do_GET = do_POST = _reply

        def _send(self, code: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, said: str, *args: object) -> None:
            logger().debug(said, *args)

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: Sequence[str], spark: SparkSession, make: Callable[[SparkSession, Settings], Engine], stdin=None, stdout=None) -> int:  # noqa: ANN001
    """index [--rebuild], suggest [--no-refresh] and serve [--host] [--port]; JSON on stdout, everything else on stderr."""
    parser = argparse.ArgumentParser(prog="weftline")
    parser.add_argument("--corpus")
    parser.add_argument("--debug", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index").add_argument("--rebuild", action="store_true")
    commands.add_parser("suggest").add_argument("--no-refresh", action="store_true")
    daemon = commands.add_parser("serve")
    daemon.add_argument("--host", default="127.0.0.1")
    daemon.add_argument("--port", type=int, default=8765)
    given = parser.parse_args(list(argv))
    log, out = logger(given.debug), stdout or sys.stdout
    settings = Settings.load()
    if given.corpus:
        settings = settings.with_corpus(given.corpus)
    service = Service(make(spark, settings))
    if given.command == "serve":
        service.start()
        with server(service, given.host, given.port) as daemon_:
            daemon_.serve_forever()
        return 0
    if given.command == "index":
        result = service.engine.refresh(given.rebuild, lambda done, total, what: log.info("%d/%d %s", done, total, what))
    else:
        buffer = (stdin or sys.stdin).read()
        if not given.no_refresh:
            service.refresh()
        result = service.suggest(buffer)
    json.dump(result, out, indent=2, ensure_ascii=False)
    out.write("\n")
    return 0
