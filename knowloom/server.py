"""The HTTP service: GET /health, /knowledge, /audit; POST /compile, /query. Standard library only."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
from email.parser import BytesParser
from email.policy import HTTP
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from typing import Any
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import kmap, records
from .plans.engine import Asker, Compiler
from .sources.files import PARSERS, Config

#: Bounds of what may be asked for.
TOP_K, LIMIT = (1, 50), (1, 500)
MAX_BODY = 256 << 20


class Refused(Exception):
    """An answer other than 200."""

    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


def number(values: dict, name: str, default: int, low: int, high: int | None = None) -> int:
    try:
        n = int(values.get(name, default))
    except (TypeError, ValueError) as e:
        raise Refused(422, f"{name} must be an integer") from e
    if isinstance(values.get(name), bool) or n < low or high is not None and n > high:
        raise Refused(422, f"{name} must be {low} or more" + (f" and {high} or less" if high is not None else ""))
    return n


def word(values: dict, name: str, default: str | None = None) -> str:
    v = values.get(name, default)
    if not isinstance(v, str):
        raise Refused(422, f"{name} must be text")
    return v


def upload(kind: str, body: bytes) -> tuple[str, bytes]:
    """The first file of a multipart body: name and content."""
    message = BytesParser(policy=HTTP).parsebytes(b"Content-Type: " + kind.encode() + b"\r\n\r\n" + body)
    for part in message.iter_parts() if message.is_multipart() else ():
        if part.get_filename():
            return part.get_filename(), part.get_payload(decode=True) or b""
    raise Refused(422, "a file is missing")


class Service:
    """What the endpoints do, apart from HTTP. One compile at a time, since the store has one writer."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config, self.lock = spark, config, Lock()
        self.compiler, self.asker = Compiler(spark, config), Asker(spark, config)

    def health(self) -> dict:
        return {"status": "ok", "version": __version__, "provider": self.config.provider, "model": self.config.model or ""}

    def knowledge(self, limit: int | None = None, offset: int = 0) -> dict:
        """All records, or a page of them, and counts of the map."""
        c = self.compiler.store.ckus()
        rows = c.select("id", F.col("meta.source").alias("source"), F.col("meta.type").alias("doc_type"), F.col("meta.language").alias("language"), F.size("entities").alias("entity_count"), F.size("facts").alias("fact_count"), F.col("meta.access.roles").alias("roles")).orderBy("id").offset(offset)
        stats = kmap.stats(c).first().asDict()
        return {"total_ckus": stats["ckus"], "stats": stats, "ckus": [r.asDict() for r in (rows if limit is None else rows.limit(limit)).collect()]}

    def compile(self, name: str, content: bytes, force: bool, roles: str, user: str) -> dict:
        """The file is kept under its own name, so a later upload of that name takes its place."""
        name = re.split(r"[\\/]", name)[-1]
        if not name or not any(p.can_parse(name) for p in PARSERS):
            raise Refused(400, f"unsupported file type: {os.path.splitext(name)[1].lower()}")
        folder = tempfile.mkdtemp(prefix="knowloom-upload-")
        try:
            path = os.path.join(folder, name)
            with open(path, "wb") as f:
                f.write(content)
            given = [r.strip() for r in roles.split(",") if r.strip()] or None
            with self.lock:
                row = self.compiler.compile(path, force, given, names={path: name}, user=user or None).first()
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        said = {"compiled": f"{name} was compiled", "skipped": f"{name} has not changed", "failed": row.error}
        return {"status": row.status, "filename": name, "message": said[row.status]}

    def query(self, body: dict) -> dict:
        row = self.asker.query(word(body, "question"), word(body, "user_role", "") or None, number(body, "top_k", 5, *TOP_K), word(body, "user", "") or None)
        return {"answer": row["answer"], "sources": row["sources"], "routed_ckus": row["ckus"], "token_estimate": row["tokens"] or 0}

    def audit(self, values: dict) -> dict:
        kind, limit, offset = values.get("event_type") or None, number(values, "limit", 50, *LIMIT), number(values, "offset", 0, 0)
        events = self.compiler.store.events()
        rows = [r.asDict() for r in records.list_events(events, kind, limit, offset).collect()]
        return {"total": records.count_events(events, kind).first()[0], "events": [{**r, "user": r["user"] or "", "details": json.loads(r["details"])} for r in rows]}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: Any) -> None:
            pass

        def _answer(self, act) -> None:
            try:
                status, out = 200, act()
            except Refused as e:
                status, out = e.status, {"detail": str(e)}
            except Exception as e:  # noqa: BLE001
                status, out = 500, {"detail": f"{type(e).__name__}: {e}"}
            body = json.dumps(out, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _body(self) -> bytes:
            n = int(self.headers.get("Content-Length") or 0)
            if n > MAX_BODY:
                raise Refused(413, "too large")
            return self.rfile.read(n)

        def _missing(self) -> dict:
            raise Refused(404, "not found")

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            values = dict(parse_qsl(url.query))
            acts = {
                "/health": service.health, "/audit": lambda: service.audit(values),
                "/knowledge": lambda: service.knowledge(number(values, "limit", 0, 0) or None, number(values, "offset", 0, 0)),
            }
            self._answer(acts.get(url.path, self._missing))

        def do_POST(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            values = dict(parse_qsl(url.query))

            def compiled() -> dict:
                name, content = upload(self.headers.get("Content-Type", ""), self._body())
                return service.compile(name, content, values.get("force", "").lower() in ("1", "true", "yes"), values.get("roles", ""), values.get("user", ""))

            def asked() -> dict:
                try:
                    body = json.loads(self._body())
                except ValueError as e:
                    raise Refused(422, "the body must be JSON") from e
                if not isinstance(body, dict):
                    raise Refused(422, "the body must be an object")
                return service.query(body)

            self._answer({"/compile": compiled, "/query": asked}.get(url.path, self._missing))

    return Handler


def create_server(spark: SparkSession, config: Config, host: str = "127.0.0.1", port: int = 8484) -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(Service(spark, config)))
