"""A thin HTTP front: SQL, PostgreSQL-flavoured SQL or SPARQL in the body, JSON lines out."""

from __future__ import annotations

from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

from lakeweft.engine import Engine
from lakeweft.sources.text import json_rows


def handler(engines: dict[tuple[str, str], Engine]) -> type[BaseHTTPRequestHandler]:
    """A handler for POST /sql/<db>, /psql/<db> and /rdf/<db>; ``engines`` has one per (kind, db)."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            kind, _, db = self.path.strip("/").partition("/")
            engine = engines.get((kind, unquote(db)))
            if engine is None:
                self.send_error(404)
                return
            text = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            try:
                frame = engine.sparql(text) if kind == "rdf" else engine.sql(text)
                lines = (r["line"] for r in json_rows(frame).toLocalIterator())
                first = next(lines, None)
            except Exception as error:  # the client is told what is wrong with its text
                body = str(error).split("\n")[0].encode()
                self.send_response(400)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)
                return
            self.send_response(200)
            self.send_header("Content-Type", "application/jsonl")
            self.end_headers()
            if first is not None:
                self.wfile.write(first.encode() + b"\n")
                for line in lines:
                    self.wfile.write(line.encode() + b"\n")

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(engines: dict[tuple[str, str], Engine], port: int = 0) -> ThreadingHTTPServer:
    """A server on localhost; the caller runs ``serve_forever``."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(engines))


def statements(text: str) -> list[str]:
    """The statements of a script, split at semicolons outside strings and comments."""
    out, start, i, quote = [], 0, 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\" and quote != '"':
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif text.startswith("--", i):
            i = text.find("\n", i)
            if i < 0:
                break
        elif c == ";":
            out.append(text[start:i])
            start = i + 1
        i += 1
    out.append(text[start:])
    return [s.strip() for s in out if s.strip()]


def replay(engine: Engine, text: str) -> int:
    """Run a dump's CREATE TABLE, INSERT and COPY parts; other statements are passed over.  Returns how many ran."""
    from lakeweft.sources.text import _COPY, load_dump

    frames = load_dump(engine.spark, text)
    n = 0
    for s in statements(_COPY.sub("", text)):
        body = "\n".join(x for x in s.splitlines() if not x.startswith("--")).strip()
        words = body.upper().split()[:2]
        if words == ["CREATE", "TABLE"] or words == ["INSERT", "INTO"]:
            engine.sql(body.replace("public.", ""))
            n += 1
    for name, frame in frames.items():
        if name in engine.statements.tables and not frame.isEmpty():
            engine.statements.tables[name].insert(frame)
            engine.statements.refresh(name)
            n += 1
    return n
