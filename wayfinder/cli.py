"""Command line: scripts, one command, a shell, and GraphQL over HTTP."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from .errors import QueryError, running
from .plans.graphql import Document, schema_text
from .plans.sql import complete
from .session import Result, Session
from .sources.catalog import load
from .sources.store import MemoryStore, SnapshotStore

HELP = "\\d tables, \\d NAME columns and paths, \\graphql schema, \\? help, \\q quit"


def show(result: Result) -> Iterator[str]:
    """The lines of a result; all its rows are on the driver at once, as one parallel job brings them."""
    if result.df is None:
        yield f"OK, {result.rows_affected} rows affected"
        return
    with running():
        rows = [["NULL" if v is None else str(v) for v in r] for r in result.df.collect()]
    head = result.df.columns
    width = [max(map(len, col)) for col in zip(head, *rows)]
    yield " | ".join(x.ljust(w) for x, w in zip(head, width)).rstrip()
    yield "-+-".join("-" * w for w in width)
    for r in rows:
        yield " | ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
    yield f"({len(rows)} row{'s' * (len(rows) != 1)})"


def describe(session: Session, name: str | None) -> str:
    if not name:
        return "\n".join(session.catalog.relations)
    rel = session.catalog.relation(name)
    out = [f"{c.name} {c.type}{'' if c.nullable else ' not null'}" for c in rel.columns]
    out += [f"path {p.name} ({', '.join(p.partition)} | {', '.join(p.sort)}){' unique' * p.unique}" for p in rel.paths]
    return "\n".join(out)


def shell(session: Session, lines, out) -> None:
    pending = ""
    for line in lines:
        cmd = line.strip()
        try:
            if not pending and cmd.startswith("\\"):
                if cmd == "\\q":
                    return
                word, _, rest = cmd.partition(" ")
                print({"\\d": lambda: describe(session, rest.strip()), "\\graphql": lambda: schema_text(session.catalog), "\\?": lambda: HELP, "\\h": lambda: HELP}.get(word, lambda: f"unknown command {word}")(), file=out)
                continue
            pending += line if line.endswith("\n") else line + "\n"
            if complete(pending):
                text, pending = pending, ""
                for r in session.each(text):
                    for row in show(r):
                        print(row, file=out)
        except QueryError as e:
            pending = ""
            print(f"error: {e}", file=out)


def answer(session: Session, method: str, target: str, body: bytes) -> tuple[int, str, str]:
    """Status, content type and text of one HTTP request."""
    url = urlparse(target)
    if url.path == "/graphql/schema":
        return 200, "text/plain", schema_text(session.catalog)
    if url.path != "/graphql":
        return 404, "text/plain", "not found"
    try:
        if method == "POST":
            req = json.loads(body)
        elif method == "GET":
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            req = q | {"variables": json.loads(q.get("variables", "{}"))}
        else:
            return 405, "text/plain", "method not allowed"
        query = req["query"]
    except (ValueError, KeyError, TypeError):
        return 400, "text/plain", "bad request"
    if method == "GET":
        try:
            if any(o.kind == "mutation" for o in Document(query).operations):
                return 405, "text/plain", "mutations need POST"
        except QueryError:
            pass
    out = session.graphql(query, req.get("variables") or {}, req.get("operationName"))
    return 400 if out["data"] is None else 200, "application/json", json.dumps(out)


def serve(session: Session, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _reply(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, text = answer(session, self.command, self.path, body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(text.encode())

        do_GET = do_POST = do_PUT = do_DELETE = _reply

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("wayfinder")
    p.add_argument("scripts", nargs="*")
    p.add_argument("-schema", required=True)
    p.add_argument("-data", help="folder of snapshots; without it tables are in memory")
    p.add_argument("-allow-full-scan", action="store_true")
    p.add_argument("-c", dest="command")
    p.add_argument("-http", type=int)
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = SparkSession.builder.getOrCreate()
    try:
        catalog = load(a.schema)
        tables = SnapshotStore(spark, catalog, a.data) if a.data else MemoryStore(spark, catalog)
        session = Session(spark, catalog, tables, a.allow_full_scan)
        texts = [open(s).read() for s in a.scripts] + ([a.command] if a.command else [])
        for text in texts:
            for r in session.each(text):
                for row in show(r):
                    print(row)
        if a.http is not None:
            serve(session, a.http).serve_forever()
        elif not texts:
            shell(session, sys.stdin, sys.stdout)
    except (QueryError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
