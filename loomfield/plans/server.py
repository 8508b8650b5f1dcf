"""The service over HTTP: thin handlers over requests as tables.

GET /health and /indices, POST /search/INDEX, and, where the configuration has `sparql` with a prefix, POST /sparql/INDEX and /sparql/qlproxy/INDEX.
What a caller did wrong is status 400, anything else that fails 500. Each request is a Spark job on the session that is there.
"""

from __future__ import annotations

import json
import urllib.parse
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from ..operators.ranking import Params
from .service import BadRequest, Engine, federate, parse_service, request, service

JSON, RESULTS, TEXT = "application/json", "application/sparql-results+json", "text/plain"
#: Query types by kind of index, as they are listed.
LISTED = {"embedding": ["embedding"], "embedding-with-data": ["text", "embedding"]}
_UNITS = {"": 1, "B": 1, "KB": 1_000, "MB": 1_000_000, "GB": 1_000_000_000, "KIB": 1 << 10, "MIB": 1 << 20, "GIB": 1 << 30}


def size_of(text: str | int) -> int:
    """Bytes of a size such as 100MB."""
    s = str(text).strip().upper()
    digits = s.rstrip("BKMGI ")
    return int(float(digits) * _UNITS[s[len(digits) :].strip()])


@dataclass
class Server:
    spark: SparkSession
    engines: dict[str, Engine]
    prefix: str | None = None
    cors: bool = False
    max_input: int = 100_000_000

    @staticmethod
    def of(spark: SparkSession, engines: list[Engine], options: dict) -> Server:
        sparql = options.get("sparql")
        return Server(spark, {e.name: e for e in engines}, (sparql or {}).get("prefix", "http://loomfield/") if sparql is not None else None, bool(options.get("cors")), size_of(options.get("max_input_size", "100MB")))

    def engine(self, name: str) -> Engine:
        if name not in self.engines:
            raise BadRequest(f"Index not found: {name}")
        return self.engines[name]

    def answer(self, method: str, target: str, body: bytes = b"") -> tuple[int, str, str]:
        """Status, content type and text."""
        url = urllib.parse.urlsplit(target)
        path = [urllib.parse.unquote(p) for p in url.path.strip("/").split("/")]
        asked = dict(urllib.parse.parse_qsl(url.query))
        if len(body) > self.max_input:
            return 413, TEXT, "Error: the body is too large"
        try:
            if method == "GET" and path == ["health"]:
                return 200, TEXT, "OK"
            if method == "GET" and path == ["indices"]:
                return 200, JSON, json.dumps([{"name": e.name} | ({"description": e.description} if e.description else {}) | {"type": e.kind, "supported-query-types": LISTED.get(e.kind, ["text"])} for e in self.engines.values()])
            if method == "POST" and len(path) == 2 and path[0] == "search":
                return 200, JSON, self.search(self.engine(path[1]), body)
            if method == "POST" and self.prefix is not None and len(path) == 2 and path[0] == "sparql":
                return 200, RESULTS, self.sparql(self.engine(path[1]), body, asked)
            if method == "POST" and self.prefix is not None and len(path) == 3 and path[:2] == ["sparql", "qlproxy"]:
                return 200, RESULTS, self.qlproxy(self.engine(path[2]), body, asked)
        except BadRequest as e:
            return 400, TEXT, f"Error: {e}"
        except Exception as e:
            return 500, TEXT, f"Error: {type(e).__name__}: {str(e)[:500]}"
        return 404, TEXT, "Error: not found"

    def search(self, engine: Engine, body: bytes) -> str:
        raw = _json(body)
        hits = request(self.spark, engine, raw)
        matches: list[list[dict]] = [[] for _ in raw["queries"]]
        for r in hits.orderBy("q_id", "rank").collect():
            info = {"info": {"type": "field", "identifier": r.identifier, "field": r.field}} if r.identifier is not None else {}
            matches[r.q_id].append({"id": r.id, "score": r.score} | info)
        return json.dumps({"matches": matches})

    def sparql(self, engine: Engine, body: bytes, asked: dict[str, str]) -> str:
        text = asked.get("query") or body.decode()
        if text.startswith("query="):
            text = dict(urllib.parse.parse_qsl(text)).get("query", "")
        call = parse_service(text, self.prefix or "")
        hits = service(self.spark, engine, text, self.prefix or "")
        kinds = {v: k for k, v in call.outputs.items()}
        rows = hits.orderBy(call.outputs["rank"]).collect() if "rank" in call.outputs else hits.collect()
        return json.dumps({"head": {"vars": hits.columns}, "results": {"bindings": [{c: _term(kinds[c], r[c]) for c in hits.columns if r[c] is not None} for r in rows]}})

    def qlproxy(self, engine: Engine, body: bytes, asked: dict[str, str]) -> str:
        doc = _json(body)
        rowvar, query = asked.pop("rowvar", "row"), asked.pop("query", None)
        asked.pop("modality", None)
        try:
            params = Params.of(asked)
        except (TypeError, ValueError) as e:
            raise BadRequest(str(e)) from e
        names = doc.get("head", {}).get("vars", [])
        if rowvar not in names:
            raise BadRequest(f"Missing required variable '{rowvar}'")
        columns = [c for c in ("filter", "query") if c in names]
        value = lambda b, c: b[c]["value"] if c in b else None
        rows = [(k, value(b, rowvar), *[value(b, c) for c in columns]) for k, b in enumerate(doc.get("results", {}).get("bindings", []))]
        shape = "ordinal long, row string" + "".join(f", {c} string" for c in columns)
        hits = federate(engine, self.spark.createDataFrame(rows, shape), params, query).orderBy("rank").collect()
        out = [rowvar, "rank", "id", "score", "identifier", "field"]
        bind = [{rowvar: {"type": "literal", "value": r.row}} | {c: _term(c, r[c]) for c in out[1:] if r[c] is not None} for r in hits]
        return json.dumps({"head": {"vars": out}, "results": {"bindings": bind}})


def _json(body: bytes) -> dict:
    try:
        raw = json.loads(body)
    except ValueError as e:
        raise BadRequest(f"Failed to parse request: {e}") from e
    if not isinstance(raw, dict):
        raise BadRequest("Failed to parse request: an object is expected")
    return raw


def _term(name: str, value) -> dict:
    kinds = {"rank": "integer", "id": "integer", "score": "float"}
    if name in kinds:
        return {"type": "literal", "value": str(value), "datatype": f"http://www.w3.org/2001/XMLSchema#{kinds[name]}"}
    iri = name == "identifier" and ":" in value and not any(c.isspace() for c in value)
    return {"type": "uri" if iri else "literal", "value": value}


def serve(server: Server, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A listening server; call serve_forever."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            if n > server.max_input:
                status, kind, text = 413, TEXT, "Error: the body is too large"
                self.close_connection = True
            else:
                status, kind, text = server.answer(self.command, self.path, self.rfile.read(n))
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            if server.cors:
                self.send_header("Access-Control-Allow-Origin", "*")
                self.send_header("Access-Control-Allow-Headers", "*")
                self.send_header("Access-Control-Allow-Methods", "*")
            self.end_headers()
            self.wfile.write(data)

        def do_OPTIONS(self) -> None:
            self.send_response(200 if server.cors else 405)
            if server.cors:
                for name in ("Origin", "Headers", "Methods"):
                    self.send_header(f"Access-Control-Allow-{name}", "*")
            self.send_header("Content-Length", "0")
            self.end_headers()

        do_GET = do_POST = _reply

        def log_message(self, format: str, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
