"""Requests over HTTP, models, guards and configured pipelines."""

from __future__ import annotations

import io
import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from loomfield.functions import text
from loomfield.operators import text_search, vector_search
from loomfield.plans import embedders
from loomfield.plans.config import Config, Pipeline, guarded
from loomfield.plans.embedders import Hashing, Served
from loomfield.plans.server import Server, serve, size_of
from loomfield.plans.service import Engine
from loomfield.schema import DataError
from loomfield.sources import items as src
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def server(spark):
    items = src.from_rows(spark, [{"identifier": f"http://e/Q{k}", "fields": [t]} for k, t in enumerate(["blue widget", "red rod", "blue rod"])])
    embed = Hashing(16)
    v = spark.createDataFrame([(k, 0, row.tolist()) for k, row in enumerate(embed(["blue widget", "red rod", "blue rod"]))], "id long, field_idx int, embedding array<float>")
    words = Engine("words", "keyword", text_search.build(items), items, description="by words")
    vectors = Engine("vectors", "embedding-with-data", vector_search.build(v), items, embed)
    return Server.of(spark, [words, vectors], {"sparql": {"prefix": "http://s/"}, "cors": True, "max_input_size": "1MB"})


def test_lists_and_health(server):
    assert server.answer("GET", "/health") == (200, "text/plain", "OK")
    listed = json.loads(server.answer("GET", "/indices")[2])
    assert listed == [{"name": "words", "description": "by words", "type": "keyword", "supported-query-types": ["text"]}, {"name": "vectors", "type": "embedding-with-data", "supported-query-types": ["text", "embedding"]}]
    assert server.answer("GET", "/nothing")[0] == 404 and server.answer("POST", "/search/words", b"x" * 2_000_000)[0] == 413
    assert (size_of("100MB"), size_of(7), size_of("1KiB")) == (100_000_000, 7, 1024)


def test_search(server):
    body = {"queries": [{"type": "value", "value": "blue"}, {"type": "value", "value": "nothing"}, {"type": "value", "value": "rod"}], "k": 2, "exact": True}
    status, _, out = server.answer("POST", "/search/words", json.dumps(body).encode())
    matches = json.loads(out)["matches"]
    assert status == 200 and [len(m) for m in matches] == [2, 0, 2]
    assert matches[0][0]["info"] == {"type": "field", "identifier": "http://e/Q0", "field": "blue widget"}
    near = {"queries": [{"type": "identifier", "value": "http://e/Q2"}, {"type": "embedding", "value": [1.0] * 16}, {"type": "value", "value": "red rod", "modality": "text"}], "k": 1}
    matches = json.loads(server.answer("POST", "/search/vectors", json.dumps(near).encode())[2])["matches"]
    assert matches[0][0]["id"] in (0, 1) and matches[2][0]["id"] == 1
    for bad in (b"{", b"[]", b"{}", b'{"queries": [{"type": "what"}]}', b'{"queries": [], "k": "many"}', b'{"queries": [{"type": "value", "value": "http://x/y.png", "modality": "image"}]}'):
        assert server.answer("POST", "/search/vectors", bad)[0] == 400, bad
    assert server.answer("POST", "/search/none", b'{"queries": []}')[0] == 400


def test_sparql(server):
    call = 'PREFIX s: <http://s/> SELECT * WHERE { s:config s:query "blue" . s:config s:identifier ?i . s:config s:rank ?r . s:config s:k 5 }'
    status, kind, out = server.answer("POST", "/sparql/words", call.encode())
    doc = json.loads(out)
    assert (status, kind, doc["head"]["vars"]) == (200, "application/sparql-results+json", ["r", "i"])
    assert [b["i"] for b in doc["results"]["bindings"]] == [{"type": "uri", "value": "http://e/Q0"}, {"type": "uri", "value": "http://e/Q2"}]
    assert server.answer("POST", "/sparql/words", b"ASK {}")[0] == 400
    rows = [{"row": {"type": "literal", "value": f"r{k}"}, "filter": {"type": "uri", "value": f"http://e/Q{k}"}} for k in (1, 2)]
    body = json.dumps({"head": {"vars": ["row", "filter"]}, "results": {"bindings": rows}}).encode()
    doc = json.loads(server.answer("POST", "/sparql/qlproxy/words?query=rod&k=10&exact=true", body)[2])
    assert sorted(b["row"]["value"] for b in doc["results"]["bindings"]) == ["r1", "r2"]
    assert server.answer("POST", "/sparql/qlproxy/words", body)[0] == 400
    assert server.answer("POST", "/sparql/qlproxy/words?rowvar=x&query=a", body)[0] == 400


def test_over_a_socket(server):
    with serve(server, port=0) as listening:
        threading.Thread(target=listening.serve_forever, daemon=True).start()
        base = f"http://127.0.0.1:{listening.server_address[1]}"
        with urllib.request.urlopen(base + "/health") as answer:
            assert answer.read() == b"OK" and answer.headers["Access-Control-Allow-Origin"] == "*"
        ask = urllib.request.Request(base + "/search/words", b'{"queries": [{"type": "value", "value": "red"}]}')
        with urllib.request.urlopen(ask) as answer:
            assert json.load(answer)["matches"][0][0]["id"] == 1
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + "/indices/none")
        assert e.value.code == 404
        listening.shutdown()


def test_guards(spark):
    items = src.from_rows(spark, [{"identifier": "a", "fields": ["text", {"type": "image", "value": "http://x/y.png"}]}])
    from loomfield.operators.items import fields

    assert guarded(fields(items), "multimodal").count() == 2
    for modality in ("text", "image"):
        with pytest.raises(Exception, match="can't embed a field of type"):
            guarded(fields(items), modality).collect()


def test_served_model_asks_and_tries_again(monkeypatch):
    calls = []

    def answer(request, timeout):
        calls.append(request.full_url)
        if len(calls) == 2:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {}, None)
        if request.full_url.endswith("/models"):
            return io.BytesIO(b'{"data": [{"id": "m"}]}')
        texts = json.loads(request.data)["input"]
        return io.BytesIO(json.dumps({"data": [{"embedding": [len(t), 1.0, 0.0]} for t in texts]}).encode())

    monkeypatch.setattr(embedders, "fetch", lambda url, headers=None, **more: embedders_fetch(url, headers, opener=answer, sleep=lambda s: None, **more))
    from loomfield.sources.remote import fetch as embedders_fetch

    model = Served("http://h", "m", batch=2).probe()
    assert model.dims == 3 and len(calls) == 3
    rows = model(["aaa", "", "a"])
    assert np.allclose(rows[:, 0], [3 / np.sqrt(10), 0, 1 / np.sqrt(2)])
    with pytest.raises(DataError):
        Served("http://h", "other").probe()


def test_local_models_say_what_they_need():
    for kind in (embedders.Sentences, embedders.Images, embedders.Clip):
        with pytest.raises(DataError, match="library|needs PIL"):
            kind("some/model")(["iVBORw0KGgo="])

    class Lengths(embedders._Local):
        def _embed(self, values):
            return np.array([[len(v), len(values)] for v in values], np.float32)

    out = Lengths("x", batch=2)._batches(["aa", "a", "aaa"])
    assert out.tolist() == [[2, 2], [1, 1], [3, 2]] and Lengths("x", 1)._batches(["aa"]).tolist() == [[2]]
    assert embedders.looks_like_image("https://x/y.png") and not embedders.looks_like_image("a word")


def test_vector_indices_are_built_once(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"identifier": "Q1", "fields": [{"value": "blue widget"}]}\n{"identifier": "Q2", "fields": [{"value": "red rod"}]}')
    c = Config.of({"datasets": [{"name": "d", "output": str(tmp_path / "d"), "source": {"type": "jsonl", "path": str(p)}}], "models": [{"name": "m", "type": "hashing"}], "embeddings": [{"name": "e", "output": str(tmp_path / "e"), "model": "m", "data": "d"}], "indices": [{"name": "v", "type": "embedding-with-data", "data": "d", "embedding_data": "e", "model": "m", "output": str(tmp_path / "v")}]})
    Pipeline(spark, c).run()
    made = sorted((tmp_path / "v").rglob("*.parquet"))
    (engine,) = Pipeline(spark, c).run()
    assert sorted((tmp_path / "v").rglob("*.parquet")) == made and engine.index.precision == "bfloat16" and engine.index.vectors.count() == 2


def test_other_scripts(spark):
    cases = {"Москва": "moskva", "Щука ёж": "shchuka ezh", "Αθήνα": "athena", "ＡＢＣ ٣٤": "abc 34", "Größe ﬁn": "grosse fin", "日本": "日本"}
    rows = spark.createDataFrame(list(cases.items()), "a string, b string").select("a", text.normalize(F.col("a")).alias("got"), "b").collect()
    assert {r.a: r.got for r in rows} == cases


def test_an_endpoint_is_read_by_an_executor(spark, tmp_path):
    import http.server

    asked = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["X-Key"], self.headers["Accept"]))
            rows = [{"id": {"type": "uri", "value": f"http://e/Q{k}"}, "value": {"type": "literal", "value": f"text {k}"}} for k in (1, 1, 2)]
            body = json.dumps({"head": {"vars": ["id", "value"]}, "results": {"bindings": rows}}, indent=1).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, format, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer) as listening:
        threading.Thread(target=listening.serve_forever, daemon=True).start()
        source = {"type": "sparql-query", "endpoint": f"http://127.0.0.1:{listening.server_address[1]}/q", "query": "SELECT *", "headers": {"X-Key": "k"}, "default_field_type": "text"}
        c = Config.of({"datasets": [{"name": "d", "output": str(tmp_path / "d"), "source": source}]})
        pipeline = Pipeline(spark, c)
        assert pipeline.data() == {"d": True}
        listening.shutdown()
    rows = pipeline.items("d").orderBy("id").collect()
    assert [(r.identifier, [f.value for f in r.fields]) for r in rows] == [("http://e/Q1", ["text 1", "text 1"]), ("http://e/Q2", ["text 2"])]
    assert asked and all(a == ("/q?query=SELECT+%2A", "k", "application/sparql-results+json") for a in asked)
