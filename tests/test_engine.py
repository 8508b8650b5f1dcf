"""Cases with known answers, over small items."""

from __future__ import annotations

import json

import numpy as np
import pytest
from loomfield.functions import text, vectors
from loomfield.operators import assignment, items as ops, keys, text_search, vector_search
from loomfield.operators.ranking import Params, budget, merge_neighbors
from loomfield.plans.config import Config
from loomfield.plans.embedders import Hashing
from loomfield.plans.service import BadRequest, Engine, catalog, federate, parse_service, request, response, results_json, service
from loomfield.schema import DataError, problems
from loomfield.sources import items as src
from loomfield.sources import remote, tensors
from pyspark.sql import functions as F


def hits(df):
    return [(r.id, r.field_idx, round(r.score, 6)) for r in df.orderBy("q_id", "rank").collect()]


def made(spark, *fields):
    return src.from_rows(spark, [{"identifier": f"Q{i}", "fields": list(f)} for i, f in enumerate(fields)])


def one(spark, query):
    return spark.createDataFrame([(0, query)], "q_id long, query string")


def keyword(spark, items, query, find=text_search.keyword, **params):
    return hits(find(text_search.build(items), one(spark, query), Params(**({"exact": True} | params))))


def test_keyword_scores(spark):
    a = made(spark, ["agar"], ["agar agar"])
    assert keyword(spark, a, "agar") == [(0, 0, 1.0), (1, 0, 0.75)]
    assert keyword(spark, a, "agar agar") == [(1, 0, 2.0), (0, 0, 0.5)]
    b = made(spark, ["United States", "the U.S. of A"])
    assert keyword(spark, b, "United States") == [(0, 0, 2.0)]
    assert keyword(spark, b, "United State") == [(0, 0, 1.75)]
    assert keyword(spark, b, "the U.S. of A") == [(0, 1, 4.0)]
    assert keyword(spark, b, "theunitedstates") == []


def test_fuzzy_scores(spark):
    a = made(spark, ["cat"], ["bat"])
    assert keyword(spark, a, "cat", text_search.fuzzy) == [(0, 0, 1.0), (1, 0, 0.75)]
    b = made(spark, ["federal state"], ["federated state"])
    assert keyword(spark, b, "federal state", text_search.fuzzy)[0][0] == 0
    n = spark.createDataFrame([("a" * k,) for k in range(1, 10)], "w string").select(text_search.max_distance(F.col("w")))
    assert [r[0] for r in n.collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4]


def test_normalize(spark):
    cases = {"(Hello) [World]": "hello world", "it's a test": "it's a test", "Category:Dogs": "category dogs", "a(b)c": "a b c", "Hello --- World": "hello --- world", "Café": "cafe", "Größe": "grosse", "!Hello, Größe-Test!": "hello grosse-test", "": ""}
    df = spark.createDataFrame(list(cases.items()), "a string, b string").select(text.normalize(F.col("a")).alias("got"), "b")
    assert all(r.got == r.b for r in df.collect())


def test_assignment_methods_agree(spark):
    r = np.random.default_rng(0)
    cases = []
    for k in range(40):
        n = int(r.integers(1, 5))
        rows = [[(int(j), float(w)) for j, w in zip(range(n), r.choice([0.25, 0.5, 0.75, 1.0], n)) if r.random() < 0.6] for _ in range(int(r.integers(1, 6)))]
        cases.append((k, n, [x for x in rows if x] or [[(0, 1.0)]]))
    df = spark.createDataFrame(cases, "k long, n int, rows array<array<struct<kwi:int,w:double>>>")
    for x in df.select("k", assignment.subsets(F.col("rows"), F.col("n")).alias("a")).collect():
        _, n, rows = cases[x.k]

        def best(i, used):
            if i == len(rows):
                return 0.0
            return max([best(i + 1, used)] + [w + best(i + 1, used | {j}) for j, w in rows[i] if j not in used])

        assert abs(x.a - best(0, frozenset())) < 1e-9 and abs(assignment.matching(rows, n) - best(0, frozenset())) < 1e-9


def test_many_words(spark):
    words = " ".join(f"w{i}" for i in range(12))
    assert keyword(spark, made(spark, [words]), words) == [(0, 0, 12.0)]


def test_full_text_syntax(spark):
    items = made(spark, ["red apple pie"], ["apple red"], ["green apple pie"])
    index = text_search.build(items, text.plain_tokens)
    find = lambda q: sorted(h[0] for h in hits(text_search.full_text(index, one(spark, q), Params(exact=True))))
    assert find("apple") == [0, 1, 2] and find("+red apple") == [0, 1] and find("apple -green") == [0, 1] and find('"red apple"') == [0]


def test_text_index_keeps_to_text(spark, tmp_path):
    bad = src.from_rows(spark, [{"identifier": "a", "fields": [{"type": "image", "value": "http://x/y.png"}]}])
    with pytest.raises(Exception, match="only text fields"):
        text_search.postings(bad).collect()
    index = text_search.build(made(spark, ["cold bolt"]))
    index.save(str(tmp_path / "i"))
    assert hits(text_search.keyword(text_search.TextIndex.load(spark, str(tmp_path / "i")), one(spark, "bolt"))) == [(0, 0, 0.75)]


V4 = [(100, 0, [1.0, 0.0, 0.0, 0.0]), (100, 1, [0.9, 0.1, 0.0, 0.0]), (200, 0, [0.0, 1.0, 0.0, 0.0]), (300, 0, [0.0, 0.0, 1.0, 0.0])]


def test_vectors(spark):
    v = spark.createDataFrame(V4, "id long, field_idx int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "q_id long, embedding array<float>")
    for metric in ("cosine", "cosine-normalized", "inner-product", "l2"):
        got = hits(vector_search.search(vector_search.build(v, metric), q, Params(exact=True)))
        assert got[0][:2] == (100, 0) and [g[0] for g in got].count(100) == 1
    allow = spark.createDataFrame([(200,), (300,)], "id long")
    assert [h[0] for h in hits(vector_search.search(vector_search.build(v, "cosine"), q, Params(exact=True), allow))] == [200, 300]
    near = hits(vector_search.neighbors(vector_search.build(v, "cosine"), spark.createDataFrame([(100,)], "id long"), Params(exact=True)))
    assert [h[0] for h in near] == [200, 300]
    with pytest.raises(ValueError):
        vectors.metric("hamming", "float32")
    e = spark.createDataFrame([(1, 0, [0.6, 0.8, 0.0, 0.0])], "id long, field_idx int, embedding array<float>")
    scored = hits(vector_search.search(vector_search.build(e, "cosine-normalized", "int8"), q, Params(exact=True, rerank=2.0)))
    assert abs(scored[0][2] - 0.6) < 1e-5
    assert budget(Params(k=10, exact=True), 3, 1.5) == 30 and budget(Params(k=10), 3, 1.5) == 15


def test_expressions_agree_with_numpy(spark):
    r = np.random.default_rng(1)
    a, b = r.standard_normal((20, 32)).astype(np.float32), r.standard_normal((20, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(20)], "i long, a array<float>, b array<float>")
    for m in ("cosine", "cosine-normalized", "inner-product", "l2", "hamming"):
        got = [x[0] for x in df.orderBy("i").select(vectors.score(m, vectors.distance(m, F.col("a"), F.col("b")), 32)).collect()]
        p = "binary" if m == "hamming" else "float32"
        assert np.allclose(got, np.diag(vectors.scores(m, vectors.quantized(a, p), vectors.quantized(b, p))), atol=1e-6)


def test_inverted_recall(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((400, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, 0, x[i].tolist()) for i in range(400)], "id long, field_idx int, embedding array<float>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "q_id long, embedding array<float>")
    index = vector_search.build(v, "cosine-normalized")
    exact = {(h.q_id, h.id) for h in vector_search.search(index, q, Params(exact=True)).collect()}
    found = {(h.q_id, h.id) for h in vector_search.search_inverted(vector_search.invert(index, 8), q, Params(exact=True), probes=6).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_merge(spark):
    h = spark.createDataFrame([(0, 1, 0, 0.5), (0, 1, 1, 0.9), (0, 2, 0, 0.9), (0, 3, 0, 0.1)], "q_id long, id long, field_idx int, score double")
    assert hits(merge_neighbors(h, 2)) == [(1, 1, 0.9), (2, 0, 0.9)]


def test_jsonl_and_rules(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text("\n".join(json.dumps(x) for x in [{"identifier": "Q1", "fields": [{"value": "Universe"}, {"value": "Cosmos", "tags": ["main"]}]}, {"identifier": "Q2", "fields": []}]))
    items = src.read_jsonl(spark, str(p))
    rows = items.orderBy("id").select("id", "identifier", F.size("fields").alias("n"), ops.main_field()["value"].alias("m"), ops.value_at(0).alias("f"), ops.value_at(5).alias("none")).collect()
    assert [tuple(r) for r in rows] == [(0, "Q1", 2, "Cosmos", "Universe", None), (1, "Q2", 0, None, None, None)]
    assert problems(items).count() == 0
    bad = tmp_path / "b.jsonl"
    bad.write_text("{broken")
    with pytest.raises(Exception):
        src.read_jsonl(spark, str(bad)).collect()
    with pytest.raises(DataError, match="duplicate"):
        src.from_rows(spark, [{"identifier": "a", "fields": []}, {"identifier": "a", "fields": []}])
    with pytest.raises(DataError, match="too long"):
        src.from_rows(spark, [{"identifier": "a" * 65_536, "fields": []}])
    with pytest.raises(DataError):
        src.from_rows(spark, [{"fields": []}])


def test_results_in_three_formats(spark, tmp_path):
    rows = [("http://e/Q1", "Universe"), ("http://e/Q2", "Earth"), ("http://e/Q2", "World"), ("http://e/Q3", "Human")]
    doc = {"head": {"vars": ["id", "value"]}, "results": {"bindings": [{"id": {"type": "uri", "value": a}, "value": {"type": "literal", "value": b}} for a, b in rows]}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "a.tsv").write_text("?id\t?value\n" + "\n".join(f'<{a}>\t"{b}"' for a, b in rows))
    results = "".join(f'<result><binding name="id"><uri>{a}</uri></binding><binding name="value"><literal>{b}</literal></binding></result>\n' for a, b in rows)
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?>\n<sparql><head><variable name="id"/><variable name="value"/></head><results>{results}</results></sparql>')
    for kind in ("json", "tsv", "xml"):
        got = [(r.identifier, list(r["values"])) for r in ops.values(src.read_results(spark, str(tmp_path / f"a.{kind}")).orderBy("id")).collect()]
        assert got == [("http://e/Q1", ["Universe"]), ("http://e/Q2", ["Earth", "World"]), ("http://e/Q3", ["Human"])], kind
    with pytest.raises(DataError, match="2 to 4"):
        src.check_header(["id", "value", "type", "tags", "more"])
    doc["results"]["bindings"][0]["id"]["type"] = "literal"
    (tmp_path / "b.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="to be an IRI"):
        src.read_results(spark, str(tmp_path / "b.json")).collect()
    assert src.guess_format("x.XML") == "xml"


def test_runs_and_groups(spark):
    rows = spark.createDataFrame([(k, i, {"value": v}) for k, (i, v) in enumerate([("a", "1"), ("a", "2"), ("b", "3"), ("a", "4")])], "ordinal long, identifier string, field struct<value:string>")
    runs = sorted((r.ordinal, r.identifier, len(r.fields)) for r in src.group_runs(rows).collect())
    assert runs == [(0, "a", 2), (2, "b", 1), (3, "a", 1)]
    assert sorted((r.identifier, len(r.fields)) for r in src.group_runs(rows, mode="group").collect()) == [("a", 3), ("b", 1)]


def test_tensors(spark, tmp_path):
    path = str(tmp_path / "v.safetensors")
    tensors.write_tensors(path, {"embedding": np.eye(3, 4, dtype=np.float32), "id": np.array([100, 100, 200], np.uint32)}, {"model": "m"})
    df, meta = tensors.read_vectors(spark, path)
    assert meta == {"model": "m"} and sorted((r.id, r.pos) for r in df.collect()) == [(100, 0), (100, 1), (200, 0)]
    tensors.write_tensors(path, {"embedding": np.eye(3, 4, dtype=np.float32), "id": np.array([1], np.uint32)})
    with pytest.raises(DataError):
        tensors.read_vectors(spark, path)


def test_fetch_retries():
    import io
    import urllib.error

    calls, slept = [], []

    class Answer(io.BytesIO):
        pass

    def opener(req, timeout):
        calls.append(req)
        if len(calls) < 3:
            raise urllib.error.HTTPError(req.full_url, 503, "busy", {"Retry-After": "7"} if len(calls) == 1 else {}, None)
        return Answer(b"ok")

    assert remote.fetch("http://x/y", opener=opener, sleep=slept.append) == b"ok" and slept == [7.0, 2.0]
    assert remote.should_retry(429) and not remote.should_retry(404)
    with pytest.raises(DataError):
        remote.load("ftp://x/y")


def test_keys(spark):
    k = spark.createDataFrame([("", 0), ("h", 1), ("hell", 2), ("hello", 3), ("hello world", 4)], "key string, value int")
    inputs = spark.createDataFrame([("hello my friend",), ("hello world!",)], "input string")
    got = sorted((r.input, r.length) for r in keys.prefix_matches(k, inputs).collect())
    assert got == [("hello my friend", n) for n in (0, 1, 4, 5)] + [("hello world!", n) for n in (0, 1, 4, 5, 11)]
    hel = spark.createDataFrame([("hel",)], "input string")
    assert keys.contains_prefix(k, hel).count() == 1 and keys.contains(k, hel).count() == 0
    assert keys.continuations(k, "hell").count() == 3


def test_service(spark):
    items = made(spark, ["blue widget"], ["red rod"])
    e = Engine("words", "keyword", text_search.build(items), items)
    got = request(spark, e, {"queries": [{"type": "value", "value": "blue"}, {"type": "value", "value": "rod"}], "k": "3", "exact": "true"})
    assert sorted((r.q_id, r.identifier, r.field) for r in got.collect()) == [(0, "Q0", "blue widget"), (1, "Q1", "red rod")]
    assert json.loads(response(got).where("q_id = 0").first().matches)[0]["info"]["identifier"] == "Q0"
    assert json.loads(results_json(got))["head"]["vars"][0] == "rank"
    with pytest.raises(BadRequest):
        request(spark, e, {"queries": [{"type": "what"}]})
    sparql = 'PREFIX s: <http://s/> SELECT * WHERE { s:config s:query "blue" ; }'
    with pytest.raises(BadRequest):
        parse_service(sparql, "http://s/")
    call = 'PREFIX s: <http://s/> SELECT * WHERE { s:config s:query "blue" . s:config s:identifier ?i . s:config s:score ?s . s:config s:k 2 }'
    out = service(spark, e, call, "http://s/")
    assert out.columns == ["s", "i"] and out.first().i == "Q0"
    bindings = spark.createDataFrame([("r0", "Q0", 0), ("r1", "Q1", 1), ("r2", "Q0", 2)], "row string, filter string, ordinal long")
    assert [r.row for r in federate(e, bindings, Params(exact=True), "blue").collect()] == ["r2"]
    assert federate(e, bindings.drop("filter"), Params(), "blue").count() == 0
    assert catalog(spark, [e]).first().supported_query_types == ["value"]


def test_embedded_once(spark, tmp_path):
    f = spark.createDataFrame([(0, 0, "a b"), (1, 0, "c")], "id long, field_idx int, value string")
    path = str(tmp_path / "v")
    assert vector_search.write_embedded(f.limit(1), Hashing(16), path, spark) == 1
    assert vector_search.write_embedded(f, Hashing(16), path, spark) == 1
    assert vector_search.write_embedded(f, Hashing(16), path, spark) == 0


def test_config(spark, tmp_path):
    from loomfield.plans.config import Pipeline

    with pytest.raises(DataError):
        Config.of({"datasets": [{"name": "x"}]})
    p = tmp_path / "a.jsonl"
    p.write_text('{"identifier": "Q1", "fields": [{"value": "blue widget"}]}\n{"identifier": "Q2", "fields": [{"value": "red rod"}]}')
    c = Config.of(
        {
            "datasets": [{"name": "d", "output": str(tmp_path / "d"), "source": {"type": "jsonl", "path": str(p)}}],
            "models": [{"name": "m", "type": "hashing"}],
            "embeddings": [{"name": "e", "output": str(tmp_path / "e"), "model": "m", "data": "d"}],
            "indices": [{"name": "k", "type": "keyword", "data": "d", "output": str(tmp_path / "k")}, {"name": "v", "type": "embedding-with-data", "data": "d", "embedding_data": "e", "model": "m", "output": str(tmp_path / "v")}],
        }
    )
    for e in Pipeline(spark, c).run():
        assert request(spark, e, {"queries": [{"type": "value", "value": "blue widget"}], "k": 1}).first().identifier == "Q1"
    assert Pipeline(spark, c).data() == {"d": False}


def test_stream(spark, tmp_path):
    from loomfield.streaming.search import search_stream

    index = text_search.build(made(spark, ["cold bolt"]))
    one(spark, "bolt").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("q_id long, query string").parquet(str(tmp_path / "in"))
    search_stream(stream, lambda q: text_search.keyword(index, q), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_api(spark, tmp_path):
    from loomfield.api import Data, KeywordIndex

    d = Data.build_from_items([{"identifier": "a", "fields": ["blue widget"]}, {"identifier": "b", "fields": ["red rod", "blue"]}], str(tmp_path / "d"))
    assert (len(d), d.id_from_identifier("b"), d.field(1, 1), d.field(1, 2), d.num_fields(1), list(d)[0]) == (2, 1, "blue", None, 2, ("a", ["blue widget"]))
    KeywordIndex.build(d, str(tmp_path / "k"))
    k = KeywordIndex.load(d, str(tmp_path / "k"))
    assert k.search("blue", exact=True) == [(1, 1, 1.0), (0, 0, 0.75)] and k.search("blue", exact=True, allow_ids={0}) == [(0, 0, 0.75)]
