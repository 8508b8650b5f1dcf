"""Rules that only tables beyond a few rows can break: dense numbers, neighbours of uneven items, blocks of queries, recall."""

from __future__ import annotations

import numpy as np
import pytest
from loomfield import catalog
from loomfield.functions import text, vectors
from loomfield.operators import keys, text_search, vector_search
from loomfield.operators.ranking import Params, merge_neighbors
from loomfield.schema import number
from loomfield.sources import items as src
from pyspark.sql import functions as F

VECTORS = "id long, field_idx int, embedding array<float>"


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", ["8", "200"])
def test_numbers_are_dense_and_in_order(spark, adaptive, parts):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        n = 120_000
        # A third of the rows tie in the key.
        rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(77)).otherwise(F.col("id") * 2).alias("key"), (F.col("id") * 7919 % n).alias("other"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).repartition(11)
        out = number(rows, "key").cache()
        assert out.columns == ["key", "other", "text", "id"]
        assert out.count() == n and out.agg(F.countDistinct("id"), F.min("id"), F.max("id"), F.countDistinct("text")).first()[:] == (n, 0, n - 1, n)
        keys_ = [r.key for r in out.orderBy("id").select("key").collect()]
        assert keys_ == sorted(keys_)
        out.unpersist()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_numbers_for_no_rows(spark):
    assert number(spark.createDataFrame([], "a long, m map<string,string>"), "a").count() == 0


def test_items_of_a_table_keep_all_rows(spark):
    n = 30_000
    items = src.from_columns(spark.range(n).select((F.lit(n) - F.col("id")).alias("k"), F.md5(F.col("id").cast("string")).alias("t")), "k", "t", order="k")
    assert items.count() == n and items.where(F.col("id") + 1 == F.col("identifier").cast("long")).count() == n


def test_runs_over_many_parts(spark):
    kinds = [int(x) for x in np.random.default_rng(1).integers(0, 3, 20_000)]
    rows = spark.createDataFrame([(k, f"q{x}", (str(k),)) for k, x in enumerate(kinds)], "ordinal long, identifier string, field struct<value:string>").repartition(7)
    runs = [(r.ordinal, r.identifier, [f.value for f in r.fields]) for r in src.group_runs(rows).orderBy("ordinal").collect()]
    want, at = [], 0
    while at < len(kinds):
        end = at
        while end < len(kinds) and kinds[end] == kinds[at]:
            end += 1
        want.append((at, f"q{kinds[at]}", [str(k) for k in range(at, end)]))
        at = end
    assert runs == want


def uneven(seed=0):
    """Items 0 and 1 with six vectors each, near to each other; six others with one."""
    r = np.random.default_rng(seed)
    rows = [(i, f, (np.array([1.0, 0, 0, 0]) + 0.01 * r.standard_normal(4)).tolist()) for i in (0, 1) for f in range(6)]
    return rows + [(i, 0, r.standard_normal(4).tolist()) for i in range(2, 8)]


@pytest.mark.parametrize("exact", [True, False])
def test_as_many_neighbours_as_there_are(spark, exact):
    index = vector_search.build(spark.createDataFrame(uneven(), VECTORS), "cosine")
    for precision, params in (("float32", Params(3, exact=exact)), ("int8", Params(3, exact=exact, rerank=2.0))):
        index = vector_search.build(spark.createDataFrame(uneven(), VECTORS), "cosine", precision)
        got = vector_search.neighbors(index, spark.createDataFrame([(0,), (5,)], "id long"), params).collect()
        assert sorted((r.q_id, r["rank"]) for r in got) == [(q, k) for q in (0, 5) for k in (1, 2, 3)]
        assert len({(r.q_id, r.id) for r in got}) == 6 and all(r.q_id != r.id for r in got)


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = spark.createDataFrame([(i // 3, i % 3, r.standard_normal(8).tolist()) for i in range(240)], VECTORS)
    q = spark.createDataFrame([(i, r.standard_normal(8).tolist()) for i in range(40)], "q_id long, embedding array<float>")
    index = vector_search.build(v, "l2")
    wanted = v.select("id").distinct()
    allow = wanted.where("id < 50")
    show = lambda df: sorted((x.q_id, x["rank"], x.id, x.field_idx, round(x.score, 9)) for x in df.collect())
    one = [show(vector_search.search(index, q, Params(5, exact=e), allow)) for e in (True, False)] + [show(vector_search.neighbors(index, wanted, Params(4, exact=True)))]
    monkeypatch.setattr(vector_search, "QUERIES_AT_ONCE", 16)
    many = [show(vector_search.search(index, q, Params(5, exact=e), allow)) for e in (True, False)] + [show(vector_search.neighbors(index, wanted, Params(4, exact=True)))]
    assert one == many and len(one[0]) == 200 and len(one[2]) == 320


def test_recall_of_the_registered_inverted_search(spark, sf):
    got = {(r.q_id, r.id) for r in catalog.QUERIES["vec_inverted"](spark, sf).collect()}
    want = {(r.q_id, r.id) for r in catalog.QUERIES["vec_cosine_norm"](spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_saved_cells_serve_inexact_searches(spark, sf, tmp_path):
    v = catalog._vectors(spark, sf)
    vector_search.index_table(v, str(tmp_path / "i"), "cosine-normalized", cells=True)
    index = vector_search.load_table(spark, str(tmp_path / "i"))
    q = catalog._vector_queries(spark, sf)
    got = {(r.q_id, r.id) for r in vector_search.search(index, q, Params(10)).collect()}
    want = {(r.q_id, r.id) for r in vector_search.search(index, q, Params(10, exact=True)).collect()}
    assert index.inverted is not None and len(got & want) >= 0.9 * len(want)


def test_signs_and_phrases(spark):
    items = src.from_rows(spark, [{"identifier": str(k), "fields": [t]} for k, t in enumerate(["alpha gamma beta", "alpha beta", "beta alpha", "gamma delta", "alpha alpha beta beta"])])
    index = text_search.build(items, text.plain_tokens)
    find = lambda q: sorted(r.id for r in text_search.full_text(index, spark.createDataFrame([(0, q)], "q_id long, query string"), Params(exact=True)).collect())
    assert find('alpha -"alpha beta"') == [0, 2]
    assert find('"alpha beta" delta') == [1, 3, 4] and find('+"alpha beta" delta') == [1, 4] and find('+alpha +"gamma beta"') == [0]
    assert find("-alpha") == [] and find("") == [] and find('""') == [] and find("+alpha -gamma delta") == [1, 2, 4]
    assert find('"alpha alpha"') == [4] and find("Alpha-beta") == [0, 1, 2, 4]


def test_escapes_of_tabbed_results(spark, tmp_path):
    rows = {"C:\\temp": r"C:\\temp", "a\tb": r"a\tb", 'say "x"\\': r"say \"x\"\\", "\\n": r"\\n", "two\nlines": r"two\nlines"}
    (tmp_path / "a.tsv").write_text("?id\t?value\n" + "\n".join(f'<http://e/{k}>\t"{v}"' for k, v in enumerate(rows.values())))
    got = [r.v for r in src.read_results(spark, str(tmp_path / "a.tsv")).orderBy("id").select(F.col("fields")[0]["value"].alias("v")).collect()]
    assert got == list(rows)


def test_prefixes_of_several_lengths(spark):
    k = spark.createDataFrame([("hello", 1), ("he", 2), ("world", 3)], "key string, value int")
    inputs = spark.createDataFrame([("hel",), ("w",), ("worlds",), ("",), (None,), ("hello",)], "input string")
    assert sorted(r.input for r in keys.contains_prefix(k, inputs).collect()) == ["", "hel", "hello", "w"]
    assert keys.size(k).first()[:] == (3, False) and keys.size(k.limit(0)).first()[:] == (0, True)


def test_vectors_of_a_file_are_read_by_ranges(spark, tmp_path, monkeypatch):
    from loomfield.sources import tensors

    monkeypatch.setattr(tensors, "PART", 10 * 4 * 5)
    x = np.random.default_rng(0).standard_normal((37, 5)).astype(np.float32)
    path = str(tmp_path / "v.safetensors")
    tensors.write_tensors(path, {"embedding": x, "id": (np.arange(37) // 2).astype(np.uint32)}, {"model": "m"})
    df, meta = tensors.read_vectors(spark, path)
    rows = df.orderBy("id", "pos").collect()
    assert meta == {"model": "m"} and [(r.id, r.pos) for r in rows] == [(k // 2, k % 2) for k in range(37)]
    assert np.array_equal(np.array([r.embedding for r in rows], np.float32), x)
    tensors.write_tensors(path, {"embedding": x[:0]})
    assert tensors.read_vectors(spark, path)[0].count() == 0


def test_scores_that_agree_to_nine_decimals_are_in_order_of_ids(spark):
    e = 1e-11
    v = spark.createDataFrame([(3, 0, [1.0, e]), (1, 0, [1.0, -e]), (2, 0, [1.0, 0.0]), (9, 0, [0.5, 0.0])], VECTORS)
    q = spark.createDataFrame([(7, [1.0, 1.0]), (7, [1.0, 0.5]), (8, [1.0, 1.0])], "q_id long, embedding array<float>")
    index = vector_search.build(v, "inner-product")
    show = lambda df: sorted((x.q_id, x["rank"], x.id) for x in df.collect())
    assert show(merge_neighbors(vector_search.scored(index, q, Params(2, exact=True)), 2)) == [(7, 1, 1), (7, 2, 2), (8, 1, 1), (8, 2, 2)]
    assert show(vector_search.search(index, q.where("q_id = 8"), Params(3, exact=True))) == [(8, 1, 1), (8, 2, 2), (8, 3, 3)]
    near = merge_neighbors(spark.createDataFrame([(1, 5, 0, 0.5 + e), (1, 4, 0, 0.5)], "q_id long, id long, field_idx int, score double"), 2)
    assert show(near) == [(1, 1, 4), (1, 2, 5)]


def test_rounded_values_have_the_signs_of_sql(spark, tmp_path):
    import compare

    x = np.random.default_rng(0).standard_normal((50, 64)).astype(np.float32)
    x[:, 3] = [-1e-6, 1e-6, 0.0, -0.0, -4e-5] * 10
    spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = compare.connect(str(tmp_path))
    for name, column in (("vec_truncate_normalize", "v"), ("vec_ip", "score")):
        got = sorted(str(sorted(r.asDict().items())) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("id", column).collect())
        assert got == sorted(str(sorted(zip(("id", column), r))) for r in db.execute(f"SELECT id, {column} FROM ({catalog.ORACLES[name]})").fetchall())
        assert name == "vec_ip" or "-0.0" in str(got)


def pruned(metric, precision, ids, q, rows, fields, x, most, least, apart, items):
    """Hits by _Top, in pieces of 64 vectors."""
    t = vector_search._Top(metric, precision, ids, q, most, least, apart, items)
    for a in range(0, len(x), 64):
        t.add(rows[a : a + 64], fields[a : a + 64], x[a : a + 64])
    return sorted((i, r, f, round(s, 9)) for i, r, f, s in zip(*(c.to_pylist() for c in t.batch().columns), strict=True))


def plainly(metric, precision, ids, q, rows, fields, x, most, least, apart, items):
    """The same from all scores."""
    s = vectors.scores(metric, vectors.quantized(q, precision), vectors.quantized(x, precision))
    out = []
    for name in np.unique(ids) if apart else range(len(q)):
        best = s[ids == name].max(0) if apart else s[name]
        hits = [(i, f, b) for i, f, b in zip(rows, fields, best, strict=True) if (least is None or b >= least) and not (apart and i == name)]
        if items:
            hits = [max((h for h in hits if h[0] == i), key=lambda h: (h[2], -h[1])) for i in {h[0] for h in hits}]
        hits = sorted(hits, key=lambda h: (-np.rint(h[2] * 1e9), h[0], -h[1]))[:most]
        out += [(int(name if apart else ids[name]), int(i), int(f), round(b, 9)) for i, f, b in hits]
    return sorted(out)


@pytest.mark.parametrize("metric,precision", [("cosine", "float32"), ("cosine-normalized", "bfloat16"), ("inner-product", "float16"), ("l2", "float32"), ("cosine", "int8"), ("hamming", "binary")])
@pytest.mark.parametrize("apart,items", [(False, False), (False, True), (True, True)])
def test_rough_products_lose_no_hit(monkeypatch, metric, precision, apart, items):
    r = np.random.default_rng(7)
    monkeypatch.setattr(vector_search, "STEP", 16)
    x = r.standard_normal((1_000, 16))
    x[:5], x[700:720], x[300] = 0, x[200], 40 * x[200]
    q = np.r_[x[::25], np.zeros((1, 16))] * (1 + (metric == "l2"))
    rows = r.permutation(1_000) // 4 if items else np.arange(1_000)
    fields = np.arange(1_000)
    ids = rows[::25].tolist() + [3]
    for most, least in ((3, None), (7, 0.3)):
        args = (metric, precision, np.array(ids), q, rows, fields, x, most, least, apart, items)
        assert pruned(*args) == plainly(*args)


def test_few_pairs_are_scored_in_double(monkeypatch):
    r = np.random.default_rng(8)
    seen = []
    for f in ("scores", "paired"):
        monkeypatch.setattr(vectors, f, lambda m, q, x, f=getattr(vectors, f), all_=f == "scores": seen.append(len(q) * (len(x) if all_ else 1)) or f(m, q, x))
    x = r.standard_normal((20_000, 32))
    t = vector_search._Top("cosine", "float32", np.arange(400) // 40, x[:400], 5, None, True, True)
    for a in range(0, len(x), 1_000):
        t.add(np.arange(a, a + 1_000) % 13, np.arange(a, a + 1_000), x[a : a + 1_000])
    assert t.batch().num_rows == 50 and sum(seen) < 400 * len(x) / 8


def test_blocks_of_queries_and_vectors_meet_in_no_row(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = spark.createDataFrame([(i, 0, r.standard_normal(8).tolist()) for i in range(120)], VECTORS)
    monkeypatch.setattr(vector_search, "QUERIES_AT_ONCE", 16)
    for precision, metric in (("binary", "hamming"), ("bfloat16", "cosine-normalized")):
        out = vector_search.scored(vector_search.build(v, metric, precision), v.select(F.col("id").alias("q_id"), "embedding"), Params(3, exact=True))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and out.count() == 360


@pytest.mark.parametrize("many", [False, True])
def test_probed_cells_are_searched_whole(spark, monkeypatch, many):
    r = np.random.default_rng(9)
    x = r.standard_normal((600, 8)).astype(np.float32)
    index = vector_search.build(spark.createDataFrame([(i // 2, i % 2, x[i].tolist()) for i in range(600)], VECTORS), "l2")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(40)], "q_id long, embedding array<float>")
    if many:
        monkeypatch.setattr(vector_search, "QUERIES_AT_ONCE", 16)
    inv = vector_search.invert(index, 12)
    found = vector_search.search_inverted(inv, q, Params(4, exact=True), probes=5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan
    far = vector_search._far(x.astype(np.float64), inv.centroids, "l2")
    cell, probed = far.argmin(1), np.argsort(far[:40], axis=1)[:, :5]
    s = vectors.scores("l2", x[:40].astype(np.float64), x.astype(np.float64))
    want = []
    for k in range(40):
        best: dict = {}
        for i in np.flatnonzero(np.isin(cell, probed[k])):
            best[i // 2] = max(best.get(i // 2, -1.0), s[k, i])
        want += [(k, n + 1, i, round(b, 6)) for n, (i, b) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:4])]
    assert sorted((h.q_id, h["rank"], h.id, round(h.score, 6)) for h in found.collect()) == want


def test_occurrences_of_short_and_long_fields(spark):
    r = np.random.default_rng(11)
    texts = [" ".join(r.choice(["a", "b", "c", "dd"], n)) for n in (1, 2, 3, 40, 120, 700)] + ["", "x", "é é É", "(a) a/a b."]
    items = src.from_rows(spark, [{"identifier": str(k), "fields": [t, "b b"]} for k, t in enumerate(texts)])
    got = sorted((x.id, x.field_idx, x.pos, x.word, x.occurrence, x.length) for x in text_search.postings(items).collect())
    want = []
    words = {(x.id, n): x.t for n in (0, 1) for x in items.select("id", text.tokens(F.col("fields")[n]["value"]).alias("t")).collect()}
    for (i, f), t in words.items():
        want += [(i, f, p, w, t[:p].count(w), len(t)) for p, w in enumerate(t)]
    assert got == sorted(want) and max(x[2] for x in got) == 699
    assert sorted(x[:4] + x[5:] for x in got) == sorted((x.id, x.field_idx, x.pos, x.word, x.length) for x in text_search.words_of(items).collect())
    short = spark.createDataFrame([(1, 0, ["a", "b", "a"])], "id long, field_idx int, t array<string>")
    rows = text_search._once(short)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted((x.pos, x.word, x.occurrence, x.length) for x in rows.collect()) == [(0, "a", 0, 3), (1, "b", 0, 3), (2, "a", 1, 3)]


def test_tokens_of_plain_and_ragged_texts(spark, monkeypatch):
    r = np.random.default_rng(12)
    texts = ["".join(r.choice(list("aB1#'/:(-. \t\né \u0085™"), 9)) for _ in range(3_000)] + ["", "...", "Brand#7", "a-b", "-", "#x y# z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    fast = [x.w for x in df.select(text.tokens(F.col("t")).alias("w")).collect()]
    monkeypatch.setattr(text, "_RAGGED", "")
    assert fast == [x.w for x in df.select(text.tokens(F.col("t")).alias("w")).collect()] and fast[-4:] == [["brand#7"], ["a-b"], ["-"], ["x", "y", "z"]]


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    monkeypatch.setattr(text_search, "SPLIT", 0)
    items = src.from_rows(spark, [{"identifier": str(k), "fields": [t]} for k, t in enumerate(["alpha beta", "beta gamma beta", "gamma delta"])])
    q = spark.createDataFrame([(0, "beta"), (1, '"gamma beta"')], "q_id long, query string")
    index = text_search.build(items, text.plain_tokens)
    out = text_search.full_text(index, q, Params(exact=True))
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString() and (index.docs, round(index.mean, 3)) == (3, 2.333)
    want = sorted(tuple(x) for x in out.select("q_id", "id", F.round("score", 9)).collect())
    monkeypatch.setattr(text_search, "PUSHED_WORDS", 1)
    for again in (text_search.build(items, text.plain_tokens), text_search.TextIndex(index.postings, index.vocabulary, 1, 1.0)):
        assert want == sorted(tuple(x) for x in text_search.full_text(again, q, Params(exact=True)).select("q_id", "id", F.round("score", 9)).collect())
    index = text_search.build(items)
    found = text_search.keyword(index, q.where("q_id = 0"), Params(exact=True))
    # The vocabulary and its prefixes were made before; only the postings are left in the plan, of short and of long fields.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 4 and "Generate explode" not in plan and found.count() == 2
