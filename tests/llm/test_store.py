import edges
import pytest
from loomfield.llm import pieces, store
from loomfield.llm.common import tokenizer
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(tokenizer("piece_bpe_32k.model"))


def test_reconstruction_and_sharing(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = store.build(docs, model)
    assert all(r.verified for r in store.verify(s).collect())
    want = {r.doc_id: list(r.ids) for r in pieces.encode(docs, model, 1).collect()}
    got = {r.doc_id: list(r.ids) for r in store.reconstruct(s, model).collect()}
    assert got == want
    assert s.chunks.count() == s.chunks.select("digest").distinct().count()
    sizes = [r.n for r in s.chunks.select("n").collect()]
    assert max(sizes) <= store.MOST


def test_an_insertion_changes_few_chunks(spark, model):
    base = "".join(f"word{i * 7919 % 10007} " for i in range(6000))
    docs = spark.createDataFrame([(1, base), (2, base[:9000] + "and something new " + base[9000:])], "doc_id long, text string")
    a, b = (set(store.split(r.recipe)) for r in store.build(docs, model).recipes.orderBy("doc_id").collect())
    assert len(b - a) <= 5 < len(a & b)


def test_damage_is_seen(spark, model):
    docs = spark.createDataFrame([(1, "some text to be stored " * 50), (2, "other text to be stored here " * 50)], "doc_id long, text string")
    s = store.build(docs, model)
    first = s.recipes.where("doc_id = 1").first()
    bad = store.split(first.recipe)[0]
    broken = s.chunks.withColumn("payload", F.when(F.col("digest") == F.lit(bytes(bad)), F.concat(F.substring("payload", 1, 2), F.substring("payload", 5, 9999), F.lit(b"\0\0"))).otherwise(F.col("payload")))
    assert {r.doc_id: r.verified for r in store.verify(store.Store(broken, s.recipes, s.tree)).collect()} == {1: False, 2: True}
    gone = s.chunks.where(F.col("digest") != F.lit(bytes(bad)))
    assert {r.doc_id: r.verified for r in store.verify(store.Store(gone, s.recipes, s.tree)).collect()} == {1: False, 2: True}


def test_cuts_keep_their_bounds():
    assert store.cuts([], 0) == [] and store.cuts([], 10) == [10]
    ends = store.cuts([10, 70, 90, 5000], 5100)
    assert ends[0] == 70 and ends[-1] == 5100 and all(b - a <= store.MOST for a, b in zip([0, *ends], ends))


def test_manifest_follows_the_content(spark, model):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    root = lambda d: store.manifest(store.build(d, model).recipes, 8).orderBy(F.desc("height")).first().root
    assert root(docs) == root(docs.repartition(3)) != root(docs.where("doc_id < 19"))


def test_edges(spark, model):
    docs = edges.documents(spark)
    rows = store.verify(store.build(docs, model)).collect()
    assert sorted(r.doc_id for r in rows) == [1, 2, 3, 4, 5, 6, 7, 8] and all(r.verified for r in rows)
    assert {r.doc_id: r.n_chunks for r in rows}[1] == 0
    assert store.verify(store.build(edges.empty(spark), model)).count() == 0
    assert store.manifest(store.build(edges.empty(spark), model).recipes).count() == 1


def test_a_manifest_that_does_not_fit_is_seen(spark, model, monkeypatch):
    monkeypatch.setattr(store, "BUCKET", 2)
    monkeypatch.setattr(store, "FANOUT", 2)
    docs = spark.createDataFrame([(i, f"text number {i} " * 40) for i in range(40)], "doc_id long, text string")
    s = store.build(docs, model)
    rows = store.verify(s).collect()
    assert all(r.verified for r in rows) and len({r.corpus_root for r in rows}) == 1
    heights = {r.height: r.n for r in s.tree.groupBy("height").agg(F.count("*").alias("n")).collect()}
    assert max(heights) >= 2 and heights[max(heights)] == 1
    assert s.tree.orderBy(F.desc("height")).first().documents == 40
    other = s.tree.withColumn("root", F.when((F.col("height") == 0) & (F.col("number") == 1), F.lit("0" * 64)).otherwise(F.col("root")))
    assert not any(r.verified for r in store.verify(store.Store(s.chunks, s.recipes, other)).collect())
    first = s.recipes.where("doc_id = 3").first()
    swapped = s.recipes.where("doc_id <> 3").unionByName(s.recipes.where("doc_id = 4").withColumn("doc_id", F.lit(3).cast("long")))
    bad = {r.doc_id for r in store.verify(store.Store(s.chunks, swapped, s.tree)).collect() if not r.verified}
    assert 3 in bad and len(bad) < 40 and first is not None
