import compare
import corpus_pipeline
import edges
from loomfield.llm import queries
from pyspark.sql import functions as F


def test_sql_gives_the_same_rows(spark, sf):
    db = compare.connect(sf)
    for name, sql in queries.oracle_sql().items():
        got, want = compare.both(spark, db, queries.queries()[name], sql, sf)
        assert got == want, name


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "piece_encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = out.count()
        out = stage(spark, out, sf).cache()
        assert out.columns == docs.columns and 0 < out.count() <= before
    assert out.where(F.col("text").rlike("AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}|token = \"[0-9a-f]{40}")).count() == 0
    final = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in final.select("doc_id").collect()) == sorted(r.doc_id for r in out.select("doc_id").collect())
    assert final.where("not round_trip").count() == 0


def test_stages_take_hard_rows(spark, sf):
    docs = edges.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edges.documents(spark).columns
    assert docs.count() > 0


def test_stages_take_an_empty_table(spark, sf):
    docs = edges.empty(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edges.empty(spark).columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0
