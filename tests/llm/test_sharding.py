import edges
from loomfield.llm import sharding as x


def test_few_records_move(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    rows = x.reshard(docs, x.WEIGHTS, x.grown()).collect()
    moved = [r for r in rows if r.moved]
    assert all(r.new_shard == 16 for r in moved)
    share = 1 / sum(x.grown().values())
    assert 0.8 * share < len(moved) / len(rows) < 1.2 * share
    total = sum(x.WEIGHTS.values())
    for s, w in x.WEIGHTS.items():
        n = sum(r.shard == s for r in rows)
        assert 0.85 * w / total < n / len(rows) < 1.15 * w / total


def test_a_removed_shard_gives_only_its_own(spark):
    docs = spark.range(5_000).withColumnRenamed("id", "doc_id")
    less = {k: w for k, w in x.WEIGHTS.items() if k != 3}
    assert all(r.shard == 3 for r in x.reshard(docs, x.WEIGHTS, less).where("moved").collect())


def test_edges(spark, tmp_path):
    docs = edges.documents(spark)
    rows = x.reshard(docs, x.WEIGHTS, x.grown()).collect()
    assert len(rows) == docs.count() and len({r.shard for r in rows if r.doc_id == 5}) == 1
    assert x.reshard(edges.empty(spark), x.WEIGHTS, x.grown()).count() == 0
    x.write_shards(docs.drop("shard"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


def test_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (None, "c", 9)], "doc_id long, shard string, shard_given int")
    out = x.assign(df, "doc_id")
    assert out.columns == ["doc_id", "shard_given_", "shard_given", "shard"] and sorted(r.shard_given_ for r in out.collect()) == ["a", "b", "c"]
    by_shard = {r.shard_given_: r["shard"] for r in x.assign(df, "shard").collect()}
    assert by_shard == {k: n for k, n in ((r.k, r.n) for r in df.select(df.shard.alias("k"), x.shard(x.key_of(df.shard), x.WEIGHTS).alias("n")).collect())}
    x.write_shards(df, str(tmp_path / "s"))
    assert sorted(r.shard_given_ for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["a", "b", "c"]
