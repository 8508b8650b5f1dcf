import edges
import numpy as np
from loomfield.llm import langid as x


def naive(sym, text):
    """Phrases of a greedy parse into the longest pieces that occur in text."""
    count = at = 0
    while at < len(sym):
        n = 0
        while at + n < len(sym) and n < len(sym) and sym[at : at + n + 1] in text:
            n += 1
        count += 1
        at += max(1, n)
    return count


def test_parser_against_a_naive_parse():
    texts = {"a": b"the cat sat on the mat\0and the dog ran", "b": b"le chat est sur la table et le chien court"}
    p = x.Parser.of(texts)
    rows = [b"the dog sat on the mat", b"le chien est sur le mat", b"zzz qqq", b"t", b"the the the cat"]
    off = np.r_[0, np.cumsum([len(r) for r in rows])]
    got = p.phrases(np.frombuffer(b"".join(rows), np.uint8), off)
    for k, name in enumerate(p.names):
        assert got[k].tolist() == [naive(r, texts[name]) for r in rows]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 100")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    got = {r.doc_id: r for r in x.detect(test, x.train(train)).collect()}
    truth = {r.doc_id: r.lang for r in test.collect()}
    right = sum(got[d].language == truth[d] for d in truth)
    assert right >= 0.97 * len(truth)
    assert sum(r.accepted for r in got.values()) >= 0.97 * len(truth)


def test_edges(spark, sf):
    model = x.train(spark.read.parquet(f"{sf}/documents.parquet"))
    docs = edges.documents(spark)
    out = x.detect(docs, model).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    assert by[1].language is None and by[2].language is None and by[7].language is None and not by[7].accepted
    kept = x.accept(docs, model)
    assert kept.columns == docs.columns and not {1, 2, 7} & {r.doc_id for r in kept.collect()}
    assert x.detect(edges.empty(spark), model).count() == 0 and x.accept(edges.empty(spark), model).count() == 0
    none = x.train(edges.empty(spark))
    assert not any(r.accepted for r in x.detect(docs, none).collect())


def test_short_texts(spark, sf):
    """Junk of any length is rejected, cuts of labelled text are not."""
    import random

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = x.train(docs.where("doc_id % 2 = 0"))
    r = random.Random(3)
    junk = [(k, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))) for k, n in enumerate([20, 30, 60, 100, 150, 190, 250] * 30)]
    assert x.detect(spark.createDataFrame(junk, "doc_id long, text string"), model).where("accepted").count() <= 4
    texts = [t.text for t in docs.where("doc_id % 2 = 1 and length(text) > 400 and text rlike '^[^0-9$]*$'").orderBy("doc_id").limit(80).collect()]
    cuts = [(k, t[a : a + n]) for k, t in enumerate(texts) for a, n in ((7, 12), (50, 30), (100, 80), (150, 150))]
    assert x.detect(spark.createDataFrame(cuts, "doc_id long, text string"), model).where("not accepted").count() <= 0.03 * len(cuts)
