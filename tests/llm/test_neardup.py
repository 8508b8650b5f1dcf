import random

import edges
import numpy as np
from loomfield.llm import neardup
from loomfield.llm import textvec as tv


def shingle_set(text):
    raw = (text or "").encode()
    value, _ = neardup.shingles(tv.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    return set(value.tolist())


def corpus():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    docs, leaders = [], []
    for k in range(40):
        base = [r.choice(words) for _ in range(r.choice([30, 80, 200, 600]))]
        docs.append((100 + 10 * k, " ".join(base)))
        leaders.append(100 + 10 * k)
        if k % 2 == 0:
            docs.append((101 + 10 * k, " ".join(base)))  # exact
            part = list(base)
            for i in range(0, len(part), 60):
                part[i] = r.choice(words)
            docs.append((102 + 10 * k, " ".join(part)))  # near
            docs.append((103 + 10 * k, " ".join(base[: int(len(base) * 0.6)])))  # contained
    return docs


def test_recall_and_precision_against_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in neardup.groups(df).collect()}
    sets = {d: shingle_set(t) for d, t in docs}
    # What is in another document to the threshold must be led to a group; what is in none must not.
    want = {q for q, a in sets.items() for x, b in sets.items() if q != x and a and (len(b), -x) > (len(a), -q) and len(a & b) >= neardup.T * len(a)}
    gone = {d for d, r in found.items() if not r.kept}
    assert gone <= want and len(gone & want) >= 0.9 * len(want)
    for d in gone:
        a, b = sets[d], sets[found[d].contained_in]
        assert len(a & b) >= neardup.T * len(a) - 1e-9
    kept = {r.doc_id for r in neardup.keep_one(df).collect()}
    assert kept == set(sets) - gone


def test_banding_meets_its_recall():
    for d, (bands, rows) in neardup.ensemble().items():
        j = neardup.jaccard(neardup.T, 2.0 ** (d + 1))
        if bands < neardup.HASHES:
            assert 1 - (1 - j**rows) ** bands >= neardup.RECALL - 1e-9


def test_edges(spark):
    kept = neardup.keep_one(edges.documents(spark))
    assert kept.columns == edges.documents(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 2, 3, 4, 5, 7, 8, None]
    assert neardup.keep_one(edges.empty(spark)).count() == 0
    assert neardup.groups(edges.empty(spark)).count() == 0


def test_short_documents_within_long_ones(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    docs = []
    for k in range(60):
        short = [r.choice(words) for _ in range(80)]
        long = [r.choice(words) for _ in range(80 * (12, 25, 45, 90, 175)[k % 5])]
        docs += [(2 * k, " ".join(short)), (2 * k + 1, " ".join(long[:500] + short + long[500:]))]
    gone = {r.doc_id for r in neardup.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect() if not r.kept}
    assert all(d % 2 == 0 for d in gone)
    for at in range(5):
        assert sum(2 * k in gone for k in range(at, 60, 5)) >= 11


def test_containers_among_documents_that_share_passages(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    passages = [some(36) for _ in range(20)]
    docs = []
    for k in range(40):
        shared = passages[k % 20] + passages[(k % 20 + 1 + k // 20) % 20]
        docs += [(2 * k, " ".join(shared + some(16))), (2 * k + 1, " ".join(some(150) + shared + some(150)))]
    for k in range(300):
        a, b = r.sample(passages, 2)
        docs.append((1000 + k, " ".join(some(200 + k) + a + some(20) + b)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # Some of the 300 hold the same two passages, and so are containers too.
    gone = {x.doc_id for x in neardup.groups(df).collect() if not x.kept}
    assert sum(2 * k in gone for k in range(40)) >= 38
    found = {(x.q, x.x) for x in neardup.sought(neardup.index(neardup.one_row(df), len(docs))).collect()}
    assert sum((2 * k, 2 * k + 1) in found for k in range(40)) >= 38


def test_a_doc_id_with_several_texts(spark):
    r = random.Random(9)
    some = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c = some(60), some(90), some(40)
    docs = [(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (5, c + " " + some(20)), (6, some(50))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x for x in neardup.groups(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and len(got) == 5
    # Document 1 is both its texts, and holds 2 and 3 whole.
    assert {d: x.group_id for d, x in got.items()} == {1: 1, 2: 1, 3: 1, 4: 5, 5: 5}
    assert all(x.containment == 1.0 for d, x in got.items() if d in (2, 3, 4))
    assert sorted(x.doc_id for x in neardup.keep_one(df).collect()) == [1, 5, 6]
