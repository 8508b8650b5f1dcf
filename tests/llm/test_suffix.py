import collections
import random

import edges
import numpy as np
import pytest
from loomfield.llm import suffix as x
from loomfield.llm import textvec as tv


def hashes(text):
    raw = (text or "").encode()
    return tv.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).h.tolist()


def brute(docs):
    """Words of repeated windows, words to be removed, and whether another document has some, by document."""
    where = collections.defaultdict(list)
    for d, t in sorted(docs.items()):
        h = hashes(t)
        for i in range(len(h) - x.LEAST + 1):
            where[tuple(h[i : i + x.LEAST])].append((d, i))
    repeats, stays, across = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(bool)
    for places in where.values():
        if len(places) > 1:
            first = min(places)
            for d, i in places:
                repeats[d].update(range(i, i + x.LEAST))
                across[d] |= any(e != d for e, _ in places)
            stays[first[0]].update(range(first[1], first[1] + x.LEAST))
    return {d: (w, w - stays[d], across[d]) for d, w in repeats.items()}, where


def found(spark, docs):
    span = lambda s: {i for p in s for i in range(p.begin, p.end)}
    rows = x.passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)).collect()
    assert all(r.repeated_words == len(span(r.repeats)) for r in rows) and len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (span(r.repeats), span(r.removable), r.across) for r in rows}


def compare(spark, docs):
    want, _ = brute(docs)
    assert found(spark, docs) == want


def test_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    compare(spark, docs)


def near_the_threshold():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    docs, k = {}, 0
    for n in [*range(46, 56), 64, 65, 66, 90, 200]:
        passage = some(n)
        for _ in range(3):
            docs[k] = " ".join(some(r.randint(0, 40)) + passage + some(r.randint(0, 40)))
            k += 1
        docs[k] = " ".join(passage)
        docs[k + 1] = " ".join(some(5) + passage + some(30) + passage + some(7))  # twice in one document
        k += 2
        alone = some(n)
        docs[k] = " ".join(alone + some(20) + alone)  # in no other
        k += 1
    docs[k] = "same " * 300
    docs[k + 1] = "other " + "same " * 120
    docs[k + 2] = "one two " * 80
    return docs


def test_lengths_about_the_threshold_and_repeats_within_documents(spark):
    compare(spark, near_the_threshold())


def test_small_blocks_parts_and_chunks(spark, monkeypatch):
    """Ranks that go on over many parts of the order and over many pieces of a part."""
    docs = near_the_threshold() | {10_000 + k: "the same licence text over and over again " * 12 for k in range(40)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    monkeypatch.setattr(x, "BLOCK", 500)
    monkeypatch.setattr(x, "ROWS", 7)
    monkeypatch.setattr(x, "BUCKET_ROWS", 900)
    try:
        for parts in ("23", "3"):
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            compare(spark, docs)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_ranks_are_an_order_of_the_windows(spark):
    docs = near_the_threshold()
    _, where = brute(docs)
    want = {(d, i): key for key, places in where.items() if len(places) > 1 for d, i in places}
    rows = x.suffixes(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.place) for r in rows} == set(want)
    words = collections.defaultdict(set)
    for r in rows:
        words[r["rank"]].add(want[r.doc_id, r.place])
    assert all(len(w) == 1 for w in words.values()) and len({next(iter(w)) for w in words.values()}) == len(words)
    assert sorted(words) == list(range(len(words)))


def test_offsets_reach_the_threshold():
    assert all(sum(x.offsets(g)) + g == x.LEAST for g in range(1, x.LEAST))
    assert x.offsets(1) == [1, 2, 4, 8, 16, 18]


@pytest.mark.parametrize("gram", [1, 8])
def test_shorter_first_ranks_give_the_same(spark, gram, monkeypatch):
    docs = {d: t for d, t in near_the_threshold().items() if d % 3 == 0}
    whole = x.doubled
    monkeypatch.setattr(x, "doubled", lambda d: whole(d, gram))
    compare(spark, docs)


def test_edges(spark):
    out = {r.doc_id: r for r in x.passages(edges.documents(spark)).collect()}
    assert set(out) == {4, 5, 6} and [tuple(p) for p in out[5].removable] == [(67, 72)] and [tuple(p) for p in out[6].removable] == [(0, 72)]
    assert not out[4].across and out[5].across and out[6].across
    assert x.passages(edges.empty(spark)).count() == 0


def test_suffixes_are_packed_and_no_shuffle_files_stay(spark, monkeypatch):
    """Tables between the rounds hold pieces, not a row for each suffix, and hand on no more than what is left."""
    rows, stored = [], x.materialise

    def counted(df):
        out = stored(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(x, "materialise", counted)
    docs = {k: " ".join(f"word{i}" for i in range(3000)) for k in range(6)}
    got = found(spark, docs)
    assert len(rows) == 1 + len(x.offsets()) and max(rows) < 200
    assert all(len(got[k][0]) == 3000 and len(got[k][1]) == (3000 if k else 0) for k in docs)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_parts_of_the_order_are_those_of_a_plain_sort():
    """Cuts within one pair of ranks, too."""
    r = random.Random(3)
    rows = sorted({(r.randint(0, 3), r.randint(0, 2), r.randint(-4, 9), r.randint(0, 99)) for _ in range(2000)})
    cuts = sorted(r.sample(rows, 40))
    columns = lambda t: tuple(np.array(c, k) for c, k in zip(zip(*t, strict=True), (tv.U, tv.U, np.int64, np.int64), strict=True))
    assert x._part(columns(rows), columns(cuts)).tolist() == [sum(c <= row for c in cuts) for row in rows]
