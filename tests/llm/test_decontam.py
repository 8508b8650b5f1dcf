import random

import edges
import numpy as np
from loomfield.llm import decontam as x
from loomfield.llm import textvec as tv


def words(r, n):
    return ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(n)]


def fixture():
    r = random.Random(1)
    vocabulary = words(r, 2500)
    common = ["the", "of", "and", "to", "in", "is"]
    text = lambda n: [r.choice(common) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(n)]
    items = [(k, text(r.randint(16, 60))) for k in range(30)] + [(99, text(100))]
    docs, truth = [], set()
    for d in range(300):
        t = text(r.randint(40, 400))
        if d % 6 == 0:
            k, item = items[d // 6 % len(items)]
            item = list(item)
            for i in range(0, len(item) - 8, 9):  # paraphrase: some words other, the answer kept
                item[i] = r.choice(vocabulary)
            at = r.randint(0, len(t))
            t[at:at] = item
            truth.add((d, k))
        docs.append((d, " ".join(t)))
    return docs, [(k, " ".join(t)) for k, t in items], truth


def test_planted_items_are_found_and_others_left(spark):
    docs, items, truth = fixture()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in x.contaminated(df, bench).collect()}
    assert got <= truth and len(got) >= 0.9 * len(truth)
    kept = {r.doc_id for r in x.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_common_subsequence_against_the_table_method():
    r = random.Random(2)
    space = x.Space(np.random.default_rng(0).standard_normal((x.TERMS, 8)).astype(np.float32))
    text = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    rows = [(0, text(20)), (1, text(64)), (2, text(90))]
    items = x.Items.of(rows, space)
    raw = text(120).encode()
    h = tv.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).h
    total, _ = x.lcs(items, np.arange(3), h, np.array([5, 0, 3]), np.array([60, 120, 118]))
    for k, (lo, hi) in enumerate([(5, 60), (0, 120), (3, 118)]):
        a, b = items.words[k].tolist(), h[lo:hi].tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, u in enumerate(a):
            for j, v in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if u == v else max(t[i, j + 1], t[i + 1, j])
        assert total[k] == t[-1, -1]


def test_edges(spark):
    docs = edges.documents(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "the quick brown"), (3, "a passage that is nowhere to be found in these few documents at all"), (3, "a passage that is nowhere to be found in these few documents at all")], "item_id long, text string")
    assert x.contaminated(docs, bench).count() == 0
    assert x.clean(docs, bench).count() == docs.count() and x.clean(docs, bench).columns == docs.columns
    assert x.contaminated(docs, bench.limit(0)).count() == 0
    assert x.contaminated(edges.empty(spark), bench).count() == 0 and x.clean(edges.empty(spark), bench).count() == 0
    hit = spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog and runs away from the hunters")], "item_id long, text string")
    assert sorted(r.doc_id for r in x.contaminated(docs, hit).collect()) == [5, 6]


def planted(r, items, share, some):
    """Texts with an item of which the answer and so many other words are left that they make up the share."""
    docs = []
    for d, (k, item) in enumerate(items):
        n = len(item) - x.ANSWER
        keep = set(r.sample(range(n), max(0, min(n, round(share * len(item)) - x.ANSWER))))
        t = some(r.randint(40, 300))
        at = r.randint(0, len(t))
        t[at:at] = [w if i in keep or i >= n else some(1)[0] for i, w in enumerate(item)]
        docs.append((d, k, " ".join(t)))
    return docs


def test_retrieval_finds_what_all_windows_would(spark, sf, monkeypatch):
    """Benchmark and corpus as given; items paraphrased to several shares, short ones among them. Held against the same proof over all windows."""
    r = random.Random(7)
    texts = [t.text for t in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if t.text]
    pool = [w for t in texts for w in t.split()[:300]]
    some = lambda n: [r.choice(pool) for _ in range(n)]
    bench = [(b.item_id, b.text.split()) for b in spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.1/benchmark.parquet").collect()]
    bench += [(10_000 + k, some(r.randint(16, 20))) for k in range(60)]
    space = x.fit(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    items = x.Items.of([(k, " ".join(t)) for k, t in bench], space)
    for share in (0.5, 0.6, 0.7):
        docs = planted(r, bench, share, some)
        found = []
        for cosine in (x.COSINE, -2.0):
            monkeypatch.setattr(x, "COSINE", cosine)
            raw = [d[2].encode() for d in docs]
            row, item, *_ = x.search(items, space, tv.words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])]))
            found.append({int(a) for a, b in zip(row, item, strict=True) if items.ids[b] == docs[a][1]})
            monkeypatch.undo()
        assert len(found[0] & found[1]) >= 0.9 * len(found[1]) and len(found[1]) >= 0.9 * len(docs), share


def test_bounds_lose_nothing():
    """Windows that have an item's words to the share that is asked for are let through, whatever else is in them."""
    r = random.Random(3)
    word = lambda: r.choice("abcdefghijklmnopqrstuvw") + r.choice("abcdefgh")
    space = x.Space(np.random.default_rng(0).standard_normal((x.TERMS, 8)).astype(np.float32))
    bench = [(k, [word() for _ in range(r.randint(1, 90))]) for k in range(40)]
    items = x.Items.of([(k, " ".join(t)) for k, t in bench], space)
    hashes = lambda t: tv.words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])).h
    for size, members in items.classes.items():
        bounds = items.bounds(size, 0)
        h = hashes(" ".join(word() for _ in range(8 * 60)))
        may = bounds.may(bounds.number(h).reshape(-1, x.BLOCK), size)
        for b in range(60):
            window = h[b * x.BLOCK : (b + size) * x.BLOCK].tolist()
            for c, k in enumerate(members):
                item = items.words[k].tolist()
                shared = sum(w in item for w in window)
                answer = sum(w in window for w in item[-x.ANSWER :])
                want = shared >= x.VERBATIM * len(item) - 1e-9 or (shared >= x.PARAPHRASE * len(item) - 1e-9 and answer >= min(len(item), x.ANSWER) - 1)
                assert bool(may[b, c]) == want
