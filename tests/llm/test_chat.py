import random

import pytest
from loomfield.llm import chat, pieces
from loomfield.llm.common import tokenizer

SCHEMA = "conv_id long, turn long, role string, text string, node string, start string, n string"


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.load(tokenizer("piece_bpe_32k.model"))


def brute(rows, model):
    """Each conversation's tokens, and how many tokens a tree of its first turn has."""
    enc = pieces.Encoder(model)
    import numpy as np

    def ids(role, text):
        raw = np.frombuffer(f"{role or ''}\n{text or ''}".encode(), np.uint8)
        return [*enc.encode(raw, np.array([0, len(raw)])).ids.tolist(), chat.CLOSE]

    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, set()).add(((turn is None, turn or 0), role or "", text or ""))
    paths = {c: [(r, t) for _, r, t in sorted(x)] for c, x in convs.items()}
    flat = {c: [i for r, t in p for i in ids(r, t)] for c, p in paths.items()}
    nodes = {tuple(p[: k + 1]) for p in paths.values() for k in range(len(p))}
    return flat, nodes


def test_trees_against_brute_force(spark, model):
    r = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(r.randint(1, 5)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {r.randint(0, 1 if t < 2 else 3)}", "x", "x", "x"))
    rows += [rows[0], (None, 0, "user", "lost", "x", "x", "x"), (100, None, None, None, "x", "x", "x"), (101, 0, "user", "", "x", "x", "x"), (101, 0, "user", "tie", "x", "x", "x")]
    flat, nodes = brute(rows, model)
    out = chat.trees(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(out) == len(nodes)
    trees = {}
    for n in out:
        trees.setdefault(n.tree, []).append(n)
    seen = {}
    for tree in trees.values():
        tree.sort(key=lambda n: n.start)
        packed = []
        for n in tree:
            assert n.start == len(packed) and len(n.ids) == n.n
            packed += list(n.ids)
        at = {n.node: n for n in tree}
        for n in tree:
            before = [packed[i] for a in n.attends for i in range(a.start, a.end)]
            assert len(before) == n.position
            if n.parent:
                p = at[n.parent]
                assert p.start < n.start and n.position == p.position + p.n and n.depth == p.depth + 1
            for c in n.conversations:
                seen[c] = before + list(n.ids)
    assert seen == flat


def test_edges(spark, model):
    assert chat.trees(spark.createDataFrame([], SCHEMA), model).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "x " * 30_000, "", "", ""), (2, 0, "user", "x " * 30_000, "", "", "")], SCHEMA)
    (row,) = chat.trees(long, model).collect()
    assert sorted(row.conversations) == [1, 2]


def whole(out):
    """Conversations by their tokens, as the nodes' intervals give them back."""
    trees, seen = {}, {}
    for n in out:
        trees.setdefault(n.tree, []).append(n)
    for tree in trees.values():
        main = sorted((n for n in tree if n.part == 0), key=lambda n: n.start)
        packed = [i for n in main for i in n.ids]
        before = {n.node: [packed[i] for a in n.attends for i in range(a.start, a.end)] + list(n.ids) for n in main}
        assert all(len(before[n.node]) == n.position + n.n for n in main) and [n.start for n in main] == [sum(m.n for m in main[:k]) for k in range(len(main))]
        for n in tree:
            for c in n.conversations:
                assert c not in seen
                seen[c] = before[n.node]
            assert all(a.end < b.start for a, b in zip(n.attends, n.attends[1:]))
    return seen


def test_long_paths_hot_turns_and_many_ends(spark, model, monkeypatch):
    monkeypatch.setattr(chat, "ENDS", 4)
    r = random.Random(8)
    rows = []
    for c in range(120):  # a third and more share the first turn, many are alike
        path = ["hello"] + [f"a{r.randint(0, 1)}" for _ in range(r.randint(0, 3))] if c % 3 else [f"own {c % 7}"]
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", t, "", "", "") for k, t in enumerate(path)]
    for c in range(40):  # each leaves the path of the one before at another place, up and down
        rows += [(200 + c, k, "user", f"s{k}" if k < 40 - c else f"t{c} {k}", "", "", "") for k in range(60)]
    for c in range(40):
        rows += [(300 + c, k, "user", f"u{k}" if k < 5 + c else f"v{c} {k}", "", "", "") for k in range(60)]
    flat, nodes = brute(rows, model)
    out = chat.trees(spark.createDataFrame(rows, SCHEMA).repartition(5), model).collect()
    assert sum(n.part == 0 for n in out) == len(nodes) and any(n.part for n in out)
    assert whole(out) == flat
