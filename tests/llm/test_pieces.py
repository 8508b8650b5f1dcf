import itertools

import edges
import numpy as np
import pytest
from loomfield.llm import pieces as x
from loomfield.llm.common import tokenizer

VOCABULARY = [("▁", -3.0), ("a", -4.0), ("b", -4.5), ("c", -5.0), ("▁a", -3.5), ("ab", -4.2), ("bc", -4.1), ("abc", -5.5), ("▁ab", -4.4), ("cab", -6.0), ("é", -7.0), ("ca", -5.1)]


def small():
    normal = [(t, i + 3, s) for i, (t, s) in enumerate(VOCABULARY)]
    return x.Pieces(normal, list(range(100, 356)), 400)


def every(text, model):
    """Scores and ids of all segmentations."""
    s = "▁" + text.replace(" ", "▁")
    by = {t: (i, w) for t, i, w in model.pieces}
    low = min(w for _, _, w in model.pieces) - 10
    out = []

    def go(at, ids, score):
        if at == len(s):
            out.append((score, tuple(ids)))
            return
        for end in range(at + 1, len(s) + 1):
            if s[at:end] in by:
                i, w = by[s[at:end]]
                go(end, [*ids, i], score + w)
        if s[at] not in by:
            go(at + 1, ids + [100 + b for b in s[at].encode()], score + low)

    go(0, [], 0.0)
    return sorted(out, reverse=True)


def test_n_best_against_all_segmentations(spark):
    texts = ["abcab", "a b c abc", "cabcab abc", "x", "aéb", "☃a", "abcabcab", "  ab"] + ["".join(p) for p in itertools.product("ab c", repeat=4)]
    model = small()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in x.encode(df, model, 5).collect():
        want = every(texts[r.doc_id], model)
        got = [(r.score, tuple(r.ids))] + [(a.score, tuple(x.apply_edits(list(r.ids), [e.asDict() for e in a.edits]))) for a in r.alternatives]
        assert np.allclose([s for s, _ in got], [s for s, _ in want[:5]])
        assert len({i for _, i in got}) == len(got)
        known = {i: s for s, i in want}
        assert all(abs(known[i] - s) < 1e-9 for s, i in got)
        assert r.round_trip


def test_against_the_library_on_a_unigram_model(spark, tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = pb.ModelProto()
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=name, score=0.0, type=kind)
    for t, s in VOCABULARY:
        m.pieces.add(piece=t, score=s + 0.013, type=1)
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["abcab", "a b c abc", "cabcab abc bc", "aéb ab"]
    got = x.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), x.Pieces.load(str(path)), 3).collect()
    for r in got:
        assert list(r.ids) == sp.encode(texts[r.doc_id])
        both = [list(r.ids)] + [x.apply_edits(list(r.ids), [e.asDict() for e in a.edits]) for a in r.alternatives]
        assert sorted(both) == sorted(sp.nbest_encode_as_ids(texts[r.doc_id], len(both)))


def test_long_parts_are_solved_alike():
    model = small()
    enc = x.Encoder(model)
    text = "abcab" * 9
    raw = np.frombuffer(text.encode(), np.uint8)
    e = enc.encode(raw, np.array([0, len(raw)]))
    best = enc.nbest("▁" + text, 2)
    assert abs(float(e.scores()[0]) - best[0][0]) < 1e-9 and abs(float(e.gap[e.inverse].min()) - (best[0][0] - best[1][0])) < 1e-9


def test_edges(spark):
    model = x.Pieces.load(tokenizer("piece_bpe_32k.model"))
    docs = edges.documents(spark)
    out = x.encode(docs, model)
    rows = out.collect()
    assert len(rows) == docs.count() - 1 and all(r.round_trip for r in rows)
    empty = [r for r in rows if r.doc_id in (1, 2)]
    assert all(list(r.ids) == [] and r.score == 0 and list(r.alternatives) == [] for r in empty)
    text = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    for r in x.decode(out, model).collect():
        assert r.text == (text[r.doc_id] or "").replace("▁", " ")
    assert x.encode(edges.empty(spark), model).count() == 0


def test_a_normaliser_and_no_prefix(spark, tmp_path):
    """The given model with another normaliser: no dummy prefix, blanks squeezed."""
    with open(tokenizer("piece_bpe_32k.model"), "rb") as f:
        proto = f.read()
    path = tmp_path / "m.model"
    path.write_bytes(proto + bytes([0x1A, 4, 0x18, 0, 0x20, 1]))
    model = x.Pieces.load(str(path))
    assert not model.prefix and model.rules is not None
    texts = ["  two  blanks and   more ", "plain text", "", "   ", "é  ünï"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = x.encode(df, model)
    assert all(r.round_trip for r in coded.collect())
    back = {r.doc_id: r.text for r in x.decode(coded, model).collect()}
    assert [back[k] for k in range(5)] == ["two blanks and more", "plain text", "", "", "é ünï"]
    same = x.Pieces.load(tokenizer("piece_bpe_32k.model"))
    assert same.prefix and same.rules is None
