"""Operator 8: encoding over a piece lattice with the N best segmentations, and decoding.

A SentencePiece model gives pieces and scores: those of a unigram model are log probabilities and
taken as they are; a merge model has ranks, which become Zipf log probabilities, -ln(rank + ZIPF).
The lattice of a text has an arc for each piece that matches somewhere, and for a character that is
no piece an arc that is written as its UTF-8 bytes.

A lattice falls apart between two characters that stand side by side in no piece. Each of these parts
is solved once for each slice of texts: a forward Viterbi pass in numpy over all parts at a time gives the best
segmentation and by how much the second best is worse. A text's N best segmentations differ from the best
only in the N - 1 parts of least gap; on these runs a backward A-star search with
the forward scores as exact heuristic, and the parts' lists are merged best first. So the result
is that of a search over the whole text's lattice, whatever its length.

Alternatives are edits of the best ids: at, drop and ids, with `at` counted in the best ids. Equal scores
stand in the order in which they are found; the set of scores is exact. Decoding joins the pieces' bytes. Null and empty texts have no ids, no
alternatives and score 0. A model's normaliser is applied first, and its dummy prefix is as the model says; decoding then gives the normalised text. A text's U+2581 counts as the blank it stands for, so it decodes as a blank. Repeated rows each get their result; extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textvec as tv
from .common import lean, texts

#: Added to the rank of a merge model's piece.
ZIPF = 10.0
N_BEST = 4
SPACE = 0x2581
#: Longest part that is solved in numpy; the longer ones, without a place to split, one by one.
WIDTHS = (4, 8, 12, 16, 24, 32)
#: Bytes of text encoded at a time: some hundred bytes of memory for each.
SLICE = 3 << 18
#: Different parts from which on a worker remembers no more, some 60 bytes each.
KNOWN = 300_000

ENCODED = "doc_id long, ids array<int>, n_tokens int, score double, alternatives array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>, round_trip boolean"
_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_ALTERNATIVE = pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))])
_P = tv.U(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """What encoding needs of a model; as large as its vocabulary, so it travels with the tasks."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int]
    size: int
    prefix: bool = True
    #: The model, if its normaliser changes texts, and whether it squeezes blanks.
    rules: tuple[bytes, bool] | None = None

    @staticmethod
    def load(path: str, zipf: float | None = None) -> Pieces:
        import sentencepiece

        with open(path, "rb") as f:
            proto = f.read()
        spec: dict[int, int | bytes] = {}
        for field, value in _fields(proto):
            if field == 3 and isinstance(value, bytes):
                spec |= dict(_fields(value))
        squeeze = bool(spec.get(4, 1))
        rules = (proto, squeeze) if squeeze or spec.get(2) else None
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        bytes_ = [-1] * 256
        normal = []
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                bytes_[int(text[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((text, i, float(sp.get_score(i))))
        whole = all(s == int(s) and s <= 0 for _, _, s in normal)
        if zipf is None and whole:
            zipf = ZIPF
        if zipf is not None:
            normal = [(t, i, -float(np.log(-s + zipf))) for t, i, s in normal]
        unknown = next((i for i in range(n) if sp.is_unknown(i)), 0)
        return Pieces(normal, [unknown if x < 0 else x for x in bytes_], n, bool(spec.get(3, 1)), rules)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


class Encoder:
    """Lookup tables of the pieces; made once in each worker."""

    def __init__(self, model: Pieces) -> None:
        self.model = model
        texts_ = [t for t, _, _ in model.pieces]
        self.score = np.array([s for _, _, s in model.pieces])
        self.id = np.array([i for _, i, _ in model.pieces], np.int32)
        self.unknown = float(self.score.min(initial=0.0)) - 10.0
        self.longest = max(map(len, texts_), default=1)
        self.dict = {t: k for k, t in enumerate(texts_)}
        key = np.array([_hash_of(t) for t in texts_], tv.U)
        order = np.argsort(key)
        self.key, self.of = key[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(key >> tv.U(42)).astype(np.int64)] = True
        chars = sorted({c for t in texts_ if len(t) > 1 for c in t})
        self.cls = np.zeros(0x110000, np.uint16)
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.pair = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        at = {c: k + 1 for k, c in enumerate(chars)}
        for t in texts_:
            for a, b in zip(t, t[1:], strict=False):
                self.pair[at[a], at[b]] = True
        raw: list[bytes] = [b""] * model.size
        for t, i, _ in model.pieces:
            raw[i] = t.replace("▁", " ").encode()
        for b, i in enumerate(model.byte_ids):
            if not raw[i]:
                raw[i] = bytes([b]) if model.byte_ids.count(i) == 1 else b""
        self.bytes_len = np.array([len(x) for x in raw], np.int64)
        self.bytes_at = np.cumsum(self.bytes_len) - self.bytes_len
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.byte_ids = np.array(model.byte_ids, np.int32)
        self.known = _nothing()
        self.normaliser = None
        if model.rules:
            import sentencepiece

            proto, squeeze = model.rules
            self.normaliser = sentencepiece.SentencePieceNormalizer(model_proto=proto, add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=squeeze)

    def prepared(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts as the model's normaliser leaves them."""
        if self.normaliser is None:
            return raw, off
        data = raw.tobytes()
        rows = [self.normaliser.normalize(data[a:b].decode()).replace("▁", " ").encode() for a, b in zip(off, off[1:], strict=False)]
        return np.frombuffer(b"".join(rows), np.uint8), np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]

    def forward(self, s: str) -> list[list[tuple[int, float]]]:
        """Arcs (start, piece or -1, score) into each place of s."""
        arcs: list[list] = [[] for _ in range(len(s) + 1)]
        for j in range(len(s)):
            single = False
            for i in range(j + 1, min(len(s), j + self.longest) + 1):
                k = self.dict.get(s[j:i])
                if k is not None:
                    arcs[i].append((j, k, float(self.score[k])))
                    single |= i == j + 1
            if not single:
                arcs[j + 1].append((j, -1, self.unknown))
        return arcs

    def nbest(self, s: str, n: int) -> list[tuple[float, list[tuple[int, int, int]]]]:
        """Scores and arcs (start, end, piece) of the n best segmentations: backward A-star with the forward Viterbi scores as heuristic."""
        arcs = self.forward(s)
        best = [0.0] + [-np.inf] * len(s)
        for i in range(1, len(s) + 1):
            for j, _, w in arcs[i]:
                best[i] = max(best[i], best[j] + w)
        # Scores that are equal but for rounding go deepest first: breadth first their number would grow exponentially.
        out = []
        serial = 0
        heap = [(round(-best[-1], 6), len(s), 0, 0.0, None)]
        while heap and len(out) < n:
            _, i, _, g, path = heapq.heappop(heap)
            if i == 0:
                steps = []
                while path:
                    step, path = path
                    steps.append(step)
                out.append((g, steps))
                continue
            for j, k, w in arcs[i]:
                serial += 1
                heapq.heappush(heap, (round(-(g + w + best[j]), 6), j, serial, g + w, ((j, i, k), path)))
        return out

    def emit(self, s: str, steps: list[tuple[int, int, int]]) -> list[int]:
        out: list[int] = []
        for j, i, k in steps:
            if k >= 0:
                out.append(int(self.id[k]))
            else:
                out += [self.model.byte_ids[b] for b in s[j:i].encode()]
        return out

    def _long(self, s: str) -> tuple[float, float, list[int]]:
        """Best and second best score, and the best ids, of one long part."""
        n = len(s)
        best, second = [0.0] + [-np.inf] * n, [-np.inf] * (n + 1)
        back: list = [None] * (n + 1)
        for i, into in enumerate(self.forward(s)):
            for j, k, w in into:
                c1, c2 = best[j] + w, second[j] + w
                second[i] = max(second[i], min(best[i], c1), c2)
                if c1 > best[i]:
                    best[i], back[i] = c1, (j, i, k)
        steps, i = [], n
        while i:
            steps.append(back[i])
            i = back[i][0]
        return best[n], second[n], self.emit(s, steps[::-1])

    def solve(self, u: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the parts u[start:start + size]: best score, gap to the second best, ids of all in a row, how many ids each has."""
        n = len(start)
        top, gap, count = np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > low) & (size <= width))
            low = width
            for at in range(0, len(rows), 65_536):
                r = rows[at : at + 65_536]
                top[r], gap[r], flat, counts = self._block(u, start[r], size[r], width)
                count[r] = counts
                held.append((r, flat, counts))
        for k in np.flatnonzero(size > low):
            s = u[start[k] : start[k] + size[k]].astype("<u4").tobytes().decode("utf-32-le")
            top[k], second, ids = self._long(s)
            gap[k], count[k] = top[k] - second, len(ids)
            held.append((np.array([k]), np.array(ids, np.int32), np.array([len(ids)])))
        at = np.cumsum(count) - count
        ids = np.empty(int(count.sum()), np.int32)
        for r, flat, counts in held:
            ids[np.repeat(at[r] - (np.cumsum(counts) - counts), counts) + np.arange(len(flat))] = flat
        return top, gap, ids, count

    def solved(self, h: np.ndarray, u: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """What `solve` gives of parts with different hashes h, in order, and where each one's ids begin; parts of texts before are remembered, up to KNOWN."""
        key, known, ids = self.known
        slot = np.minimum(np.searchsorted(key, h), max(0, len(key) - 1))
        new = key[slot] != h if len(key) else np.ones(len(h), bool)
        out = np.empty((4, len(h)))
        out[:, ~new] = known[:, slot[~new]]
        if new.any():
            top, gap, more, count = self.solve(u, start[new], size[new])
            out[:, new] = top, gap, count, np.cumsum(count) - count + len(ids)
            ids = np.r_[ids, more]
            if len(key) < KNOWN:
                order = np.argsort(np.r_[key, h[new]], kind="stable")
                self.known = np.r_[key, h[new]][order], np.concatenate([known, out[:, new]], axis=1)[:, order], ids
        top, gap, count, base = out
        return top, gap, ids, base.astype(np.int64), count.astype(np.int64)

    def _block(self, u: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(start)
        col = np.arange(width)[:, None]
        code = np.where(col < size, u[np.minimum(start + col, len(u) - 1)], 0).astype(tv.U)  # width x n
        best, second = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        best[0] = 0.0
        came, piece = np.zeros((width + 1, n), np.int8), np.zeros((width + 1, n), np.int32)
        for j in range(width):
            live = np.flatnonzero(size > j)
            h = np.zeros(len(live), tv.U)
            for m in range(1, min(self.longest, width - j) + 1):
                if m > 1:
                    stay = size[live] >= j + m
                    live, h = live[stay], h[stay]
                    if not len(live):
                        break
                h = _step(h, code[j + m - 1, live])
                some = np.flatnonzero(self.maybe[(h >> tv.U(42)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(self.key, h[some]), len(self.key) - 1)
                hit = self.key[slot] == h[some]
                rows, k = live[some[hit]], self.of[slot[hit]]
                weight = self.score[k]
                if m == 1:
                    without = np.ones(len(live), bool)
                    without[some[hit]] = False
                    extra = live[without]
                    if len(extra):
                        rows = np.r_[rows, extra]
                        k = np.r_[k, np.full(len(extra), -1, np.int32)]
                        weight = np.r_[weight, np.full(len(extra), self.unknown)]
                if not len(rows):
                    continue
                c1, old = best[j, rows] + weight, best[j + m, rows]
                second[j + m, rows] = np.maximum(np.maximum(second[j + m, rows], np.minimum(old, c1)), second[j, rows] + weight)
                up = c1 > old
                won = rows[up]
                best[j + m, won], came[j + m, won], piece[j + m, won] = c1[up], m, k[up]
        each = np.arange(n)
        steps = np.zeros((width, n), np.int32)
        used = np.zeros(n, np.int64)
        place = size.astype(np.int64).copy()
        while True:
            live = np.flatnonzero(place > 0)
            if not len(live):
                break
            k = piece[place[live], live]
            unk = k < 0
            steps[used[live], live] = np.where(unk, -code[place[live] - 1, live].astype(np.int64) - 1, self.id[k])
            used[live] += 1
            place[live] -= came[place[live], live]
        total, after = best[size, each], second[size, each]
        flat = steps.T[:, ::-1][np.arange(width)[None, ::-1] < used[:, None]]  # each row's steps, the last found first
        if (flat < 0).any():
            owner = np.repeat(each, used)
            code_of = -(flat.astype(np.int64)) - 1
            parts = [x for t, c in zip(flat.tolist(), code_of.tolist(), strict=True) for x in ((t,) if t >= 0 else [self.model.byte_ids[b] for b in chr(c).encode()])]
            lens = np.where(flat >= 0, 1, 1 + (code_of >= 0x80) + (code_of >= 0x800) + (code_of >= 0x10000))
            used = np.bincount(owner, weights=lens, minlength=n).astype(np.int64)
            flat = np.array(parts, np.int32)
        return total, total - after, flat, used

    def parts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all rows, blanks as U+2581 and one before each row that isn't empty; where parts start; rows' offsets in code points."""
        u = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        at = lead[off]
        if self.model.prefix:
            some = np.flatnonzero(np.diff(at) > 0)
            u = np.insert(u, at[some], 0x20)
            at = at + np.r_[0, np.cumsum(np.diff(at) > 0)]
        u = np.where(u == 0x20, np.uint32(SPACE), u)
        c = self.cls[u]
        new = np.ones(len(u), bool)
        if len(u) > 1:
            new[1:] = ~self.pair[c[:-1], c[1:]]
        new[at[:-1][at[:-1] < len(u)]] = True
        return u, np.flatnonzero(new), at

    def encode(self, raw: np.ndarray, off: np.ndarray) -> Encoded:
        raw, off = self.prepared(raw, off)
        u, start, at = self.parts(raw, off)
        size = np.diff(np.r_[start, len(u)])
        x = tv.mix(u.astype(tv.U) + tv.U(1))
        up, down = tv._tables(len(u) + 1)
        total = np.zeros(len(u) + 1, tv.U)
        np.cumsum(x * up[: len(u)], out=total[1:])
        h = tv.mix((total[start + size] - total[start]) * down[start] + size.astype(tv.U))
        h, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        top, gap, ids, base, count = self.solved(h, u, start[first], size[first])
        lens = count[inverse]
        begin = np.cumsum(lens) - lens
        flat = ids[np.repeat(base[inverse] - begin, lens) + np.arange(int(lens.sum()))]
        row = np.searchsorted(start, at)  # first part of each row
        return Encoded(u, start, size, row, first, inverse, top, gap, flat, np.r_[begin, len(flat)], count)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the offset of each id's bytes in them."""
        lens = self.bytes_len[ids]
        to = np.r_[0, np.cumsum(lens)]
        return self.bytes[np.repeat(self.bytes_at[ids] - to[:-1], lens) + np.arange(to[-1])], to


@dataclass
class Encoded:
    u: np.ndarray
    start: np.ndarray
    size: np.ndarray
    row: np.ndarray
    first: np.ndarray
    inverse: np.ndarray
    top: np.ndarray
    gap: np.ndarray
    ids: np.ndarray
    begin: np.ndarray
    count: np.ndarray

    def offsets(self) -> np.ndarray:
        return self.begin[self.row]

    def scores(self) -> np.ndarray:
        out = np.zeros(len(self.row) - 1)
        some = np.flatnonzero(np.diff(self.row) > 0)
        if len(some):
            # Summed row by row, so that a text's score doesn't depend on those beside it.
            out[some] = np.add.reduceat(self.top[self.inverse], self.row[some])
        return out

    def text(self, part: int) -> str:
        return self.u[self.start[part] : self.start[part] + self.size[part]].tobytes().decode("utf-32-le")


def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of known parts; their score, gap, number of ids and place in the ids; the ids."""
    return np.zeros(0, tv.U), np.zeros((4, 0)), np.zeros(0, np.int32)


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h + c + tv.U(1)) * _P
    return h ^ (h >> tv.U(29))


def _hash_of(t: str) -> int:
    h = np.zeros(1, tv.U)
    for c in t:
        h = _step(h, np.array([ord(c)], tv.U))
    return int(h[0])


def alternatives(enc: Encoder, e: Encoded, n: int, known: dict) -> list[list[dict]]:
    """For each row its next best n - 1 segmentations."""
    rows = len(e.row) - 1
    out: list[list[dict]] = [[] for _ in range(rows)]
    if n < 2 or not len(e.start):
        return out
    owner = np.repeat(np.arange(rows), np.diff(e.row))
    gap = e.gap[e.inverse]
    can = np.flatnonzero(np.isfinite(gap))
    order = can[np.lexsort((can, gap[can], owner[can]))]
    of = owner[order]
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    order = order[nth < n - 1]
    split = np.searchsorted(owner[order], np.arange(rows + 1))
    score = e.scores()
    for r in range(rows):
        lists = []
        for part in order[split[r] : split[r + 1]].tolist():
            s = e.text(part)
            found = known.get(s)
            if found is None:
                if len(known) > 200_000:
                    known.clear()
                found = known[s] = [(g, enc.emit(s, steps)) for g, steps in enc.nbest(s, n)]
            lists.append((part, found))
        if not lists:
            continue
        # Best first over one choice a part; a successor raises a part not before the last one raised, so that none is made twice.
        start = (0,) * len(lists)
        heap = [(0.0, start, 0)]
        while heap and len(out[r]) < n - 1:
            cost, choice, last = heapq.heappop(heap)
            if choice != start:
                edits = [{"at": int(e.begin[p] - e.begin[e.row[r]]), "drop": int(e.begin[p + 1] - e.begin[p]), "ids": f[c][1]} for (p, f), c in zip(lists, choice, strict=True) if c]
                out[r].append({"score": float(score[r]) - cost, "edits": sorted(edits, key=lambda x: x["at"])})
            for k in range(last, len(lists)):
                f = lists[k][1]
                if choice[k] + 1 < len(f):
                    heapq.heappush(heap, (cost + f[choice[k]][0] - f[choice[k] + 1][0], (*choice[:k], choice[k] + 1, *choice[k + 1 :]), k))
    return out


_encoders: dict[int, Encoder] = {}


def encoder(model: Pieces) -> Encoder:
    """The encoder of a model, made once in each process."""
    key = hash((model.size, model.prefix, model.rules, tuple(model.byte_ids), tuple(model.pieces)))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(model)
    return _encoders[key]


def _same(enc: Encoder, ids: np.ndarray, at: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows of ids decode to their text."""
    data, to = enc.decode(ids)
    if enc.model.prefix:
        some = np.flatnonzero(np.diff(at) > 0)
        data = np.delete(data, to[at[some]])
        gone = np.r_[0, np.cumsum(np.diff(at) > 0)]
    else:
        gone = np.zeros(len(at), np.int64)
    got = to[at] - gone
    if np.array_equal(got, off) and np.array_equal(data, raw):
        return np.ones(len(off) - 1, bool)
    text = data.tobytes()
    return np.array([text[a:b].replace("▁".encode(), b" ") == raw[c:d].tobytes().replace("▁".encode(), b" ") for a, b, c, d in zip(got, got[1:], off, off[1:], strict=False)], bool)


def encode(docs: DataFrame, model: Pieces, n: int = N_BEST) -> DataFrame:
    """ENCODED for each document: the best ids, the further n - 1 segmentations as edits of them, and whether the ids decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = encoder(model), {}
        for batch in batches:
            raw_all, off_all = tv.strings(batch.column(1))
            for lo, hi in tv.slices(off_all, SLICE):
                raw, off = enc.prepared(raw_all[off_all[lo] : off_all[hi]], off_all[lo : hi + 1] - off_all[lo])
                e = enc.encode(raw, off)
                at = e.offsets()
                other = alternatives(enc, e, n, known)
                cols = [
                    batch.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(e.ids)),
                    pa.array(np.diff(at).astype(np.int32)),
                    pa.array(e.scores()),
                    pa.array(other, pa.list_(_ALTERNATIVE)),
                    pa.array(_same(enc, e.ids, at, raw, off)),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "score", "alternatives", "round_trip"])

    return texts(docs).mapInArrow(lean(run), ENCODED)


def decode(encoded: DataFrame, model: Pieces) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text, ids outside the vocabulary nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                x = np.array([i for i in ids or [] if i is not None and 0 <= i < model.size], np.int64)
                s = enc.decode(x)[0].tobytes().decode(errors="replace")
                out.append(s[1:] if model.prefix and s.startswith(" ") else s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The ids of an alternative."""
    out, at = [], 0
    for x in edits:
        out += ids[at : x["at"]] + list(x["ids"])
        at = x["at"] + x["drop"]
    return out + ids[at:]
