"""Operator 6: passages of LEAST words or more that stand more than once, by distributed prefix doubling.

Every place of every text begins a suffix. Its first rank is the hash of its first GRAM words (a number, so an order); each round
pairs the rank of a suffix with that of the suffix at the offset behind it, sorts all pairs by range over the
executors, and gives suffixes of equal pairs the same dense rank in that order. The offset is as long as the prefix that is told apart by then,
and in the last round what is left to LEAST words. Suffixes whose rank is unique are discarded, with those that need them:
no longer prefix of theirs stands twice. What is left at the end are all repeated windows of LEAST words, in order
of their ranks (`suffixes`).

Three things keep this small. Before the first sort, places whose GRAM words stand nowhere else are discarded by an exchange of packed
hashes: a block of some documents sends each distinct hash once, so that a hash of very many places is no hot key. The
order is cut by (pair, doc_id, place), at pairs of some of the documents, so that equal pairs may lie in several parts of the order; the ranks of
the parts are put together by the first and last pair of each part, a few numbers that the driver sees. And suffixes travel packed, a row
for each group of documents and part of the order: Spark moves the rows, each part of at most about ROWS suffixes is sorted in numpy.

`repeats` are the words covered by repeated windows, within one document too; `across`: whether some of them are shared with another document. Of
the same windows the one of least doc_id and place stays, whole: `removable` is what only later ones cover.

Words are those of textvec: case-folded, without punctuation; they are compared by hashes of 64 bits, grams of them by GRAM hashes of 56 bits or more, several of which
cover each window. Rows without doc_id are skipped; null texts are empty; shorter documents have no passage. A doc_id on several rows is one document, of its
distinct texts, sorted and joined. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, lean, materialise, one_row

LEAST, GRAM = 50, 8
#: Words of a block of documents (or of one longer document), entries of a piece that is passed on, and rows of a part of the order.
BLOCK, PIECE, ROWS = 600_000, 100_000, 600_000
#: Groups whose pairs are looked at for the cuts between parts of the order, and pairs of these for each cut.
SAMPLED, CUT_ROWS = 16, 64
#: Bytes of text for each bucket of first hashes, and suffixes for each bucket of documents.
BUCKET_BYTES, BUCKET_ROWS = 2 << 20, 400_000
KEY = 48

PASSAGES = "doc_id long, repeats array<struct<begin:int,end:int>>, removable array<struct<begin:int,end:int>>, repeated_words int, across boolean"
_SENT = "bucket int, block long, kind int, hashes binary, places binary, docs binary, firsts binary"
_PAIR = "part int, a binary, b binary, d binary, p binary"
_RANKED = "bucket int, part int, ranks binary, docs binary, places binary, flags binary"

#: Kinds of rows: grams that a block has once, grams that it has more often, places known to be repeated, and the block's documents.
ONCE, OFTEN, KNOWN, HEAD = range(4)
#: Flags of a suffix in a part of the order: first of its rank, alone in its rank, with another document in its rank.
FIRST, ALONE, BESIDE = 1, 2, 4

#: Rank, rank at the offset, doc_id and place of some suffixes.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def offsets(gram: int = GRAM) -> list[int]:
    """Offsets of the rounds, from prefixes of `gram` words to LEAST."""
    out, reach = [], gram
    while reach < LEAST:
        out.append(min(reach, LEAST - reach))
        reach += out[-1]
    return out


def _thin(x: np.ndarray, width: int) -> bytes:
    """Little-endian integers of `width` bytes."""
    return np.ascontiguousarray(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], gram: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """doc ids, first word of each, gram hashes, and their places, of some documents put one after another."""
    ids, firsts, hashes, places, size = [], [], [], [], 0

    def packed():
        return tuple(np.concatenate(x) for x in (ids, firsts, hashes, places))

    for batch in batches:
        docs = batch.column(0).to_numpy()
        raw, off = tv.strings(batch.column(1))
        for lo, hi in tv.slices(off):
            w = tv.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            g = tv.grams(w.h, gram)
            at = np.flatnonzero(tv.inside(w.first, gram, len(g)))
            ids.append(docs[lo:hi])
            firsts.append(w.first[:-1] + size)
            hashes.append(g[at])
            places.append(at + size)
            size += len(w.h)
            if size >= most:
                yield packed()
                ids, firsts, hashes, places, size = [], [], [], [], 0
    if ids:
        yield packed()


def _send(bits: int, gram: int):
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, firsts, g, place in _blocks(batches, gram, most):
            if not len(g):
                continue
            # The block's name follows its contents, so that a task that runs again gives the same.
            block = int(tv.signed(tv.mix(g.sum(keepdims=True) + tv.mix(ids.astype(tv.U)).sum()))[0])
            g = g >> tv.U(max(0, 64 - KEY - bits))
            key = 64 - bits if bits > 64 - KEY else KEY
            order = np.argsort(g, kind="stable")
            g, place = g[order], place[order]
            new = np.r_[True, g[1:] != g[:-1]]
            alone = new & np.r_[new[1:], True]
            out: list[tuple] = [(block % (1 << bits), HEAD, b"", b"", ids.astype("<i8").tobytes(), firsts.astype("<i8").tobytes())]
            for kind, some in ((ONCE, alone), (OFTEN, new & ~alone)):
                h, p = g[some], place[some]
                bucket = (h >> tv.U(key)).astype(np.int64)
                edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                rest, p = _thin(h & tv.U((1 << key) - 1), 6), _thin(p, 4) if kind == ONCE else b""
                for k in np.flatnonzero(np.diff(edge)).tolist():
                    a, b = int(edge[k]), int(edge[k + 1])
                    out.append((k, kind, rest[6 * a : 6 * b], p[4 * a : 4 * b], b"", b""))
            h, p = g[~alone], place[~alone]
            for k, a in enumerate(range(0, len(h), PIECE)):
                out.append(((block + k) % (1 << bits), KNOWN, h[a : a + PIECE].tobytes(), _thin(p[a : a + PIECE], 4), b"", b""))
            cols = list(zip(*out, strict=True))
            binary = [pa.array(c, pa.binary()) for c in cols[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array(cols[1], pa.int32()), *binary], ["bucket", "block", "kind", "hashes", "places", "docs", "firsts"])

    return run


def _hold(bits: int):
    key = 64 - bits if bits > 64 - KEY else KEY

    def held(group: pa.Table) -> pa.Table:
        """What blocks have of this bucket's grams that stand more than once; other kinds of rows as they are."""
        rows = list(zip(*[group.column(c).to_pylist() for c in ("block", "kind", "hashes", "places", "docs", "firsts")], strict=True))
        kept = [r for r in rows if r[1] in (KNOWN, HEAD)]
        # Those that have places, of which some are kept, come first.
        sent = sorted((r for r in rows if r[1] in (ONCE, OFTEN)), key=lambda r: r[1])
        if sent:
            g = _wide(b"".join(r[2] for r in sent), 6)
            order = np.argsort(g, kind="stable")
            s = g[order]
            same = np.r_[False, s[1:] == s[:-1]]
            twice = np.zeros(len(g), bool)
            twice[order] = same | np.r_[same[1:], False]
            p = _wide(b"".join(r[3] for r in sent), 4)
            some = np.flatnonzero(twice[: len(p)])
            h, p = (g[some] | tv.U(group.column("bucket")[0].as_py()) << tv.U(key)).tobytes(), _thin(p[some], 4)
            edge = np.searchsorted(some, np.cumsum([0, *(len(r[3]) // 4 for r in sent)])).tolist()
            kept += [(r[0], KNOWN, h[8 * i : 8 * j], p[4 * i : 4 * j], b"", b"") for r, i, j in zip(sent, edge, edge[1:], strict=False) if i < j]
        cols = list(zip(*kept, strict=True)) if kept else [[]] * 6
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "kind", "hashes", "places", "docs", "firsts"), cols, kinds, strict=True)})

    return held


def _order(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order by doc and place."""
    if not len(doc):
        return np.zeros(0, np.int64)
    low, far = int(doc.min()), int(place.max()) + 1
    if (int(doc.max()) - low + 1) * far < 1 << 63:
        return np.argsort((doc - low) * far + place)
    return np.lexsort((place, doc))


def _pairs(doc: np.ndarray, place: np.ndarray, rank: np.ndarray, offset: int, reach: int) -> Pairs:
    """Suffixes, in order of doc and place, with the rank of the one at the offset, where all that a window holds are there."""
    n = len(doc)
    first = np.r_[True, doc[1:] != doc[:-1]] if n else np.zeros(0, bool)
    # Documents set apart by more than any place, in one line.
    line = (np.cumsum(first) - 1) * (int(place.max()) + LEAST + 1 if n else 1) + place
    # A repeated window is a stretch of suffixes whose first `reach` words are repeated; shorter stretches hold none.
    edge = np.flatnonzero(np.r_[True, line[1:] != line[:-1] + 1, True]) if n else np.zeros(1, np.int64)
    long = np.repeat(np.diff(edge) > LEAST - reach, np.diff(edge))
    doc, place, rank, line = doc[long], place[long], rank[long], line[long]
    to = np.minimum(np.searchsorted(line, line + offset), max(0, len(line) - 1))
    ok = line[to] == line + offset if len(line) else np.zeros(0, bool)
    return rank[ok].astype(tv.U), rank[to][ok].astype(tv.U), doc[ok].astype(np.int64), place[ok].astype(np.int64)


def _first_pairs(offset: int, gram: int):
    def run(group: pa.Table) -> Pairs:
        """The first pairs of a block."""
        kind, h, x, d, f = (group.column(c).to_pylist() for c in ("kind", "hashes", "places", "docs", "firsts"))
        head = kind.index(HEAD)
        ids, firsts = np.frombuffer(d[head], "<i8"), np.frombuffer(f[head], "<i8")
        g, p = np.frombuffer(b"".join(h), tv.U), _wide(b"".join(x), 4).astype(np.int64)
        order = np.argsort(p)
        g, p = g[order], p[order]
        row = np.searchsorted(firsts, p, side="right") - 1
        return _pairs(ids[row].astype(np.int64), p - firsts[row], g, offset, gram)

    return run


def _part(pairs: Pairs, cuts: Pairs) -> np.ndarray:
    """The part of the order that each pair belongs to: how many cuts are not behind it."""
    part = np.searchsorted(cuts[0], pairs[0])
    near = np.flatnonzero(part < np.searchsorted(cuts[0], pairs[0], side="right"))
    if len(near):
        a, b, doc, place = (np.concatenate((c, x[near])) for c, x in zip(cuts, pairs, strict=True))
        row = np.arange(len(a)) >= len(cuts[0])
        order = np.lexsort((row, place, doc, b, a))
        before = np.empty(len(a), np.int64)
        before[order] = np.cumsum(~row[order])
        part[near] = before[row]
    return part


def _sampled(make: Callable[[pa.Table], Pairs], most: int):
    def run(group: pa.Table) -> pa.Table:
        """So many of a group's pairs, at even distances."""
        pairs = make(group)
        step = max(1, -(-len(pairs[0]) // most))
        return pa.table({n: pa.array([x[::step].tobytes()], pa.binary()) for n, x in zip("abdp", pairs, strict=True)})

    return run


def _sent(make: Callable[[pa.Table], Pairs], cuts: Pairs, width: int):
    def run(group: pa.Table) -> pa.Table:
        """A group's pairs, packed by part of the order."""
        pairs = make(group)
        part = _part(pairs, cuts)
        order = np.argsort(part.astype(np.uint16) if len(cuts[0]) < 1 << 16 else part, kind="stable")
        part = part[order]
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
        cols = [x[order].astype(t) for x, t in zip(pairs, (f"<u{width}", f"<u{width}", "<i8", "<i4"), strict=True)]
        spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        return pa.table({"part": pa.array(part[edge[:-1]].astype(np.int32))} | {n: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for n, x in zip("abdp", cols, strict=True)})

    return run


def _rerank(buckets: int, width: int):
    def run(group: pa.Table) -> pa.Table:
        """Ranks within the part of what stands more than once or at its ends, packed by bucket of documents; and its first and last pair, for bucket -1."""
        part = group.column("part")[0].as_py()
        a, b, doc, place = (np.frombuffer(b"".join(group.column(n).to_pylist()), t) for n, t in zip("abdp", (f"<u{width}", f"<u{width}", "<i8", "<i4"), strict=True))
        if width == 4:
            key = a.astype(tv.U) << tv.U(32) | b
            order = np.argsort(key)
            key = key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            del key
        else:
            order = np.lexsort((b, a))
            new = np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)]
        start = np.flatnonzero(new)
        ends = [(int(a[i]), int(b[i])) for i in (order[0], order[-1])]
        d = doc[order]
        low, high = np.minimum.reduceat(d, start), np.maximum.reduceat(d, start)
        size = np.diff(np.r_[start, len(d)])
        rank = np.repeat(np.arange(len(start), dtype=np.int32), size)
        p = np.where(d == low[rank], place[order], np.iinfo(np.int32).max)
        flag = (p == np.minimum.reduceat(p, start)[rank]) * np.uint8(FIRST) + ((size == 1) * np.uint8(ALONE) + (low != high) * np.uint8(BESIDE))[rank]
        # Back to the order in which they came, in which documents and places are mostly in order.
        ranks, flags = np.empty(len(d), np.int32), np.empty(len(d), np.uint8)
        ranks[order], flags[order] = rank, flag
        kept = np.flatnonzero((flags & ALONE == 0) | (ranks == 0) | (ranks == len(start) - 1))
        bucket = (tv.mix(doc[kept].astype(tv.U)) % tv.U(buckets)).astype(np.int64)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        kept, bucket = kept[order], bucket[order]
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        spans = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
        seam = np.array([len(start), len(kept), *ends[0], *ends[1]], "<u8").tobytes(), np.array([low[0], high[-1]], "<i8").tobytes(), b"", b""
        cols = [pa.array([*(x[kept[i:j]].tobytes() for i, j in spans), s], pa.binary()) for x, s in zip((ranks, doc, place, flags), seam, strict=True)]
        return pa.table([pa.array([*bucket[edge[:-1]].tolist(), -1], pa.int32()), pa.array([part] * (len(spans) + 1), pa.int32()), *cols], ["bucket", "part", "ranks", "docs", "places", "flags"])

    return run


class Seams:
    """How the sorted parts hang together: the ranks before each, and whether its first and last rank go on in its neighbours, with what documents."""

    def __init__(self, rows: list) -> None:
        rows = sorted((r.part, np.frombuffer(bytes(r.ranks), "<u8").tolist(), np.frombuffer(bytes(r.docs), "<i8").tolist()) for r in rows)
        n = rows[-1][0] + 1 if rows else 1
        self.before = np.zeros(n, np.int64)
        self.goes_on = np.zeros((2, n), bool)
        self.doc = np.zeros((2, n), np.int64)
        self.groups = np.zeros(n, np.int64)
        for (i, x, d), (j, y, e) in zip(rows, rows[1:], strict=False):
            same = x[4:6] == y[2:4]
            self.before[j] = self.before[i] + x[0] - same
            self.goes_on[1, i] = self.goes_on[0, j] = same
            self.doc[1, i], self.doc[0, j] = e[0], d[1]
        for i, x, _ in rows:
            self.groups[i] = x[0]
        #: Suffixes that are left, and ranks.
        self.left = sum(x[1] for _, x, _ in rows)
        self.ranks = int((self.before + self.groups).max())


def _gathered(group: pa.Table, seams: Seams) -> tuple[np.ndarray, ...]:
    """doc, place, rank, first, beside of a bucket's suffixes, in order of doc and place, but for those that are alone in their rank."""
    rank, doc, place, flag = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("ranks", "<i4"), ("docs", "<i8"), ("places", "<i4"), ("flags", np.uint8)))
    part = np.repeat(group.column("part").to_numpy(), [len(f) for f in group.column("flags").to_pylist()])
    above = (rank == 0) & seams.goes_on[0, part]
    below = (rank == seams.groups[part] - 1) & seams.goes_on[1, part]
    ok = (flag & ALONE == 0) | above | below
    first = (flag & FIRST > 0) & ~above
    beside = (flag & BESIDE > 0) | (above & (doc != seams.doc[0, part])) | (below & (doc != seams.doc[1, part]))
    doc, place, rank, first, beside = (x[ok] for x in (doc, place, rank + seams.before[part], first, beside))
    order = _order(doc, place)
    return doc[order], place[order], rank[order], first[order], beside[order]


def _next_pairs(seams: Seams, offset: int, reach: int):
    def run(group: pa.Table) -> Pairs:
        doc, place, rank, _, _ = _gathered(group, seams)
        return _pairs(doc, place, rank, offset, reach)

    return run


def _cover(place: np.ndarray, n: int) -> np.ndarray:
    """Which of n words windows that begin at the places cover."""
    edge = np.zeros(n + 1, np.int64)
    edge[place] += 1
    edge[place + LEAST] -= 1
    return np.cumsum(edge[:-1]) > 0


def _runs(mark: np.ndarray, base: int) -> list[dict]:
    """Stretches of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, mark, False])) + base
    return [{"begin": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _spans(seams: Seams):
    def run(group: pa.Table) -> pa.Table:
        doc, place, _, first, beside = _gathered(group, seams)
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True]) if len(doc) else np.zeros(1, np.int64)
        out = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            base = int(place[a])
            p, f = place[a:b] - base, first[a:b]
            n = int(p[-1]) + LEAST
            every, stays = _cover(p, n), _cover(p[f], n)
            out.append((int(doc[a]), _runs(every, base), _runs(every & ~stays, base), int(every.sum()), bool(beside[a:b].any())))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        kinds = (pa.int64(), span, span, pa.int32(), pa.bool_())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "repeats", "removable", "repeated_words", "across"), cols, kinds, strict=True)})

    return run


def _stored(df: DataFrame) -> DataFrame:
    """df, materialised; the shuffle files that it took are dropped at once, not when the driver next collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return materialise(df)
    finally:
        conf.set(key, before)


def held_grams(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """By block of documents: the hashes and places of grams that stand more than once, and the documents."""
    source = one_row(docs)
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = max(1, (int(size) // BUCKET_BYTES).bit_length())
    sent = source.mapInArrow(lean(_send(bits, gram)), _SENT)
    return _stored(sent.groupBy("bucket").applyInArrow(_hold(bits), _SENT.removeprefix("bucket int, ")))


def _cuts(source: DataFrame, key: str, groups: int, make: Callable[[pa.Table], Pairs], parts: int) -> Pairs:
    """Pairs that cut the order into parts of about as many rows, from the pairs of some groups."""
    found = []
    for step in dict.fromkeys((max(1, groups // SAMPLED), 1)) if parts > 1 else ():
        some = source.where(F.pmod(key, F.lit(step)) == 0)
        rows = some.groupBy(key).applyInArrow(_sampled(make, max(1, CUT_ROWS * parts * step // max(1, groups))), "a binary, b binary, d binary, p binary").collect()
        found = [np.frombuffer(b"".join(bytes(r[n]) for r in rows), t) for n, t in zip("abdp", (tv.U, tv.U, np.int64, np.int64), strict=True)]
        if len(found[0]):
            order = np.lexsort(found[::-1])
            at = order[len(order) * np.arange(1, parts) // parts]
            return tuple(x[at] for x in found)
    return tuple(np.zeros(0, t) for t in (tv.U, tv.U, np.int64, np.int64))


def reranked(source: DataFrame, key: str, groups: int, make: Callable[[pa.Table], Pairs], most: int, width: int) -> tuple[DataFrame, Seams]:
    """A round's sort: suffixes packed by part of the order and bucket of documents, and how the parts hang together. source, a materialised table of at most so many suffixes in groups of the key, is dropped."""
    cuts = _cuts(source, key, groups, make, -(-most // ROWS))
    sent = source.groupBy(key).applyInArrow(_sent(make, cuts, width), _PAIR)
    ranked = _stored(sent.groupBy("part").applyInArrow(_rerank(_buckets(most), width), _RANKED))
    discard(source)
    return ranked, Seams(ranked.where("bucket = -1").select("part", "ranks", "docs").collect())


def _buckets(suffixes: int) -> int:
    return max(1, -(-suffixes // BUCKET_ROWS))


def doubled(docs: DataFrame, gram: int = GRAM) -> tuple[DataFrame, Seams]:
    """All rounds: the repeated windows, as packed by the last."""
    first, *later = offsets(gram)
    held = held_grams(docs, gram)
    known = held.agg(F.sum(F.octet_length("places")).alias("bytes"), F.sum((F.col("kind") == HEAD).cast("int")).alias("blocks")).first()
    most, reach = (known.bytes or 0) // 4, gram + first
    ranked, seams = reranked(held, "block", known.blocks or 0, _first_pairs(first, gram), most, 8)
    for offset in later:
        groups, most = _buckets(most), seams.left
        ranked, seams = reranked(ranked.where("bucket >= 0"), "bucket", groups, _next_pairs(seams, offset, reach), most, 4 if seams.ranks < 1 << 32 else 8)
        reach += offset
    return ranked.where("bucket >= 0"), seams


def suffixes(docs: DataFrame) -> DataFrame:
    """doc_id, place, rank of the suffixes whose first LEAST words stand more than once: equal ranks for equal words, in one order."""
    ranked, seams = doubled(docs)

    def run(group: pa.Table) -> pa.Table:
        doc, place, rank, _, _ = _gathered(group, seams)
        return pa.table({"doc_id": pa.array(doc), "place": pa.array(place), "rank": pa.array(rank)})

    return ranked.groupBy("bucket").applyInArrow(run, "doc_id long, place int, rank long")


def passages(docs: DataFrame) -> DataFrame:
    """PASSAGES: of each document that has one, its repeated passages as word ranges, those of which a copy stays elsewhere, how many of its words are repeated, and whether another document has some."""
    ranked, seams = doubled(docs)
    return ranked.groupBy("bucket").applyInArrow(_spans(seams), PASSAGES)
