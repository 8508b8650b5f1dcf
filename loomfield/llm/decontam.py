"""Operator 3: benchmark decontamination by latent semantic retrieval.

1. Statistics over all documents: passages of PASSAGE words give document frequencies of hashed
   terms and a sparse random-sign sketch S A of the passage-term count matrix A, summed over all
   tasks. Scaled by idf, the sketch's singular vectors are those of a randomised SVD of the TF-IDF
   matrix; the sketch has a fixed size, whatever the corpus. What is folded in is whitened, and weighted by idf once more.
2. Retrieval: a window of words is folded into the latent space by summing its words' vectors.
   Windows begin every BLOCK words and are as few blocks long as hold an item of that length wherever it begins. Each
   window of each document is held against every item of its length by cosine; those of at least COSINE are candidates.
   Only windows that have enough of an item's words at all, in any order, are held against it.
3. Proof: of candidates, the longest common subsequence of the item's words with the window and a block about it. An
   item is present from a share of VERBATIM on; from PARAPHRASE on if its answer, the last ANSWER
   words, is there too, but for one word.

COSINE is set by measured recall, at least 0.9 of what all windows without it would find down to PARAPHRASE. The sketch takes one pass and no power
iteration. Items are collected at most ITEMS_AT_ONCE at a time, further ones in further passes. Nulls and edges: rows without
doc_id or item_id are skipped; null and empty texts match nothing, in items as in documents; documents shorter
than a window are one window; repeated documents or items give the same findings, once each pair of ids;
an empty table on either side gives no finding. Extra columns are ignored, in `clean` passed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import lean, texts

TERMS, SKETCH, RANK = 8192, 256, 64
PASSAGE, BLOCK = 32, 8
COSINE, VERBATIM, PARAPHRASE, ANSWER = 0.2, 0.6, 0.4, 6
#: Below the share HALF, of the words before the answer so many must be there too: the answer of a short item is near it in itself.
HALF, REST = 0.5, 0.3
#: Items that travel with the tasks of one pass, some 600 bytes each.
ITEMS_AT_ONCE = 200_000
#: Window lengths in blocks up to which each is a class of its own; beyond, they grow by an eighth.
EXACT = 16
#: Items of a class that are bounded at a time, and tables of such items that a task keeps.
TOGETHER, KEPT = 256, 64
#: Bytes of text whose counts are added to the sketch at a time.
FIT_SLICE = 1 << 20
#: First step of the sum over tasks, so that no group holds the sketch of very many of them.
FAN_IN = 32

FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: rows 0..SKETCH-1 of the sketch of counts, then document frequencies, then the number of passages."""
    sketch = np.zeros(SKETCH * TERMS, np.int32)
    df = np.zeros(TERMS, np.int64)
    passages = 0
    for batch in batches:
        raw, off = tv.strings(batch.column(0))
        for lo, hi in tv.slices(off, FIT_SLICE):
            w = tv.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            if not len(w.h):
                continue
            per_row = -(-w.counts // PASSAGE)
            place = np.arange(len(w.h)) - np.repeat(w.first[:-1], w.counts)
            passage = np.repeat(np.cumsum(per_row) - per_row, w.counts) + place // PASSAGE
            term = (w.h & tv.U(TERMS - 1)).astype(np.int64)
            n = int(per_row.sum())
            # Bucket and sign come from the passage's words, so that a task that runs again gives the same.
            starts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            seed = tv.mix(np.add.reduceat(w.h, starts))
            bucket = (seed & tv.U(SKETCH - 1)).astype(np.int64)
            sign = 1 - 2 * ((seed >> tv.U(40)) & tv.U(1)).astype(np.int32)
            sketch += np.bincount(bucket[passage] * TERMS + term, weights=sign[passage], minlength=SKETCH * TERMS).astype(np.int32)
            pair = np.sort((passage * TERMS + term).astype(np.int64))
            pair = pair[np.r_[True, pair[1:] != pair[:-1]]]
            df += np.bincount(pair % TERMS, minlength=TERMS)
            passages += n
    if passages:
        rows = [sketch[i * TERMS : (i + 1) * TERMS].astype(np.int64).tobytes() for i in range(SKETCH)]
        rows += [df.tobytes(), np.array([passages], np.int64).tobytes()]
        packed = [_pack(x) for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH + 2), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])


def _pack(x: bytes) -> bytes:
    import zlib

    return zlib.compress(x, 1)


def _unpack(x: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(x), np.int64)


def _add(group: pa.Table) -> pa.Table:
    total = sum(_unpack(x.as_py()) for x in group.column("counts"))
    return pa.table({"part": pa.array([group.column("part")[0].as_py()], pa.int32()), "counts": pa.array([_pack(total.tobytes())], pa.binary())})


@dataclass
class Space:
    """Latent vectors of the terms, with idf and singular values taken in."""

    vectors: np.ndarray  # TERMS x RANK, float32

    def term(self, h: np.ndarray) -> np.ndarray:
        return (h & tv.U(TERMS - 1)).astype(np.int64)

    def embed(self, h: np.ndarray) -> np.ndarray:
        return self.vectors[self.term(h)]


def fit(docs: DataFrame, rank: int = RANK) -> Space:
    """Latent space of all documents."""
    parts = texts(docs).select("text").mapInArrow(lean(_statistics), "part int, counts binary")
    some = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).groupBy("part", "salt").applyInArrow(_add, "part int, counts binary")
    rows = {r.part: _unpack(bytes(r.counts)) for r in some.groupBy("part").applyInArrow(_add, "part int, counts binary").collect()}
    if not rows:
        return Space(np.zeros((TERMS, 1), np.float32))
    passages = float(rows[SKETCH + 1][0])
    idf = np.log((passages + 1) / (rows[SKETCH] + 1))
    a = np.stack([rows[i] for i in range(SKETCH)]).astype(np.float64) * idf
    # Singular values and right vectors of the sketch from its small Gram matrix.
    values, left = np.linalg.eigh(a @ a.T)
    top = np.argsort(-values)[:rank]
    top = top[values[top] > max(1e-9, values[top[0]] * 1e-10)]
    sigma = np.sqrt(values[top])
    right = (a.T @ left[:, top]) / sigma
    return Space(((idf**2)[:, None] * right * (sigma.max() / sigma if len(sigma) else 1.0)).astype(np.float32))


@dataclass
class Items:
    """Benchmark items by word hashes, grouped into classes of window length."""

    ids: np.ndarray
    words: list[np.ndarray]
    vectors: np.ndarray
    classes: dict[int, np.ndarray]
    keys: np.ndarray  # sorted (item, word) keys
    bits: np.ndarray  # positions of that word in that item, for items of up to 64 words
    made: dict[tuple[int, int], Bounds] = field(default_factory=dict)

    def bounds(self, size: int, at: int) -> Bounds:
        """Tables of some items of a class; kept for the first few."""
        found = self.made.get((size, at))
        if found is None:
            found = Bounds.of([self.words[k] for k in self.classes[size][at : at + TOGETHER]])
            if len(self.made) < KEPT:
                self.made[size, at] = found
        return found

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": {}}

    @staticmethod
    def of(rows: list[tuple[int, str]], space: Space) -> Items:
        ids, kept, vectors = [], [], []
        classes: dict[int, list[int]] = {}
        keys: dict[int, int] = {}
        for item, text in sorted(set(rows)):
            raw = text.encode()
            h = tv.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).h if raw else np.zeros(0, tv.U)
            if not len(h):
                continue
            size = length_class(-(-(len(h) + BLOCK - 1) // BLOCK))
            k = len(ids)
            classes.setdefault(size, []).append(k)
            ids.append(item)
            kept.append(h)
            v = space.embed(h).sum(axis=0)
            vectors.append(v / max(1e-12, float(np.linalg.norm(v))))
            if len(h) <= 64:
                for i, key in enumerate(_key(h, np.full(len(h), k)).tolist()):
                    keys[key] = keys.get(key, 0) | 1 << i
        order = sorted(keys)
        return Items(np.array(ids, np.int64), kept, np.array(vectors, np.float32).reshape(len(ids), -1), {c: np.array(x) for c, x in classes.items()}, np.array(order, tv.U), np.array([keys[x] for x in order], tv.U))


@dataclass
class Bounds:
    """For some items, which words they have, and which of the answer's places a word fills: what a window must have of an item that is in it."""

    vocabulary: np.ndarray  # sorted words of the items
    likely: np.ndarray  # by the upper 20 bits of a word: whether it may be in the vocabulary
    holds: np.ndarray  # (vocabulary + 1) x items
    fills: np.ndarray  # (vocabulary + 1) x items: bits of the answer's places
    verbatim: np.ndarray  # least words of each item
    paraphrase: np.ndarray
    answer: np.ndarray  # least places of the answer

    @staticmethod
    def of(words: list[np.ndarray]) -> Bounds:
        vocabulary = np.unique(np.concatenate(words))
        holds, fills = np.zeros((2, len(vocabulary) + 1, len(words)), np.uint8)
        for k, h in enumerate(words):
            holds[np.searchsorted(vocabulary, h) + 1, k] = 1
            tail = h[-ANSWER:]
            np.bitwise_or.at(fills, (np.searchsorted(vocabulary, tail) + 1, k), (1 << np.arange(len(tail))).astype(np.uint8))
        likely = np.zeros(1 << 20, bool)
        likely[(vocabulary >> tv.U(44)).astype(np.int64)] = True
        n = np.array([len(h) for h in words])
        return Bounds(vocabulary, likely, holds, fills, np.ceil(VERBATIM * n - 1e-9).astype(np.uint16), np.ceil(PARAPHRASE * n - 1e-9).astype(np.uint16), np.minimum(n, ANSWER) - 1)

    def number(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, from 1 on; 0 for others."""
        out = np.zeros(len(h), np.int32)
        some = np.flatnonzero(self.likely[(h >> tv.U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[some]), len(self.vocabulary) - 1)
        out[some] = np.where(self.vocabulary[at] == h[some], at + 1, 0)
        return out

    def may(self, number: np.ndarray, size: int) -> np.ndarray:
        """Blocks (as rows of the numbers of their words) by items: whether the window of `size` blocks from each (fewer at the end) has enough of the item's words, in any order."""
        n = len(number)
        has, mask = np.zeros((2, n + size - 1, self.holds.shape[1]), np.uint8)
        for j in range(BLOCK):
            has[:n] += self.holds[number[:, j]]
            mask[:n] |= self.fills[number[:, j]]
        # Sums run over, differences of fewer than 2^16 words don't.
        total = np.zeros((len(has) + 1, has.shape[1]), np.uint16 if size * BLOCK < 1 << 16 else np.uint32)
        np.cumsum(has, axis=0, dtype=total.dtype, out=total[1:])
        total = total[size:] - total[:-size]
        width = 1
        while width < size:
            step = min(width, size - width)
            mask, width = mask[:-step] | mask[step:], width + step
        return (total >= self.verbatim) | ((total >= self.paraphrase) & (np.bitwise_count(mask) >= self.answer))


def length_class(need: int) -> int:
    """Blocks of the windows in which items are sought that need so many."""
    size = EXACT
    while size < need:
        size += max(1, size // 8)
    return need if need <= EXACT else size


def _key(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    return tv.mix(h + tv.mix(item.astype(tv.U) + tv.U(1)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def lcs(items: Items, item: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest common subsequence of each item with the words h[lo:hi], and how many of the item's answer words lie in it."""
    total, answer = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
    size = np.array([len(items.words[i]) for i in item]) if len(item) else np.zeros(0, np.int64)
    for at in range(0, len(item), 20_000):
        part = np.flatnonzero(size[at : at + 20_000] <= 64) + at
        if not len(part):
            continue
        state = np.full(len(part), ~tv.U(0))
        steps = hi[part] - lo[part]
        for j in range(int(steps.max())):
            live = np.flatnonzero(steps > j)
            key = _key(h[lo[part[live]] + j], item[part[live]])
            slot = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
            match = np.where(items.keys[slot] == key, items.bits[slot], tv.U(0))
            v = state[live]
            u = v & match
            state[live] = (v + u) | (v - u)
        used = ~state
        mask = np.array([(1 << int(n)) - 1 for n in size[part]], tv.U)
        tail = np.array([((1 << int(n)) - 1) & ~((1 << max(0, int(n) - ANSWER)) - 1) for n in size[part]], tv.U)
        total[part], answer[part] = _popcount(used & mask), _popcount(used & tail)
    for k in np.flatnonzero(size > 64):  # the same with integers of any length
        words = items.words[item[k]].tolist()
        where: dict[int, int] = {}
        for i, x in enumerate(words):
            where[x] = where.get(x, 0) | 1 << i
        full = (1 << len(words)) - 1
        v = full
        for x in h[lo[k] : hi[k]].tolist():
            u = v & where.get(x, 0)
            v = ((v + u) | (v - u)) & full
        used = ~v & full
        total[k], answer[k] = used.bit_count(), (used >> max(0, len(words) - ANSWER)).bit_count()
    return total, answer


def search(items: Items, space: Space, w: tv.Words) -> tuple[np.ndarray, ...]:
    """row, item, cosine, lcs share, answer share of what is found in some rows."""
    none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0),) * 3
    if not len(w.h) or not len(items.ids):
        return none
    counts = w.counts
    per_row = -(-counts // BLOCK)
    first_block = np.r_[0, np.cumsum(per_row)]
    place = np.arange(len(w.h)) - np.repeat(w.first[:-1], counts)
    starts = np.flatnonzero(place % BLOCK == 0)
    # The words of each block, and a place after all words where it has fewer.
    word = starts[:, None] + np.arange(BLOCK)
    word[word >= np.r_[starts[1:], len(w.h)][:, None]] = len(w.h)
    block_sums = np.empty((len(starts), space.vectors.shape[1]), np.float32)
    term = np.append(space.term(w.h), TERMS)[word]
    known = np.concatenate([space.vectors, np.zeros((1, space.vectors.shape[1]), np.float32)])
    for lo in range(0, len(starts), 2048):
        part = known[term[lo : lo + 2048, 0]]
        for j in range(1, BLOCK):
            part += known[term[lo : lo + 2048, j]]
        block_sums[lo : lo + 2048] = part
    row_of = np.repeat(np.arange(len(counts)), per_row)
    last = first_block[row_of + 1]
    index = np.arange(len(starts))
    out = []
    sums, width, total = block_sums.copy(), 1, None
    for size, members in sorted(items.classes.items()):
        # Sums of `size` blocks from each, running on into the next row; those that do are used nowhere but for a row's first, which is summed anew.
        if size - width > 4:
            if total is None:
                total = np.zeros((len(block_sums) + 1, block_sums.shape[1]))
                np.cumsum(block_sums, axis=0, dtype=np.float64, out=total[1:])
            sums[: max(0, len(sums) - size + 1)] = total[size:] - total[: max(0, len(total) - size)]
            width = size
        while width < size:
            if width < len(sums):
                sums[:-width] += block_sums[width:]
            width += 1
        short = np.flatnonzero(per_row < size)
        short = short[per_row[short] > 0]
        use = index[(index + size <= last) | (index == first_block[row_of])]
        end = np.minimum(use + size, last[use])
        brief = np.isin(use, first_block[short], assume_unique=True) if len(short) else np.zeros(len(use), bool)
        for part in range(0, len(members), TOGETHER):
            some = members[part : part + TOGETHER]
            of, bounds = items.vectors[some].T, items.bounds(size, part)
            number = np.append(bounds.number(w.h), 0)[word]
            for lo in range(0, len(use), 4_096):
                i, e = use[lo : lo + 4_096], end[lo : lo + 4_096]
                a, b = i[0], min(len(starts), i[-1] + size)
                may = bounds.may(number[a:b], size)[i - a]
                r, c = np.nonzero(may)
                if not len(r):
                    continue
                v = sums[i]
                for k in np.flatnonzero(brief[lo : lo + 4_096]):
                    v[k] = block_sums[i[k] : e[k]].sum(axis=0)
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)
                near = np.einsum("ij,ji->i", v[r], of[:, c]) if len(r) < len(i) else (v @ of)[r, c]
                near = near / norm[r]
                ok = near >= COSINE
                if ok.any():
                    out.append((i[r[ok]], e[r[ok]], some[c[ok]], near[ok]))
    if not out:
        return none
    begin, end, item, cosine = (np.concatenate(x) for x in zip(*out, strict=True))
    row = row_of[begin]
    lo = np.maximum(starts[begin] - BLOCK, w.first[row])
    hi = np.minimum(np.where(end < len(starts), starts[np.minimum(end, len(starts) - 1)], len(w.h)) + BLOCK, w.first[row + 1])
    total, answer = lcs(items, item, w.h, lo, hi)
    size = np.array([len(items.words[k]) for k in item])
    share, reply = total / size, answer / np.minimum(size, ANSWER)
    rest = (total - answer) / np.maximum(1, size - ANSWER)
    ok = (share >= VERBATIM) | ((share >= PARAPHRASE) & (answer >= np.minimum(size, ANSWER) - 1) & ((share >= HALF) | (rest >= REST)))
    return row[ok], item[ok], cosine[ok].astype(float), share[ok], reply[ok]


def _finder(items: Items, space: Space, doc: int, text: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(doc)
            raw, off = tv.strings(batch.column(text))
            for lo, hi in tv.slices(off):
                w = tv.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                row, item, cosine, share, reply = search(items, space, w)
                if len(row):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), pa.array(items.ids[item]), pa.array(cosine), pa.array(share), pa.array(reply)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

    return find


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.where(F.col("item_id").isNotNull() & (F.length("text") > 0)).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n = -(-rows.count() // ITEMS_AT_ONCE)
    for k in range(n):
        yield [(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, space: Space | None = None) -> DataFrame:
    """doc_id, item_id, with the best cosine, share of the item in sequence (lcs) and share of its answer, for each item that a document holds."""
    space = space or fit(docs)
    found = None
    for rows in _chunks(benchmark):
        part = texts(docs).mapInArrow(lean(_finder(Items.of(rows, space), space, 0, 1)), FOUND)
        found = part if found is None else found.union(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns (those without doc_id too, if they hold none)."""
    space = fit(docs)
    text = docs.columns.index("text")
    for rows in _chunks(benchmark):
        items = Items.of(rows, space)

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = tv.strings(batch.column(text))
                mask = np.ones(batch.num_rows, bool)
                for lo, hi in tv.slices(off):
                    mask[search(items, space, tv.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))[0] + lo] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(lean(keep), docs.schema)
    return docs
