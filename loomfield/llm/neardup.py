"""Operator 1: near duplicates by containment, with an LSH ensemble over set sizes.

A document is the set of its distinct SHINGLE-word shingles (one shingle of all its words if it has
fewer; none if it has no words). Documents are partitioned by set size into octaves. A query of
octave p is held against index partition p + d with the Jaccard threshold that containment T means
there, T / (2^(d+1) + 1 - T), and each distance d up to FARTHEST has its own banding, tuned to that
threshold (`tune`). In each bucket a document is a candidate for the bucket's largest document and for the
next larger one, so that a bucket of any size costs time in proportion to it. Candidates pass a signature
estimate.

Where the ratio of sizes is larger, minima are too seldom equal, and in a bucket of a popular shingle the true
container is often neither of the two. So an index of another kind is used for all pairs, whose recall depends on
neither, for all documents that have no container by exact check yet: a document's SAMPLE shingles of least hash are sought among all shingles of all larger
documents (`index`, `sought`), by the rarest of them, so many that one is met by every document that has enough
of the sample, and paired with all that hold one. Of candidates of both ways the containment is computed from whole sets, of 32 bits
a shingle: among sets of a and b shingles a * b / 2^32 are equal by chance, so two of 1,000 each differ from the exact value by 2e-7 on average.

A document whose containment in a larger one (ties: the one of smaller doc_id counts as larger) is at
least T belongs to the best of those found, and through it to a root; a root with all that lead to it
is a group, of which the root stays. Documents of equal sets are collapsed at first, the least
doc_id stands for them.

Nulls and edges: rows without doc_id are not compared (`keep_one` keeps them); null texts are empty;
documents without words are in no group; a doc_id on several rows is one document, of its distinct texts, of which
`keep_one` keeps one row; extra columns are passed through by `keep_one` and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, free_shuffles, lean, materialise, one_row, texts

SHINGLE = 5
#: Containment from which a document belongs to a larger one.
T = 0.7
#: Hash functions of a signature, and the recall for which bandings are tuned.
HASHES, RECALL = 64, 0.95
#: The largest octave distance for which minima are compared.
FARTHEST = 2
#: Shingles by which a document is sought in the index, and the share of pairs at the threshold that they may miss.
SAMPLE, MISSED = 40, 0.01
#: Shingles of its rarest that a document must share with another to be held against it.
HITS = 3
#: Bits of the filter of sought shingles for each of them, and the logarithms of the fewest and most bits in all, and of those in a part.
SPARSE, FILTER, PART = 16, (18, 30), 18
#: Up to so many ids are broadcast (16 MB); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000

_A = np.random.default_rng(11).integers(1, 2**62, size=HASHES, dtype=np.uint64) * tv.U(2) + tv.U(1)


def jaccard(t: float, ratio: float) -> float:
    """Least Jaccard similarity of a set with another `ratio` times as large that holds t of it."""
    return t / (ratio + 1 - t)


def tune(threshold: float, hashes: int = HASHES, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows: the most rows with which a pair at the threshold shares a band with the given probability; all hashes as bands of one row if none do."""
    for rows in range(8, 1, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    needed = math.ceil(math.log(1 - recall) / math.log(1 - threshold))
    return min(hashes, needed), 1


def ensemble(t: float = T) -> dict[int, tuple[int, int]]:
    """Banding of each octave distance; from the one that takes all hashes on it stays the same."""
    return {d: tune(jaccard(t, 2.0 ** (d + 1))) for d in range(24)}


def least_hits(m: int, t: float = T) -> int:
    """How many of m sampled shingles a container has: of a whole set the share t, of a larger one's SAMPLE all but MISSED of the pairs at t have that many."""
    if m < SAMPLE:
        return max(1, math.ceil(t * m - 1e-9))
    below = np.cumsum([math.comb(m, k) * t**k * (1 - t) ** (m - k) for k in range(m + 1)])
    return max(1, int(np.searchsorted(below, MISSED, side="right")))


def shingles(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted in each row, and how many each row has."""
    k, rows = SHINGLE, len(w.first) - 1
    g = tv.grams(w.h, k)
    ok = tv.inside(w.first, k, len(g))
    row = w.row
    parts, owners = [g[ok]], [row[: len(g)][ok]]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    for n in range(1, k):
        of = short[w.counts[short] == n]
        if len(of):
            x = np.full(len(of), n, tv.U)
            for i in range(n):
                x = x * tv._GRAM + w.h[w.first[of] + i]
            parts.append(tv.mix(x))
            owners.append(of)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.bincount(owner, minlength=rows)


def signatures(value: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Minima of HASHES hash functions, 32 bits each; a row for each row with shingles."""
    some = counts[counts > 0]
    starts = np.cumsum(some) - some
    out = np.empty((len(some), HASHES), np.uint32)
    for i, a in enumerate(_A):
        out[:, i] = np.minimum.reduceat(((value * a) >> tv.U(32)).astype(np.uint32), starts)
    return out


_SIGNED = "doc_id long, n int, f1 long, f2 long, sig binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = tv.strings(batch.column(1))
        for lo, hi in tv.slices(off):
            w = tv.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            value, counts = shingles(w)
            if not len(value):
                continue
            some = counts > 0
            starts = np.cumsum(counts[some]) - counts[some]
            f1, f2 = np.add.reduceat(value, starts), np.add.reduceat(tv.mix(value), starts)
            sig = signatures(value, counts)
            binary = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer((np.arange(len(sig) + 1) * 4 * HASHES).astype(np.int32)), pa.py_buffer(sig.tobytes())])
            ids = batch.column(0).slice(lo, hi - lo).filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts[some].astype(np.int32)), pa.array(tv.signed(f1)), pa.array(tv.signed(f2)), binary], ["doc_id", "n", "f1", "f2", "sig"])


def _sigs(col: pa.Array) -> np.ndarray:
    return tv.strings(col)[0].view(np.uint32).reshape(-1, HASHES)


def _keys(bands: dict[int, tuple[int, int]]):
    """Distinct bandings of the ensemble as (rows, bands): a banding with fewer bands is a part of the longest."""
    longest: dict[int, int] = {}
    for b, r in bands.values():
        longest[r] = max(b, longest.get(r, 0))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = _sigs(part.column(2)).astype(tv.U)
                keys = []
                for r, b in longest.items():
                    x = np.zeros((len(sig), b), tv.U) + np.arange(b, dtype=tv.U) * tv.U(64) + tv.U(r)
                    for i in range(r):
                        x = x * tv._GRAM + sig[:, i : b * r : r]
                    keys.append((tv.mix(x) & ~tv.U(7)) | tv.U(r))
                key = np.concatenate(keys, axis=1)
                width = key.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(tv.signed(key.ravel())), pa.array(np.repeat(part.column(0).to_numpy(), width)), pa.array(np.repeat(part.column(1).to_numpy(), width))], ["key", "doc_id", "n"])

    return emit


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of one byte a hash, enough for the estimate: two unequal minima look equal once in 256."""
    for batch in batches:
        if batch.num_rows:
            sig = _sigs(batch.column(2)).astype(np.uint8)
            binary = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer((np.arange(len(sig) + 1) * HASHES).astype(np.int32)), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary], ["doc_id", "n", "sig"])


def _estimate(t: float):
    """Of candidates with both signatures, those whose estimated containment may reach t, within two standard errors."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            q, x = (tv.strings(batch.column(c))[0].reshape(-1, HASHES) for c in ("q_sig", "x_sig"))
            nq, nx = batch.column("nq").to_numpy().astype(float), batch.column("nx").to_numpy().astype(float)
            same = (q == x).mean(axis=1)
            least = t * nq / (nx + (1 - t) * nq)
            yield batch.select(["q", "x", "nq", "nx"]).filter(pa.array(same >= least - 2 * np.sqrt(least * (1 - least) / HASHES)))

    return keep


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = tv.strings(batch.column(1))
        for lo, hi in tv.slices(off):
            value, counts = shingles(tv.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
            # The upper halves stay sorted, and two shingles of one document that share theirs are rare enough to count as one.
            value = (value >> tv.U(32)).astype(np.uint32)
            at = np.r_[0, np.cumsum(counts)] * 4
            col = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(value.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), col], ["id", "shingles"])


def _contain(t: float):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q, x in zip(batch.column("q_set"), batch.column("x_set"), strict=True):
                a, b = np.frombuffer(q.as_buffer(), np.uint32), np.frombuffer(x.as_buffer(), np.uint32)
                at = np.searchsorted(b, a)
                out.append(float((b[np.minimum(at, len(b) - 1)] == a).sum()) / max(1, len(a)) if len(b) else 0.0)
            value = np.array(out)
            keep = pa.array(value >= t)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("q", "x", "nx")] + [pa.array(value).filter(keep)], ["q", "x", "nx", "containment"])

    return exact


def _slots(value: np.ndarray, bits: int) -> np.ndarray:
    return (tv.mix(value) >> tv.U(64 - bits)).astype(np.int64)


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample of each document with its size; a document without words has none."""
    for batch in batches:
        raw, off = tv.strings(batch.column(1))
        for lo, hi in tv.slices(off):
            value, counts = shingles(tv.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
            nth = np.arange(len(value)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([pa.array(tv.signed(value[nth < SAMPLE]))], ["key"])


def _filter(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """One bit for each hash of a sought shingle, as bytes, and the logarithm of their number."""
    bits = int(np.clip(math.ceil(math.log2(max(1, n * SAMPLE * SPARSE))), *FILTER))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _least(batches):
            slot = np.unique(_slots(batch.column(0).to_numpy().view(tv.U), bits))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> PART).astype(np.int32)), pa.array((slot & ((1 << PART) - 1)).astype(np.int32))], ["part", "slot"])

    def gather(group: pa.Table) -> pa.Table:
        some = np.zeros(1 << PART, np.uint8)
        some[group.column("slot").to_numpy()] = 1
        return pa.table({"part": group.column("part").slice(0, 1), "bits": pa.array([np.packbits(some, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in docs.mapInArrow(lean(place), "part int, slot int").groupBy("part").applyInArrow(gather, "part int, bits binary").toLocalIterator():
        out[r.part << (PART - 3) : (r.part + 1) << (PART - 3)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out, bits


def index(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n and keys of about n documents (doc_id, text): the shingles of each that any document is sought by, ascending, so that its own sample comes first."""
    table, bits = _filter(docs, n)
    table = docs.sparkSession.sparkContext.broadcast(table)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tv.strings(batch.column(1))
            for lo, hi in tv.slices(off):
                value, counts = shingles(tv.words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                slot = _slots(value, bits)
                held = (table.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                sums = np.r_[0, np.cumsum(held)][np.r_[0, np.cumsum(counts)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(counts.astype(np.int32)), tv.as_list(tv.signed(value[held]), np.diff(sums), pa.int64())], ["doc_id", "n", "keys"])

    return materialise(docs.mapInArrow(lean(emit), "doc_id long, n int, keys array<long>").where("n > 0"))


def sought(held: DataFrame, t: float = T, found: DataFrame | None = None) -> DataFrame:
    """Of documents whose ids aren't among found (q), pairs q, x with nq, nx of an index (doc_id, n, keys): x is larger, or of the same size and smaller id, and has enough of q's sample."""
    flat = held.select("doc_id", "n", F.posexplode("keys").alias("pos", "key"))
    common = flat.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    least = F.element_at(F.array(*[F.lit(least_hits(m, t)) for m in range(1, SAMPLE + 1)]), F.least("n", F.lit(SAMPLE)))
    by = Window.partitionBy("doc_id", "n").orderBy("df", "key")
    own = flat.where(F.col("pos") < SAMPLE)
    if found is not None:
        own = own.join(found, own["doc_id"] == found["q"], "left_anti")
    own = own.join(common, "key", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    # Who has `least` of m keys has HITS of any m - least + HITS.
    hits = F.least(least, F.lit(HITS))
    own = own.withColumn("nth", F.row_number().over(by)).where((F.col("nth") <= F.least("n", F.lit(SAMPLE)) - least + hits) & (F.col("df") > 1))
    q = own.select("key", F.col("doc_id").alias("q"), F.col("n").alias("nq"))
    x = flat.join(common.select("key"), "key", "left_semi").select("key", F.col("doc_id").alias("x"), F.col("n").alias("nx"))
    larger = (F.col("q") != F.col("x")) & ((F.col("nx") > F.col("nq")) | ((F.col("nx") == F.col("nq")) & (F.col("x") < F.col("q"))))
    few = F.least(F.lit(HITS), F.element_at(F.array(*[F.lit(least_hits(m, t)) for m in range(1, SAMPLE + 1)]), F.least("nq", F.lit(SAMPLE))))
    pairs = q.join(x, "key").where(larger).groupBy("q", "x").agg(F.first("nq").alias("nq"), F.first("nx").alias("nx"), F.count("*").alias("hits")).where(F.col("hits") >= few).drop("hits")
    pairs = pairs.join(held.select(F.col("doc_id").alias("q"), F.slice("keys", 1, SAMPLE).alias("sample"), least.alias("least")), "q")
    pairs = pairs.join(held.select(F.col("doc_id").alias("x"), "keys"), "x")
    return pairs.where(F.size(F.array_intersect("sample", "keys")) >= F.col("least")).select("q", "x", "nq", "nx")


def only(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The documents whose doc_id is among ids: a broadcast join for at most so many ids, else a shuffled one."""
    few = ids.limit(most + 1).count() <= most
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "doc_id", "left_semi")


def signed(docs: DataFrame) -> DataFrame:
    return materialise(docs.mapInArrow(lean(_sign), _SIGNED))


def candidates(reps: DataFrame, t: float = T) -> DataFrame:
    """Pairs q, x with nq, nx: q may be contained in x, which is larger or of the same size and smaller id."""
    bands = {d: b for d, b in ensemble(t).items() if d <= FARTHEST}
    by = Window.partitionBy("key").orderBy(F.desc("n"), "doc_id")
    keyed = reps.select("doc_id", "n", "sig").mapInArrow(lean(lambda it: _keys(bands)(b.select(["doc_id", "n", "sig"]) for b in it)), "key long, doc_id long, n int")
    seen = keyed.select("key", "doc_id", "n", F.struct("doc_id", "n").alias("d"))
    seen = seen.withColumn("hub", F.first("d").over(by)).withColumn("next", F.lag("d").over(by)).where(F.col("next").isNotNull())
    pairs = seen.select(F.col("doc_id").alias("q"), F.col("n").alias("nq"), (F.col("key").bitwiseAND(7)).alias("r"), F.explode(F.array_distinct(F.array("hub", "next"))).alias("x"))
    pairs = pairs.select("q", "nq", "r", F.col("x.doc_id").alias("x"), F.col("x.n").alias("nx")).where("q <> x")
    octaves = F.floor(F.log2(F.col("nx"))) - F.floor(F.log2(F.col("nq")))
    rows = F.element_at(F.create_map(*[F.lit(v) for d, (_, r) in bands.items() for v in (d, r)]), octaves.cast("int"))
    # A pair counts in the banding of its distance or a stricter one; two single-row hits are asked for, of the five or more that a pair at the threshold has up to distance 2.
    pairs = pairs.where(F.col("r") >= rows).groupBy("q", "x").agg(F.max("nq").alias("nq"), F.max("nx").alias("nx"), F.sum("r").alias("hits"))
    return pairs.where(F.col("hits") >= F.when((F.col("nx") >= 8 * F.col("nq")) | (F.col("nq") < 8), 1).otherwise(2)).drop("hits")


def contained(docs: DataFrame, likely: DataFrame, t: float) -> DataFrame:
    """Of pairs (q, x, nq, nx) those of containment t at least, by whole sets: q, x, nx, containment."""
    ids = likely.select(F.explode(F.array("q", "x")).alias("doc_id")).distinct()
    sets = materialise(only(docs, ids).mapInArrow(lean(_sets), "id long, shingles binary"))
    checked = likely.join(sets.select(F.col("id").alias("q"), F.col("shingles").alias("q_set")), "q").join(sets.select(F.col("id").alias("x"), F.col("shingles").alias("x_set")), "x")
    return checked.select("q", "x", "nx", "q_set", "x_set").mapInArrow(lean(_contain(t)), "q long, x long, nx int, containment double")


def groups(docs: DataFrame, t: float = T) -> DataFrame:
    """doc_id, group_id (the document that stays), contained_in, containment, n_shingles, kept; for all members of groups of two or more."""
    docs = one_row(docs)
    spark = docs.sparkSession
    sigs = signed(docs)
    same = Window.partitionBy("f1", "f2", "n")
    members = materialise(sigs.select("doc_id", "n", F.min("doc_id").over(same).alias("rep")))
    reps = sigs.join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    pairs = materialise(candidates(reps, t))
    free_shuffles(spark)
    side = sigs.select("doc_id", "n", "sig").mapInArrow(_short, "doc_id long, n int, sig binary").drop("n")
    both = pairs.join(side.select(F.col("doc_id").alias("q"), F.col("sig").alias("q_sig")), "q").join(side.select(F.col("doc_id").alias("x"), F.col("sig").alias("x_sig")), "x")
    likely = materialise(both.select("q", "x", "nq", "nx", "q_sig", "x_sig").mapInArrow(lean(_estimate(t)), "q long, x long, nq int, nx int"))
    discard(pairs)
    free_shuffles(spark)
    found = materialise(contained(docs, likely, t))
    discard(likely)
    held = index(only(docs, members.where("doc_id = rep").select("doc_id")), members.count())
    discard(sigs)
    free_shuffles(spark)
    likely = materialise(sought(held, t, found.select("q").distinct()))
    discard(held)
    free_shuffles(spark)
    found = found.unionByName(contained(docs, likely, t))
    best = materialise(found.groupBy("q").agg(F.max(F.struct("containment", "nx", (-F.col("x")).alias("x"), F.col("x").alias("to"))).alias("b")).select("q", F.col("b.to").alias("x"), F.col("b.containment").alias("containment")))
    free_shuffles(docs.sparkSession)
    roots = best.select("q", F.col("x").alias("root"))
    while True:
        # Pointer jumping: each round halves the way to the root, which no pointer leaves.
        step = roots.alias("a").join(roots.alias("b"), F.col("a.root") == F.col("b.q"), "left")
        step = materialise(step.select(F.col("a.q").alias("q"), F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")))
        roots = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    tree = roots.join(best, "q")
    out = members.join(tree.select(F.col("q").alias("rep"), "root", F.col("x").alias("to"), "containment"), "rep", "left")
    out = out.withColumn("group_id", F.coalesce("root", "rep"))
    out = out.select(
        "doc_id",
        "group_id",
        F.when(F.col("doc_id") != F.col("rep"), F.col("rep")).otherwise(F.col("to")).alias("contained_in"),
        F.when(F.col("doc_id") != F.col("rep"), F.lit(1.0)).otherwise(F.col("containment")).alias("containment"),
        F.col("n").alias("n_shingles"),
        (F.col("doc_id") == F.col("group_id")).alias("kept"),
    )
    return out.withColumn("members", F.count("*").over(Window.partitionBy("group_id"))).where("members > 1")


def keep_one(docs: DataFrame, t: float = T) -> DataFrame:
    """The documents that stay, one of each group and all that are in none, with all their columns."""
    gone = materialise(groups(docs, t).where(~F.col("kept")).select("doc_id"))
    repeated = materialise(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), docs["doc_id"] == gone["doc_id"], "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept["doc_id"] == repeated["doc_id"], "left_anti")
    return once.unionByName(kept.join(repeated, kept["doc_id"] == repeated["doc_id"], "left_semi").dropDuplicates(["doc_id"]))
