"""Operator 9: content-addressed store of token ids.

A rolling hash over WINDOW ids cuts each document's id stream where its low bits vanish, after LEAST
ids at the earliest and MOST at the latest; so an insertion changes the chunks around it only. A
chunk's address is the BLAKE2b digest of its little-endian ids, 16 or 32 bits wide by the size of the vocabulary.
Each distinct chunk is stored once. A document's recipe is the row of its digests, with the Merkle root
over them; `manifest` carries the tree on over documents up to one root for the corpus, stored with them.

`verify` recomputes every stored chunk's digest and every recipe's root, and looks up every digest of
every recipe: a document is verified if all its chunks are there, intact, and as long as it in sum, which proves its
reconstruction without moving a payload. `reconstruct` does put the ids together again.

Rows without doc_id are skipped; null and empty texts have an empty recipe, with the root of nothing, and are verified;
rows of the same doc_id and the same ids are one recipe, of the same doc_id and other ids are several.
An empty table gives empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import lean, materialise, shared_dir, texts
from .pieces import SLICE, Pieces, encoder

WINDOW, LEAST, MOST, BITS = 32, 64, 1024, 8
DIGEST = 16
#: Digests that a task remembers as sent; beyond, it may send a chunk again, which is dropped later.
REMEMBERED = 500_000
#: Documents in a bucket of the manifest, about, and how many bits of a node's number a level takes away.
BUCKET, FANOUT = 2_048, 10

_P = 0xA0761D6478BD642F
_P_INVERSE = pow(_P, -1, 2**64)
_CUT = "doc_id long, n_tokens int, recipe binary, root binary, digest binary, n int, payload binary"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INVERSE):
        x = np.full(max(n, 1), base, tv.U)
        x[0] = 1
        out.append(np.cumprod(x, dtype=tv.U))
    return out[0], out[1]


def candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which the hash of the WINDOW ids before allows a cut."""
    n = len(ids)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, tv.U)
    np.cumsum(tv.mix(ids.astype(tv.U) + tv.U(1)) * up[:n], out=total[1:])
    h = tv.mix((total[WINDOW:] - total[:-WINDOW]) * down[: n - WINDOW + 1])
    return np.flatnonzero((h & tv.U((1 << BITS) - 1)) == 0) + WINDOW


def cuts(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids."""
    out, last = [], 0
    for c in [*places, n]:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST or c == n > last:
            out.append(c)
            last = c
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(b"\0" + data, digest_size=DIGEST).digest()


def merkle(digests: list[bytes]) -> bytes:
    """Root of a binary tree over the digests; a node without a neighbour moves up as it is."""
    level = digests or [hashlib.blake2b(b"", digest_size=DIGEST).digest()]
    while len(level) > 1:
        above = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=DIGEST).digest() for i in range(0, len(level) - 1, 2)]
        level = above + level[len(above) * 2 :]
    return level[0]


def split(recipe: bytes) -> list[bytes]:
    return [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)]


def _binary(rows: list, kind: pa.DataType = pa.binary()) -> pa.Array:
    return pa.array(rows, kind)


def width(model: Pieces) -> np.dtype:
    return np.dtype("<u2" if model.size <= 1 << 16 else "<u4")


def cut(docs: DataFrame, model: Pieces) -> DataFrame:
    """Rows of two kinds in one pass: a recipe for each document, and chunks (digest not null) that the task sent for the first time."""
    kind = width(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(model), set()
        for batch in batches:
            ids_of = batch.column(0).to_numpy(zero_copy_only=False)
            raw, off = tv.strings(batch.column(1))
            for lo, hi in tv.slices(off, SLICE):
                e = enc.encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                at = e.offsets()
                data = e.ids.astype(kind).tobytes()
                place = candidates(e.ids)
                first = np.searchsorted(place, at, side="right")
                docs_, chunks = [], []
                for r in range(hi - lo):
                    a, b = int(at[r]), int(at[r + 1])
                    found, begin = [], a
                    for end in cuts((place[first[r] : first[r + 1]] - a).tolist(), b - a):
                        part = data[begin * kind.itemsize : (a + end) * kind.itemsize]
                        d = digest(part)
                        found.append(d)
                        if d not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(d)
                            chunks.append((d, a + end - begin, part))
                        begin = a + end
                    docs_.append((b - a, b"".join(found), merkle(found)))
                k, m = len(docs_), len(chunks)
                nothing = [None]
                cols = [
                    pa.array(ids_of[lo:hi].tolist() + nothing * m, pa.int64()),
                    pa.array([x[0] for x in docs_] + nothing * m, pa.int32()),
                    _binary([x[1] for x in docs_] + nothing * m),
                    _binary([x[2] for x in docs_] + nothing * m),
                    _binary(nothing * k + [x[0] for x in chunks]),
                    pa.array(nothing * k + [x[1] for x in chunks], pa.int32()),
                    _binary(nothing * k + [x[2] for x in chunks]),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "recipe", "root", "digest", "n", "payload"])

    return texts(docs).mapInArrow(lean(run), _CUT)


@dataclass
class Store:
    chunks: DataFrame  # digest, n, payload
    recipes: DataFrame  # doc_id, n_tokens, recipe, root
    tree: DataFrame  # height, number, documents, root


def build(docs: DataFrame, model: Pieces) -> Store:
    """The store, as two tables in the shared folder."""
    rows = cut(docs, model)
    key = F.coalesce("digest", F.concat(F.encode(F.col("doc_id").cast("string"), "UTF-8"), F.lit(b"|"), "root"))
    # One exchange for both kinds of rows; payloads are written twice in all, as shuffle files and as the store.
    unique = rows.withColumn("chunk", F.col("digest").isNotNull()).withColumn("key", key).dropDuplicates(["chunk", "key"]).drop("key")
    path = os.path.join(shared_dir(docs.sparkSession), f"store-{uuid.uuid4().hex}")
    unique.write.partitionBy("chunk").option("compression", "zstd").parquet(path)
    held = docs.sparkSession.read.schema(_CUT + ", chunk boolean").parquet(path)
    recipes = held.where("not chunk").select("doc_id", "n_tokens", "recipe", "root")
    return Store(held.where("chunk").select("digest", "n", "payload"), recipes, manifest(recipes))


def _intact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [d.as_py() == digest(p.as_py()) for d, p in zip(batch.column(0), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["digest", "n", "intact"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [split(x.as_py()) for x in batch.column("recipe")]
        roots = [merkle(p) for p in parts]
        cols = [batch.column("doc_id"), batch.column("n_tokens"), batch.column("root"), batch.column("recipe"), pa.array(parts, pa.list_(pa.binary())), pa.array(roots, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "root", "recipe", "digests", "made"])


_UNPACKED = "doc_id long, n_tokens int, root binary, recipe binary, digests array<binary>, made binary"


def _steps(recipes: DataFrame) -> DataFrame:
    return recipes.mapInArrow(_unpack, _UNPACKED)


def verify(store: Store) -> DataFrame:
    """doc_id, n_tokens, n_chunks, recipe, root and corpus_root (hexadecimal), verified; for each recipe.

    Verified is a document whose chunks are all there, intact, and as long as it in sum, whose recipe has its root, and in whose bucket of the manifest the
    roots made anew from all recipes are the bucket's; and none if the manifest's upper levels don't follow from its lowest.
    """
    held = store.chunks.select("digest", "n", "payload").mapInArrow(_intact, "digest binary, n int, intact boolean")
    steps = _steps(store.recipes)
    wanted = steps.select("doc_id", "root", F.explode("digests").alias("digest")).join(held, "digest", "left")
    seen = wanted.groupBy("doc_id", "root").agg(F.count("*").alias("c"), F.sum("n").alias("length"), F.min(F.coalesce("intact", F.lit(False))).alias("intact"))
    out = steps.join(seen, ["doc_id", "root"], "left")
    whole = (F.size("digests") == F.coalesce("c", F.lit(0))) & (F.coalesce("length", F.lit(0)) == F.col("n_tokens")) & F.coalesce("intact", F.lit(True)) & (F.col("made") == F.col("root"))
    buckets = buckets_for(store.recipes.count())
    lowest = store.tree.where("height = 0")
    top = store.tree.orderBy(F.desc("height")).first()
    level, height = lowest, 0
    while height < top.height:
        height += 1
        level = _parents(level, height)
    again = level.first()
    sound = again is not None and again.root == top.root
    known = lowest.select("number", F.col("root").alias("known"))
    made = leaves(steps.select("doc_id", F.col("made").alias("root")), buckets).select("number", F.col("root").alias("anew"))
    good = known.join(made, "number").where("known = anew").select("number", F.lit(sound).alias("listed"))
    out = out.withColumn("number", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).join(good, "number", "left")
    return out.select("doc_id", "n_tokens", F.size("digests").alias("n_chunks"), "recipe", F.lower(F.hex("root")).alias("root"), F.lit(top.root).alias("corpus_root"), (whole & F.coalesce("listed", F.lit(False))).alias("verified"))


def reconstruct(store: Store, model: Pieces) -> DataFrame:
    """doc_id, root, ids: each recipe put together from its chunks."""
    kind = width(model)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(x["payload"] for x in parts or []), kind).astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("root"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "root", "ids"])

    steps = _steps(store.recipes)
    parts = steps.select("doc_id", "root", F.posexplode("digests").alias("pos", "digest")).join(store.chunks, "digest")
    parts = parts.groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
    return store.recipes.select("doc_id", "root").join(parts, ["doc_id", "root"], "left").mapInArrow(ids, "doc_id long, root binary, ids array<int>")


def _parents(level: DataFrame, height: int) -> DataFrame:
    """The nodes above: those whose numbers differ in the last FANOUT bits only are one, their roots hashed in order."""
    up = level.groupBy(F.shiftright("number", FANOUT).alias("number")).agg(F.sum("documents").alias("documents"), F.sort_array(F.collect_list(F.struct("number", "root"))).alias("rows"))
    return up.select(F.lit(height).alias("height"), "number", "documents", F.sha2(F.concat_ws("|", F.transform("rows", lambda x: x["root"])), 256).alias("root"))


def leaves(recipes: DataFrame, buckets: int) -> DataFrame:
    """Lowest level of the manifest: the roots of the documents of each bucket, hashed in order of doc_id and root. The buckets' number is a power of two and bounds the groups."""
    leaf = recipes.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("number"), "doc_id", F.lower(F.hex("root")).alias("root"))
    level = leaf.groupBy("number").agg(F.count("*").alias("documents"), F.sort_array(F.collect_list(F.struct("doc_id", "root"))).alias("rows"))
    return level.select(F.lit(0).alias("height"), "number", "documents", F.sha2(F.concat_ws("|", F.transform("rows", lambda x: F.concat_ws(":", x["doc_id"].cast("string"), x["root"]))), 256).alias("root"))


def buckets_for(n: int) -> int:
    """Buckets of some thousand of n documents at most."""
    return 1 << max(0, (n // BUCKET).bit_length())


def manifest(recipes: DataFrame, buckets: int | None = None) -> DataFrame:
    """height, number, documents, root: a tree over the documents, from buckets of them (height 0) in steps of 2^FANOUT to one node for the corpus, the highest."""
    buckets = buckets or buckets_for(recipes.count())
    level = materialise(leaves(recipes, buckets))
    out, height, width = level, 0, buckets
    while width > 1 or not height:
        height, width = height + 1, width >> FANOUT
        level = materialise(_parents(level, height))
        out = out.unionByName(level)
    if level.isEmpty():
        return recipes.sparkSession.createDataFrame([(height, 0, 0, hashlib.sha256(b"").hexdigest())], "height int, number long, documents long, root string")
    return out
