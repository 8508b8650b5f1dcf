"""Exact and approximate nearest neighbours of batches of query vectors."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyarrow.parquet import ParquetFile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import materialise
from .ranking import DIGITS, FINE, Params, allowed, best_fields, budget, cut, finish, level, merge_neighbors

#: Query vectors that travel with the tasks; of more, so many are a block.
QUERIES_AT_ONCE = 2_048
#: Vectors that a block of queries is shown at a time, queries of which the products are taken at a time, pairs that are scored in double at a time, hits that stay in memory.
PACK, STEP, PAIRS, KEPT = 2_048, 256, 1 << 14, 2_000_000
_SCORED = "q_id long, id long, field_idx int, score double"


@dataclass
class VectorIndex:
    """vectors(id, field_idx, embedding) with a metric and a precision; several vectors of an id are its fields."""

    vectors: DataFrame
    metric: str
    precision: str
    max_fields: int
    avg_fields: float
    #: Cells of the vectors, where they were made; inexact searches without an allow set look at some of these only.
    inverted: Inverted | None = None


def build(vectors: DataFrame, metric: str | None = None, precision: str = "float32") -> VectorIndex:
    metric, precision = V.metric(metric, precision)
    per = vectors.groupBy("id").count().agg(F.max("count").alias("m"), F.avg("count").alias("a")).first()
    return VectorIndex(vectors.select("id", F.col("field_idx").cast("int").alias("field_idx"), "embedding"), metric, precision, int(per.m or 1), float(per.a or 1))


def attach(fields: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors (n, embedding) joined to fields (id, field_idx, field_id) by position; their numbers must be equal."""
    a, b = fields.count(), vectors.count()
    if a != b:
        raise ValueError(f"{b} vectors for {a} fields")
    return fields.join(vectors, fields.field_id == vectors.n).select("id", "field_idx", "embedding")


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def _best(s: np.ndarray, rows: np.ndarray, fields: np.ndarray, most: int, least: float | None, names: np.ndarray, apart: bool, items: bool, digits: int = DIGITS) -> tuple[np.ndarray, ...]:
    """For each row of scores s, under its name, the best `most` of the columns (rows and fields, in order of rows, the last field first); items: the best column of each row number only."""
    if items and len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        if len(starts) < len(rows):
            top = np.maximum.reduceat(s, starts, axis=1)
            per = np.diff(np.r_[starts, len(rows)])
            # Among equal scores the first field, which is the last column of its row number.
            at = np.maximum.reduceat(np.where(s == np.repeat(top, per, axis=1), np.arange(len(rows)), -1), starts, axis=1)
            fields, s, rows = fields[at], top, rows[starts]
    out = []
    for k in range(len(names)):
        ok = np.ones(len(rows), bool) if least is None else s[k] >= least
        if apart:
            ok &= rows != names[k]
        pick = np.flatnonzero(ok)
        if len(pick) > most:
            pick = pick[np.argsort(-level(s[k][pick], digits), kind="stable")[:most]]
        out.append((np.full(len(pick), k), pick))
    who, pick = (np.concatenate(z) for z in zip(*out, strict=True))
    field = fields[who, pick] if fields.ndim == 2 else fields[pick]
    return who, rows[pick], field, s[who, pick]


class _Top:
    """The best `most` of the vectors that a block of queries is shown, some at a time; apart: queries of one name are one, by their best score, and no item is its own hit; items: one vector of each item.

    Products are taken in single precision first. Pairs that may be among the best, by a bound of the error, are scored in double, so the hits are those of double precision.
    """

    def __init__(self, metric: str, precision: str, ids: np.ndarray, q: np.ndarray, most: int, least: float | None, apart: bool, items: bool, digits: int = DIGITS) -> None:
        self.metric, self.precision, self.most, self.least, self.apart, self.items, self.digits = metric, precision, most, least, apart, items, digits
        self.names, self.of = ids, np.arange(len(ids))
        if apart:
            by = np.argsort(ids, kind="stable")
            q = q[by]
            self.names, self.of = np.unique(ids[by], return_inverse=True)
        self.q = V.quantized(q, precision)
        self.near = V.rough(metric, self.q, True)
        self.long = np.linalg.norm(self.near.astype(np.float64), axis=1)
        #: Score of the last of `most` hits of each name, once there are so many.
        self.floor = np.full(len(self.names), -np.inf)
        self.clear()

    def clear(self) -> None:
        self.kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float64))
        self.more: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: np.ndarray, fields: np.ndarray, x: np.ndarray, only: np.ndarray | None = None) -> None:
        """Vectors with their items and fields. only: the queries (not apart) that look at them."""
        order = np.lexsort((-fields, rows))
        rows, fields, x = rows[order], fields[order].astype(np.int64), V.quantized(x[order], self.precision)
        y = V.rough(self.metric, x, False)
        slack = (y.shape[1] + 8) * 2.0**-23 * np.linalg.norm(y.astype(np.float64), axis=1).max()
        every = np.arange(len(self.q)) if only is None else only
        new = False
        for a in range(0, len(every), STEP):
            w = every[a : a + STEP]
            fresh = np.isneginf(self.floor[self.of[w]])
            if fresh.any():
                new = True
                self._dense(w[fresh], rows, fields, x)
                w = w[~fresh]
            if len(w):
                self._sparse(w, rows, fields, x, y, slack)
        if new or sum(len(m[0]) for m in self.more) > 1_024 + len(self.kept[0]) // 4:
            self._merge()

    def _dense(self, w: np.ndarray, rows: np.ndarray, fields: np.ndarray, x: np.ndarray) -> None:
        s, of = V.scores(self.metric, self.q[w], x), self.of[w]
        if self.apart:
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            s, of = np.maximum.reduceat(s, starts, axis=0), of[starts]
        who, *rest = _best(s, rows, fields, self.most, self.least, self.names[of], self.apart, self.items, self.digits)
        self.more.append((of[who], *rest))

    def _sparse(self, w: np.ndarray, rows: np.ndarray, fields: np.ndarray, x: np.ndarray, y: np.ndarray, slack: float) -> None:
        floor = self.floor[self.of[w]]
        least = floor if self.least is None else np.maximum(floor, self.least)
        t = V.needed(self.metric, self.q[w], least - 1e-8)
        t = (t - slack * self.long[w] - 2.0**-22 * np.abs(t)).astype(np.float32)
        # What is no number stays in.
        hit = np.flatnonzero(~(self.near[w] @ y.T < t[:, None]))
        if not len(hit):
            return
        r, c = np.divmod(hit, len(rows))
        if self.apart:
            other = rows[c] != self.names[self.of[w[r]]]
            r, c = r[other], c[other]
        if len(r) > len(w) * len(rows) // 8:
            return self._dense(w, rows, fields, x)
        for a in range(0, len(r), PAIRS):
            k, z = r[a : a + PAIRS], c[a : a + PAIRS]
            s = V.paired(self.metric, self.q[w[k]], x[z])
            ok = ~(level(s, self.digits) < level(floor[k], self.digits))
            if self.least is not None:
                ok &= s >= self.least
            self.more.append((self.of[w[k[ok]]], rows[z[ok]], fields[z[ok]], s[ok]))

    def _merge(self) -> None:
        name, rows, fields, s = (np.concatenate(z) for z in zip(self.kept, *self.more, strict=True))
        self.more = []
        if self.items or self.apart:
            one = (rows, name) if self.items else (fields, rows, name)
            by = np.lexsort((fields, -s, *one))
            first = np.zeros(len(by), bool)
            first[:1] = True
            for key in one:
                first[1:] |= key[by][1:] != key[by][:-1]
            by = by[first]
            name, rows, fields, s = name[by], rows[by], fields[by], s[by]
        by = np.lexsort((-fields, rows, -level(s, self.digits), name))
        starts = np.searchsorted(name[by], np.arange(len(self.names)))
        place = np.arange(len(by)) - starts[name[by]]
        last = by[place == self.most - 1]
        self.floor[name[last]] = np.fmax(self.floor[name[last]], s[last])
        by = by[place < self.most]
        self.kept = name[by], rows[by], fields[by], s[by]

    def full(self) -> bool:
        """Whether what is kept should leave before the rest is seen."""
        return len(self.kept[0]) + sum(len(m[0]) for m in self.more) > KEPT

    def batch(self) -> pa.RecordBatch:
        self._merge()
        name, rows, fields, s = self.kept
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(self.names[name]), pa.array(rows), pa.array(fields.astype(np.int32)), pa.array(s)], ["q_id", "id", "field_idx", "score"])


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, most):
            yield b.slice(a, most)


def _store(df: DataFrame, *ids: str) -> tuple[list[str], str]:
    """Write df's rows in the shared folder, up to PACK in one: n, and the bytes of the id columns (64 bits) and of the vectors. Rows in one have the same value of `cell`, if that is the first of ids. The files' addresses, and the numbers' type."""
    width = "<f8" if df.schema["embedding"].dataType.elementType.typeName() == "double" else "<f4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, PACK):
            cells = b.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(cells[1:] != cells[:-1]) + 1 if ids[0] == "cell" else np.zeros(0, np.int64), b.num_rows].astype(int)
            parts = [b.slice(lo, hi - lo) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            cols = [pa.array([np.ascontiguousarray(p.column(k).to_numpy(), "<i8").tobytes() for p in parts], pa.binary()) for k in range(len(ids))]
            x = pa.array([_matrix(p.column(len(ids))).astype(width).tobytes() for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([p.num_rows for p in parts], pa.int32()), *cols, x], ["n", *ids, "x"])

    packed = df.select(*ids, "embedding").mapInArrow(pack, "n int, " + "".join(f"{c} binary, " for c in ids) + "x binary")
    return sorted(materialise(packed).inputFiles()), width


def _stored(files: list[str], width: str, *ids: str) -> Iterator[tuple[np.ndarray, ...]]:
    """What _store wrote, row by row: a column for each of ids, and the vectors."""
    for uri in files:
        fs, path = FileSystem.from_uri(uri)
        with fs.open_input_file(path) as f:
            for b in ParquetFile(f, buffer_size=1 << 20, pre_buffer=False).iter_batches(batch_size=1):
                n = b.column("n")[0].as_py()
                yield (*(np.frombuffer(b.column(c)[0].as_buffer(), "<i8") for c in ids), np.frombuffer(b.column("x")[0].as_buffer(), width).reshape(n, -1))


def _asked(queries: DataFrame, top, few, many) -> DataFrame:
    """Candidates of queries (q_id, embedding) by top(ids, vectors), a _Top. Up to QUERIES_AT_ONCE queries travel with the tasks over the vectors: few(ids, vectors) is these. Of more, each task
    takes blocks and shows each of them all vectors, which many(top) does piece by piece from files; nothing but a block, a piece and the hits is in memory."""
    queries = queries.select("q_id", "embedding")
    spark = queries.sparkSession
    first = queries.limit(QUERIES_AT_ONCE + 1).collect()
    if not first:
        return spark.createDataFrame([], _SCORED)
    if len(first) <= QUERIES_AT_ONCE:
        return few(np.array([r.q_id for r in first], np.int64), np.array([r.embedding for r in first], np.float64))
    show, at_once = many(), QUERIES_AT_ONCE
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-queries.count() // at_once))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches, at_once):
            t = top(b.column(0).to_numpy(), _matrix(b.column(1)))
            for _ in show(t):
                if t.full():
                    yield t.batch()
            yield t.batch()

    return queries.repartition(parts).mapInArrow(over, _SCORED)


def scored(index: VectorIndex, queries: DataFrame, params: Params, allow: DataFrame | None = None, apart: bool = False) -> DataFrame:
    """Candidates of queries (q_id, embedding), the best of each part of the vectors. apart: all vectors of a q_id are one query, by the best score, and no item is a candidate of its own."""
    source = allowed(index.vectors, allow).select("id", "field_idx", "embedding")
    again = bool(params.rerank and index.precision != "float32")
    items = (params.exact or apart) and not again
    most = params.k if items else budget(params, index.max_fields, index.avg_fields) if not (params.exact or apart) else int(np.ceil(params.k * (params.rerank or 1))) * max(1, index.max_fields)
    digits = FINE if again else DIGITS
    metric, precision, least = index.metric, index.precision, params.min_score

    def top(ids: np.ndarray, q: np.ndarray) -> _Top:
        return _Top(metric, precision, ids, q, most, least, apart, items, digits)

    def few(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = top(ids, q)
            for b in _pieces(batches, PACK):
                t.add(b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2)))
                if t.full():
                    yield t.batch()
            yield t.batch()

        return source.mapInArrow(over, _SCORED)

    def many():
        files, width = _store(source, "id", "field_idx")

        def show(t: _Top) -> Iterator[None]:
            for rows, fields, x in _stored(files, width, "id", "field_idx"):
                yield t.add(rows, fields, x)

        return show

    out = _asked(queries, top, few, many)
    if apart:
        # Vectors of one item may lie in several blocks of queries.
        out = out.groupBy("q_id", "id", "field_idx").agg(F.max("score").alias("score"))
    return cut(best_fields(out) if items else out, most, digits)


def rescored(candidates: DataFrame, index: VectorIndex, queries: DataFrame) -> DataFrame:
    """Candidates with the scores of their vectors as they were before quantisation."""
    metric = V.rerank_metric(index.metric)
    both = candidates.drop("score").join(index.vectors, ["id", "field_idx"]).join(queries.select("q_id", F.col("embedding").alias("q")), "q_id")
    return both.select("q_id", "id", "field_idx", V.score(metric, V.distance(metric, F.col("q"), F.col("embedding"))).alias("score"))


def search(index: VectorIndex, queries: DataFrame, params: Params = Params(), allow: DataFrame | None = None) -> DataFrame:
    """Hits of queries (q_id, embedding). The threshold holds before reranking, as a cut of candidates. With an allow set all allowed vectors are looked at, exact or not."""
    if index.inverted is not None and not params.exact and allow is None and not params.rerank:
        return search_inverted(index.inverted, queries, params)
    found = scored(index, queries, params, allow)
    if params.rerank and index.precision != "float32":
        return finish(rescored(found, index, queries), params, check_min=False)
    return finish(found, params)


def neighbors(index: VectorIndex, wanted: DataFrame, params: Params = Params(), allow: DataFrame | None = None) -> DataFrame:
    """Hits for the items of `wanted` (column id): all vectors of an item are queries, an item is not its own neighbour."""
    q = index.vectors.join(wanted.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("q_id"), "field_idx", "embedding")
    found = scored(index, q, params, allow, apart=True)
    if params.rerank and index.precision != "float32":
        found = rescored(found, index, q.drop("field_idx"))
    return merge_neighbors(found, params.k)


def item_vectors(index: VectorIndex, item: int) -> DataFrame:
    return index.vectors.where(F.col("id") == item)


@dataclass
class Inverted:
    """Vectors by the nearest of some centroids; a search looks at the cells of the nearest `probes` only, so many that held-out queries found `recall` of their neighbours."""

    cells: DataFrame  # cell, id, field_idx, embedding
    centroids: np.ndarray
    index: VectorIndex
    probes: int
    recall: float


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as cells see them: of length 1 for the metrics of angles."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n) if metric in ("cosine", "cosine-normalized") else x


def _far(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """The smaller, the nearer a cell: by inner product where that is the metric, else by distance."""
    return -x @ c.T if metric == "inner-product" else (c * c).sum(1) - 2 * x @ c.T


def invert(index: VectorIndex, cells: int | None = None, sample: int = 20_000, rounds: int = 10, seed: int = 3, recall: float = 0.9, held: int = 300, k: int = 10) -> Inverted:
    """k-means on a bounded sample, of least hash; every vector has a cell. About the root of the number of vectors are the cells (at most 4,096), unless told. probes: the fewest
    that give a share of at least `recall` (and half of what is missing from 1, as a margin) of the k nearest in the sample to `held` vectors of it that were left out of the centroids."""
    m = index.metric
    n = index.vectors.count()
    cells = cells or int(np.clip(round(n**0.5), 1, 4_096))
    rows = index.vectors.orderBy(F.xxhash64("id", "field_idx")).limit(sample).select("embedding").collect()
    x = _unit(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), -1), m)
    if not len(x):
        return Inverted(index.vectors.select(F.lit(0).alias("cell"), "id", "field_idx", "embedding"), np.zeros((1, 1)), index, 1, 1.0)
    r = np.random.default_rng(seed)
    test = r.permutation(len(x))[: min(held, len(x) // 2)]
    rest = np.delete(x, test, axis=0) if len(test) else x
    c = rest[r.choice(len(rest), min(cells, len(rest)), replace=False)]
    for _ in range(rounds):
        near = _far(rest, c, "l2").argmin(1)
        c = np.array([rest[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    probes, found = len(c), 1.0
    if len(test):
        s = V.scores("l2" if m == "hamming" else m, x[test], x)
        s[np.arange(len(test)), test] = -np.inf
        best = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
        own = _far(x, c, m).argmin(1)
        place = np.argsort(np.argsort(_far(x[test], c, m), axis=1), axis=1)
        # How many cells must be looked at for each neighbour.
        needed = np.take_along_axis(place, own[best], axis=1) + 1
        shares = np.array([(needed <= p).mean() for p in range(1, len(c) + 1)])
        probes = int(np.argmax(shares >= recall + (1 - recall) / 2)) + 1
        found = float(shares[probes - 1])

    def place_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(_far(_unit(_matrix(b.column(2)), m), c, m).argmin(1).astype(np.int32)), *b.columns], ["cell", "id", "field_idx", "embedding"])

    return Inverted(index.vectors.mapInArrow(place_, "cell int, id long, field_idx int, embedding array<float>"), c, index, probes, found)


def search_inverted(inv: Inverted, queries: DataFrame, params: Params = Params(), probes: int | None = None, allow: DataFrame | None = None) -> DataFrame:
    """Approximate hits: each block of queries meets the cells that some of its queries probe, and in a cell these queries only."""
    c, m, precision = inv.centroids, inv.index.metric, inv.index.precision
    probes = min(probes or inv.probes, len(c))
    source = allowed(inv.cells, allow).select("cell", "id", "field_idx", "embedding")

    def looked(x: np.ndarray) -> np.ndarray:
        """Whether a query looks at a cell."""
        out = np.zeros((len(x), len(c)), bool)
        np.put_along_axis(out, np.argsort(_far(_unit(x, m), c, m), axis=1)[:, :probes], True, axis=1)
        return out

    def top(ids: np.ndarray, q: np.ndarray) -> _Top:
        t = _Top(m, precision, ids, q, params.k, params.min_score, False, True)
        t.looked = looked(q)
        return t

    def add(t: _Top, cell: int, rows: np.ndarray, fields: np.ndarray, x: np.ndarray) -> None:
        only = np.flatnonzero(t.looked[:, cell])
        if len(only):
            t.add(rows, fields, x, only)

    def few(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = top(ids, q)
            for b in _pieces(batches, PACK):
                cells, rows, fields = (b.column(k).to_numpy() for k in range(3))
                x, by = _matrix(b.column(3)), np.argsort(cells, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(cells[by])) + 1):
                    add(t, cells[part[0]], rows[part], fields[part], x[part])
                if t.full():
                    yield t.batch()
            yield t.batch()

        return source.mapInArrow(over, _SCORED)

    def many():
        files, width = _store(source.repartitionByRange("cell", "id").sortWithinPartitions("cell"), "cell", "id", "field_idx")

        def show(t: _Top) -> Iterator[None]:
            for cell, rows, fields, x in _stored(files, width, "cell", "id", "field_idx"):
                yield add(t, cell[0], rows, fields, x)

        return show

    return finish(_asked(queries, top, few, many), params)


def write_embedded(fields: DataFrame, embed, path: str, spark: SparkSession) -> int:
    """Embed the fields (id, field_idx, value) that aren't in the table at `path` yet, and append them; how many were new."""
    try:
        done = spark.read.parquet(path).select("id", "field_idx")
        rest = fields.join(done, ["id", "field_idx"], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rest = fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(embed(b.column(2).to_pylist()), np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["id", "field_idx", "embedding"])

    n = rest.count()
    if n:
        rest.select("id", "field_idx", "value").mapInArrow(run, "id long, field_idx int, embedding array<float>").write.mode("append").parquet(path)
    return n


def index_table(vectors: DataFrame, path: str, metric: str | None = None, precision: str = "float32", cells: bool = False) -> None:
    """Write an index: its vectors, and the figures that a load would count; cells: and the vectors again by cell, in order of cells, with the centroids."""
    spark = vectors.sparkSession
    index = build(vectors, metric, precision)
    index.vectors.write.mode("overwrite").parquet(os.path.join(path, "vectors"))
    probes, recall = 0, 1.0
    if cells:
        inv = invert(VectorIndex(spark.read.parquet(os.path.join(path, "vectors")), index.metric, index.precision, index.max_fields, index.avg_fields))
        inv.cells.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(os.path.join(path, "cells"))
        rows = [(k, c.tolist()) for k, c in enumerate(inv.centroids)]
        spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "centroids"))
        probes, recall = inv.probes, inv.recall
    row = (index.metric, index.precision, index.max_fields, index.avg_fields, probes, recall)
    spark.createDataFrame([row], "metric string, precision string, max_fields int, avg_fields double, probes int, recall double").write.mode("overwrite").parquet(os.path.join(path, "figures"))


def load_table(spark: SparkSession, path: str) -> VectorIndex:
    f = spark.read.parquet(os.path.join(path, "figures")).first()
    index = VectorIndex(spark.read.parquet(os.path.join(path, "vectors")), f.metric, f.precision, f.max_fields, f.avg_fields)
    if f.probes:
        centroids = np.array([r.centroid for r in spark.read.parquet(os.path.join(path, "centroids")).orderBy("cell").collect()])
        index.inverted = Inverted(spark.read.parquet(os.path.join(path, "cells")), centroids, index, f.probes, f.recall)
    return index
