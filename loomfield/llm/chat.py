"""Operator 10: conversations as prefix trees, their shared turns emitted once.

A turn is rendered as its role and its text with a closing token. A conversation is a path of turns;
conversations with the same initial turns share the nodes of these. Each node has a chained digest of its path.

The least conversation that has a node owns it. What a conversation owns is the end of its path, a chain, which hangs on a node of
another one's. Depth first, a chain comes as a whole, then the chains that hang on it, from its last node to its first and by conversation; a
node's `start` is the number of tokens before it in its tree. So the ancestors of a node are one interval of each chain on its path, and
nothing here is longer than the path in chains: turns carry digests, not paths, and texts are moved once, at the end.

`position` is that of the node's first token in its conversations (what comes before it on its path),
and `attends` the intervals of tokens, as counted by `start`, that a token of the node may see
before its own node, merged where they touch: those of its ancestors. Within the node attention is causal.

Chains are sorted by range over all executors and the running sums taken over parts of the order, so that one first turn that most conversations share is
no straggler. `conversations` are those that end at the node; of a node with more than ENDS the list goes on in further rows, of `part` 1, 2, ..., without tokens.

Turns of a conversation stand in order of turn (null last), the first HEAD characters of role and text, and their digest; rows alike in turn, role and text count
once. Null roles and texts are empty. Rows without conv_id are skipped. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, materialise
from .pieces import SLICE, Pieces, encoder

#: Closing token of a turn in the vocabulary used: the end of a sequence.
CLOSE = 2
#: Characters of role and text by which turns of the same number are sorted, and conversations in a row of the result.
HEAD, ENDS = 16, 5_000

_KEY = "conv_id long, late boolean, turn long, own binary"
_STEP = _KEY + ", depth int, node binary, parent binary, n long, ends boolean"
_PAIRS = "array<struct<start:bigint,end:bigint>>"


def rendered(role: str, text: str) -> str:
    return f"{role}\n{text}"


def _encoded(model: Pieces, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows, their token ids one after another, and the offsets of each row."""
    enc = encoder(model)
    raw, off = tv.strings(texts)
    for lo, hi in tv.slices(off, SLICE):
        e = enc.encode(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        yield lo, hi, e.ids, e.offsets()


def _counted(model: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with the number of tokens instead of the text, their last column."""
        for batch in batches:
            n = [np.diff(at) + 1 for _, _, _, at in _encoded(model, batch.column("text"))]
            if n:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(n).astype(np.int64))], [*batch.schema.names[:-1], "n"])

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps of conversations that come one after another in order; each row waits for the next one, to know whether it ends."""
    names = [x.split()[0] for x in _STEP.split(", ")]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    waiting = None

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        out = []
        for conv, late, turn, own, n in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "late", "turn", "own", "n")], strict=True):
            depth, parent = 1, b""
            if waiting is not None and waiting[0] == conv:
                if waiting[1:4] == (late, turn, own):
                    continue
                depth, parent = waiting[4] + 1, waiting[5]
            if waiting is not None:
                out.append((*waiting, waiting[0] != conv))
            node = hashlib.blake2b(parent + own, digest_size=16).digest()
            waiting = (conv, late, turn, own, depth, node, parent or None, n)
        if out:
            yield made(out)
    if waiting is not None:
        yield made([(*waiting, True)])


def said(turns: DataFrame) -> DataFrame:
    """conv_id, late (no turn is given), turn, own (digest of role and text), text as rendered."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit("\n"), text)))
    rows = turns.where(F.col("conv_id").isNotNull())
    number = F.col("turn").cast("long")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), number.isNull().alias("late"), F.coalesce(number, F.lit(0)).alias("turn"), own.alias("own"), F.substring(role, 1, HEAD).alias("who"), F.substring(text, 1, HEAD).alias("begins"), F.concat(role, F.lit("\n"), text).alias("text"))


def steps(source: DataFrame, model: Pieces) -> DataFrame:
    """Each conversation's turns in order, with the node that each leads to and its parent, and its number of tokens."""
    counted = source.mapInArrow(_counted(model), _KEY + ", who string, begins string, n long")
    order = ["conv_id", "late", "turn", "who", "begins", "own"]
    return materialise(counted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "late", "turn", "own", "n").mapInArrow(_chained, _STEP))


def owned(path: DataFrame) -> DataFrame:
    """The steps whose conversation owns the node, with `inner`, the tokens before it in its chain, and `first`, the depth at which the chain begins."""
    owners = path.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"))
    # A conversation owns its path from some depth on.
    first = owners.groupBy("conv_id").agg(F.min("depth").alias("first"))
    by = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(path.join(first, "conv_id").where("depth >= first").withColumn("inner", F.coalesce(F.sum("n").over(by), F.lit(0))).drop("ends"))


def chains(mine: DataFrame) -> DataFrame:
    """chain (a conversation), total (tokens), key (its place in depth-first order) and links (chain, upto) to those above it, whose first `upto` tokens are before it."""
    heads = mine.groupBy(F.col("conv_id").alias("chain")).agg(F.sum("n").alias("total"), F.min("first").alias("first"), F.min_by("parent", "depth").alias("node"))
    above = mine.select("node", F.col("conv_id").alias("up"), (F.col("inner") + F.col("n")).alias("upto"))
    linked = heads.join(above, "node", "left")
    key = F.array(F.struct((-F.col("first")).alias("hangs"), F.col("chain").alias("chain")))
    link = F.when(F.col("up").isNotNull(), F.array(F.struct(F.col("up").alias("chain"), "upto"))).otherwise(F.array().cast("array<struct<chain:bigint,upto:bigint>>"))
    out = materialise(linked.select("chain", "total", "up", key.alias("key"), link.alias("links")))
    while not out.where("up is not null").isEmpty():
        # Each round doubles the part of the path upwards that a chain knows.
        b = out.select(F.col("chain").alias("up"), F.col("up").alias("far"), F.col("key").alias("k"), F.col("links").alias("l"))
        joined = out.join(b, "up", "left").select("chain", "total", F.col("far").alias("up"), F.when(F.col("k").isNull(), F.col("key")).otherwise(F.concat("k", "key")).alias("key"), F.when(F.col("l").isNull(), F.col("links")).otherwise(F.concat("l", "links")).alias("links"))
        done, out = out, materialise(joined)
        discard(done)
    return out


def placed(out: DataFrame) -> DataFrame:
    """chain, tree (its first chain), begin (tokens before it in its tree), spans and position (the intervals above it and their tokens)."""
    order = out.select("chain", "total", "key", F.col("key")[0]["chain"].alias("tree"))
    # Sorted by range; each part has a number, and parts come in order.
    sorted_ = materialise(order.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("key"))
    within = Window.partitionBy("part", "tree").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sorted_.groupBy("tree", "part").agg(F.sum("total").alias("all"))
    before = sums.select("tree", "part", F.coalesce(F.sum("all").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    begin = sorted_.withColumn("inner", F.coalesce(F.sum("total").over(within), F.lit(0))).join(before, ["tree", "part"])
    begin = materialise(begin.select("chain", "tree", (F.col("before") + F.col("inner")).alias("begin")))
    discard(sorted_)
    links = out.select(F.col("chain").alias("of"), F.explode("links").alias("l")).select("of", F.col("l.chain").alias("chain"), F.col("l.upto").alias("upto"))
    spans = links.join(begin.select("chain", F.col("begin").alias("start")), "chain").groupBy("of").agg(F.sum("upto").alias("position"), F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("upto")).alias("end")))).alias("spans"))
    return begin.join(spans, F.col("chain") == F.col("of"), "left").select("chain", "tree", "begin", F.coalesce("position", F.lit(0)).alias("position"), F.coalesce("spans", F.array().cast(_PAIRS)).alias("spans"))


def _merged(spans):
    """Intervals in order, as one where they touch."""
    last = lambda done: F.try_element_at(done, F.lit(-1))
    longer = lambda done, x: F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), x["end"].alias("end"))))
    return F.aggregate(spans, F.array().cast(_PAIRS), lambda done, x: F.when((F.size(done) > 0) & (last(done)["end"] == x["start"]), longer(done, x)).otherwise(F.concat(done, F.array(x))))


def _tokens(model: Pieces, close: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with token ids instead of the text, their last column."""
        for batch in batches:
            for lo, hi, ids, at in _encoded(model, batch.column("text")):
                flat = np.insert(ids, at[1:], close)
                col = pa.ListArray.from_arrays(pa.array((at + np.arange(len(at))).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], col], [*batch.schema.names[:-1], "ids"])

    return run


def trees(turns: DataFrame, model: Pieces, close: int = CLOSE) -> DataFrame:
    """tree, node, parent, depth, start, position, n, ids, attends, conversations, part; for each node of each tree."""
    source = said(turns)
    path = steps(source, model)
    mine = owned(path)
    info = placed(chains(mine))
    nodes = mine.join(info, F.col("conv_id") == F.col("chain"))
    start = F.col("begin") + F.col("inner")
    before = F.when(F.col("inner") > 0, F.concat("spans", F.array(F.struct(F.col("begin").alias("start"), start.alias("end"))))).otherwise(F.col("spans"))
    nodes = nodes.select("conv_id", "late", "turn", "own", "tree", "node", "parent", "depth", start.alias("start"), (F.col("position") + F.col("inner")).alias("position"), "n", _merged(before).alias("attends"))
    ends = path.where("ends").select("node", "conv_id")
    many = ends.groupBy("node").agg(F.ceil(F.count("*") / ENDS).cast("int").alias("parts"))
    lists = ends.join(many, "node").groupBy("node", F.pmod(F.xxhash64("conv_id"), F.col("parts")).cast("int").alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("conversations"))
    none = F.array().cast("array<long>")
    key = ["conv_id", "late", "turn", "own"]
    nodes = nodes.join(lists.where("part = 0").drop("part"), "node", "left").withColumn("conversations", F.coalesce("conversations", none))
    # The texts of the owners' turns: the only exchange of texts, by the key of a turn, which says which rows are alike as well.
    texts = source.select(*key, "text").join(mine.select(*key).hint("shuffle_hash"), key, "left_semi").dropDuplicates(key)
    full = nodes.join(texts, key)
    shown = ["tree", "node", "parent", "depth", "start", "position", "n", "attends", "conversations"]
    out = full.select(*shown, "text").mapInArrow(_tokens(model, close), f"tree long, node binary, parent binary, depth int, start long, position long, n long, attends {_PAIRS}, conversations array<long>, ids array<int>")
    more = lists.where("part > 0").join(mine.select("node", "parent", "depth", "conv_id"), "node").join(info.select(F.col("chain").alias("conv_id"), "tree"), "conv_id")
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    whole = ["tree", hexed("node"), hexed("parent"), "depth", "start", "position", "n", "ids", "attends", "conversations", "part"]
    absent = {"start": "long", "position": "long"}
    rest = more.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()} | {"n": F.lit(0).cast("long"), "ids": F.array().cast("array<int>"), "attends": F.array().cast(_PAIRS)})
    return out.withColumn("part", F.lit(0)).select(*whole).unionByName(rest.select(*whole))
