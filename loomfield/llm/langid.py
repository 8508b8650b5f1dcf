"""Operator 7: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is completed into a table: state and symbol
give the next state and the phrases that end there. A text is parsed greedily into the longest
pieces that occur in the language's text; the language that needs the fewest phrases, normalised as
bits = phrases * log2(length of its text) / symbols, wins.

Symbols are folded UTF-8 bytes of letters; every run of other characters counts as one blank. Texts
are parsed whole, in blocks of BLOCK symbols, with which a phrase ends (so that one very long text
is no straggler); all texts of a batch advance together, one symbol a step, in numpy.

Labelled text: at most PER_LANGUAGE bytes in whole documents for each language, those of
least hash. Ties go to the language first in the alphabet. A text without letters has no language and
is rejected; so is one whose best bits exceed the limit: from 200 symbols on MARGIN times the largest of held-out labelled
documents, for shorter ones NEAR times the largest of pieces of these that are as long. Null texts count as empty. Repeated rows each get their verdict. With no labelled text
every document is rejected (language null). Extra columns are ignored, in `accept` passed through.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import lean, shared_dir, write_bytes

#: Bounds of the labelled sample for each language: bytes of symbols and documents looked at.
PER_LANGUAGE, DOCUMENTS = 48_000, 60
#: Lengths in characters of documents that may serve as labelled text.
LENGTHS = (300, 6_000)
BLOCK = 1024
MARGIN = 1.7
#: Lengths of held-out pieces for which limits are fitted, and how far a text may be beyond the worst of them. A short text's bits vary, so its limit is near what chance gives.
SHORT, NEAR = (1, 2, 5, 10, 20, 50, 100), 1.15

_LETTER = tv.WORD.copy()
_LETTER[48:58] = False
_BLANK = 32

SCHEMA = "doc_id long, language string, phrases long, symbols long, bits double, margin double, mean_match double, accepted boolean"


def symbols(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters with one blank for each run of other bytes, none at the ends of a row; and the rows' offsets."""
    n = len(raw)
    if not n:
        return raw, off
    b, letter = tv.fold(raw), _LETTER[raw]
    before = np.empty(n, bool)
    before[0], before[1:] = False, letter[:-1]
    starts = off[:-1][off[:-1] < n]
    before[starts] = False
    keep = letter | before
    b[~letter] = _BLANK
    at = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    out, off = b[keep], at[off]
    lens = np.diff(off)
    trailing = np.flatnonzero((lens > 0) & (out[np.maximum(off[1:] - 1, 0)] == _BLANK)) if len(out) else np.zeros(0, np.int64)
    if len(trailing):
        gone = np.zeros(len(lens), np.int64)
        gone[trailing] = 1
        keep = np.ones(len(out), bool)
        keep[off[1:][trailing] - 1] = False
        out, off = out[keep], off - np.r_[0, np.cumsum(gone)]
    return out, off


def automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of text, state 0 first."""
    trans: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(trans[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


@dataclass
class Parser:
    """The completed tables of all languages, one after another."""

    names: list[str]
    table: np.ndarray  # (state * alphabet + symbol) -> state * 4 + phrases that end
    base: np.ndarray
    code: np.ndarray
    alphabet: int
    log_length: np.ndarray

    @staticmethod
    def of(texts: dict[str, bytes]) -> Parser:
        names = sorted(texts)
        code = np.zeros(256, np.int32)
        used = sorted(set().union(*map(set, texts.values())) - {0}) if texts else []
        code[used] = np.arange(1, len(used) + 1)
        alphabet = len(used) + 1
        tables, base, at = [], [], 0
        for name in names:
            trans = automaton(texts[name])
            root = np.full(alphabet, at * 4, np.int32)
            known = np.zeros(alphabet, bool)
            for c, to in trans[0].items():
                if c:
                    root[code[c]], known[code[c]] = (at + to) * 4, True
            whole = np.tile(root + np.where(known, 1, 2).astype(np.int32), (len(trans), 1))
            whole[0] = root + np.where(known, 0, 1)
            sizes = [len(t) for t in trans]
            froms = np.repeat(np.arange(len(trans)), sizes)
            symbol = np.fromiter((c for t in trans for c in t), np.int64, sum(sizes))
            to = np.fromiter((x for t in trans for x in t.values()), np.int64, sum(sizes))
            ok = symbol > 0
            whole[froms[ok], code[symbol[ok]]] = (at + to[ok]) * 4
            tables.append(whole.ravel())
            base.append(at)
            at += len(trans)
        return Parser(names, np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(base, np.int64), code, alphabet, np.array([math.log2(max(2, len(texts[x]))) for x in names]))

    def phrases(self, sym: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each row under each language."""
        rows, langs = len(off) - 1, len(self.names)
        lens = np.diff(off)
        out = np.zeros((langs, rows), np.int64)
        blocks = -(-lens // BLOCK)
        if not langs or not blocks.sum():
            return out
        row = np.repeat(np.arange(rows), blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = off[row] + nth * BLOCK
        size = np.minimum(BLOCK, off[row + 1] - begin)
        order = np.argsort(-size, kind="stable")
        row, begin, size = row[order], begin[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, BLOCK + 1), side="right")
        codes = self.code[sym]
        state = np.repeat(self.base[:, None], len(row), axis=1).astype(np.int32)
        count = np.zeros((langs, len(row)), np.int32)
        for j in range(BLOCK):
            a = active[j]
            if not a:
                break
            x = self.table[state[:, :a] * self.alphabet + codes[begin[:a] + j]]
            count[:, :a] += x & 3
            state[:, :a] = x >> 2
        count += state != self.base[:, None]
        for k in range(langs):
            out[k] = np.bincount(row, weights=count[k], minlength=rows)
        return out


_tables: dict[str, np.ndarray] = {}


@dataclass
class Model:
    """Labelled text by language and the limit of bits by length. The tables are made once, on the driver; `publish` writes them to a file in the shared folder, and tasks map it."""

    texts: dict[str, bytes]
    limits: list[tuple[int, float]] = field(default_factory=list)
    made: Parser | None = None
    file: str | None = None

    def parser(self) -> Parser:
        if self.made is None:
            self.made = Parser.of(self.texts)
        if self.file is None or len(self.made.table):
            return self.made
        if self.file not in _tables:
            _tables.clear()
            # A shared folder that is a file system of the machine is mapped as it is; of another one, each executor has fetched its copy.
            local = self.file.removeprefix("file://") if self.file.startswith(("file:/", "/")) else SparkFiles.get(os.path.basename(self.file))
            _tables[self.file] = np.memmap(local.removeprefix("file:"), np.int32, "r")
        return replace(self.made, table=_tables[self.file])

    def publish(self, spark: SparkSession) -> Model:
        """A model to travel with the tasks: without its tables, which lie in a file."""
        parser = self.parser()
        if not len(parser.table):
            return self
        path = os.path.join(shared_dir(spark), f"language-{uuid.uuid4().hex}")
        write_bytes(spark, path, parser.table.tobytes())
        if not path.startswith(("file:/", "/")):
            spark.sparkContext.addFile(path)
        return Model(self.texts, self.limits, replace(parser, table=np.zeros(0, np.int32)), path)

    def limit(self, lens: np.ndarray) -> np.ndarray:
        """Of texts of these lengths; between two lengths that were fitted, by the line between them."""
        if not self.limits:
            return np.full(len(lens), np.inf)
        return np.interp(lens, *zip(*sorted(self.limits), strict=True))


@dataclass
class Verdicts:
    language: np.ndarray
    phrases: np.ndarray
    symbols: np.ndarray
    bits: np.ndarray
    margin: np.ndarray
    accepted: np.ndarray


def judge(model: Model, raw: np.ndarray, off: np.ndarray) -> Verdicts:
    """best language of each row (-1: none)."""
    sym, at = symbols(raw, off)
    lens = np.diff(at)
    if not model.texts:
        nothing = np.zeros(len(lens))
        return Verdicts(np.full(len(lens), -1), nothing.astype(np.int64), lens, nothing, nothing, nothing > 0)
    parser = model.parser()
    count = parser.phrases(sym, at)
    bits = count * parser.log_length[:, None] / np.maximum(1, lens)
    best = bits.argmin(axis=0)
    ordered = np.sort(bits, axis=0)
    margin = ordered[1] - ordered[0] if len(ordered) > 1 else np.zeros(len(lens))
    least = ordered[0]
    some = lens > 0
    return Verdicts(np.where(some, best, -1), np.take_along_axis(count, best[None], 0)[0], lens, least, margin, some & (least <= model.limit(lens)))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, documents: int = DOCUMENTS) -> Model:
    """Labelled text of a bounded sample: in each language the documents of least hash, of usual length."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.length("text").between(*LENGTHS))
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = labelled.select("lang", "doc_id", "text").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= documents)
    names: dict[str, list[bytes]] = {}
    for lang, _, text in sorted((r.lang, r.nth, r.text) for r in chosen.collect()):
        raw = text.encode()
        sym, _ = symbols(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        names.setdefault(lang, []).append(sym.tobytes())
    texts, held = {}, []
    for lang, parts in names.items():
        kept, total = [], 0
        for k, part in enumerate(parts):
            if k % 5 == 4:
                held.append(part)
            elif total < per_language:
                kept.append(part)
                total += len(part)
        texts[lang] = b"\0".join(kept)
    model = Model(texts)
    if held:
        worst = lambda parts: float(judge(model, np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(x) for x in parts])]).bits.max())
        model.limits = [(200, MARGIN * worst(held))]
        for n in SHORT:
            pieces = [part[a : a + n] for part in held for a in range(0, len(part) - n + 1, n)]
            if pieces:
                model.limits.append((n, max(NEAR * worst(pieces), model.limits[0][1])))
    return model


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """One row of SCHEMA for each document."""
    names = sorted(model.texts)
    model = model.publish(docs.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tv.strings(batch.column(1))
            for lo, hi in tv.slices(off):
                v = judge(model, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                language = pa.array([names[k] if k >= 0 else None for k in v.language], pa.string())
                mean = np.where(v.phrases > 0, v.symbols / np.maximum(1, v.phrases), 0.0)
                cols = [batch.column(0).slice(lo, hi - lo), language, pa.array(v.phrases), pa.array(v.symbols), pa.array(v.bits), pa.array(v.margin), pa.array(mean), pa.array(v.accepted)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "language", "phrases", "symbols", "bits", "margin", "mean_match", "accepted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(parse), SCHEMA)


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that have an accepted language, with all their columns."""
    place = docs.columns.index("text")
    model = model.publish(docs.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = tv.strings(batch.column(place))
            mask = [judge(model, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).accepted for lo, hi in tv.slices(off)]
            if mask:
                yield batch.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(lean(parse), docs.schema)
