"""Keyword, fuzzy and full-text search of batches of queries over postings tables."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import require_text
from ..storage import materialise
from . import assignment
from .items import fields, stats
from .ranking import Params, allowed, budget, cut, finish

EXACT, PREFIX = 1.0, 0.75
K1, B = 1.2, 0.75
#: Queries are broadcast up to so many words of theirs; beyond, the joins are shuffled.
BROADCAST_WORDS = 200_000
#: Words of a batch of queries up to which they are a filter of the scan.
PUSHED_WORDS = 1_000
#: Characters of a field up to which its words are compared with each other, and bytes of items for each core up to which they are spread.
SHORT, SPLIT = 256, 16 << 20
#: Distances of keywords for which the edit distance is bounded by a literal.
BOUNDS = 32


@dataclass
class TextIndex:
    """postings(word, id, field_idx, occurrence, length) and vocabulary(word, df); and the figures of the items."""

    postings: DataFrame
    vocabulary: DataFrame
    max_fields: int
    avg_fields: float
    #: Fields that have a word, and their words on average; counted when they are asked for first.
    docs: int | None = None
    mean: float | None = None
    #: word, id, field_idx, length, pos, where the postings are made as they are read.
    words: DataFrame | None = None

    def lengths(self) -> tuple[int, float]:
        if self.docs is None:
            r = self.postings.where("pos = 0").agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
            self.docs, self.mean = int(r.docs), float(r.mean or 1.0)
        return self.docs, self.mean

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Postings in order of words, so that a query's words prune files and row groups."""
        self.postings.repartitionByRange("word").sortWithinPartitions("word", "id").write.mode(mode).parquet(os.path.join(path, "postings"))
        saved = self.postings.sparkSession.read.parquet(os.path.join(path, "postings"))
        vocabulary(saved).repartitionByRange("word").sortWithinPartitions("word").write.mode(mode).parquet(os.path.join(path, "vocabulary"))
        docs, mean = TextIndex(saved, saved, 0, 0).lengths()
        row = (self.max_fields, float(self.avg_fields), docs, mean)
        saved.sparkSession.createDataFrame([row], "max_fields int, avg_fields double, docs long, mean double").write.mode(mode).parquet(os.path.join(path, "figures"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        f = spark.read.parquet(os.path.join(path, "figures")).first()
        return TextIndex(spark.read.parquet(os.path.join(path, "postings")), spark.read.parquet(os.path.join(path, "vocabulary")), f.max_fields, f.avg_fields, f.docs, f.mean)


def _once(each: DataFrame) -> DataFrame:
    """Postings of short fields (id, field_idx, t): a word's occurrences are counted where it stands, without an exchange."""
    n = F.transform("t", lambda w, i: F.size(F.filter(F.slice("t", F.lit(1), i), lambda x: x == w)))
    n = F.when(F.size(F.array_distinct("t")) == F.size("t"), F.transform("t", lambda w: F.lit(0))).otherwise(n)
    rows = each.withColumn("t", F.arrays_zip(F.col("t").alias("word"), n.alias("occurrence")))
    rows = rows.select("id", "field_idx", F.size("t").alias("length"), F.posexplode("t").alias("pos", "x"))
    return rows.select("x.word", "id", "field_idx", "x.occurrence", "length", "pos")


def words_of(items: DataFrame, words=text.tokens) -> DataFrame:
    """word, id, field_idx, length, pos."""
    each = fields(require_text(_spread(items))).select("id", "field_idx", words(F.col("value")).alias("t"))
    return each.select("id", "field_idx", F.size("t").alias("length"), F.posexplode("t").alias("pos", "word")).select("word", "id", "field_idx", "length", "pos")


def postings(items: DataFrame, words=text.tokens) -> DataFrame:
    value = fields(require_text(_spread(items)))
    short = F.length("value") <= SHORT
    each = value.where(short).select("id", "field_idx", words(F.col("value")).alias("t"))
    rows = value.where(~short).select("id", "field_idx", words(F.col("value")).alias("t")).select("id", "field_idx", F.size("t").alias("length"), F.posexplode("t").alias("pos", "word"))
    by = Window.partitionBy("id", "field_idx", "word").orderBy("pos")
    return _once(each).unionByName(rows.select("word", "id", "field_idx", (F.row_number().over(by) - 1).alias("occurrence"), "length", "pos"))


def _spread(items: DataFrame) -> DataFrame:
    """items, over all cores if they are so few bytes that their files would be read by a few."""
    cores = items.sparkSession.sparkContext.defaultParallelism
    size = int(str(items._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return items.repartition(2 * cores, "id") if size < cores * SPLIT else items


def vocabulary(post: DataFrame) -> DataFrame:
    """word and the number of fields that hold it."""
    return post.where("occurrence = 0").groupBy("word").agg(F.count("*").alias("df"))


def build(items: DataFrame, words=text.tokens) -> TextIndex:
    post = postings(items, words)
    s = stats(items).first()
    return TextIndex(post, vocabulary(post), int(s.max_fields), float(s.avg_fields), words=words_of(items, words))


def query_words(queries: DataFrame, words=text.tokens) -> DataFrame:
    """q_id, kwi, kw, n of queries (q_id, query)."""
    return queries.select("q_id", words(F.col("query")).alias("t")).select("q_id", F.size("t").alias("n"), F.posexplode("t").alias("kwi", "kw"))


def _small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is small by count."""
    return F.broadcast(df) if df.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS else df


def prefix_matches(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """kw, word, w for each word of the vocabulary that is a keyword or begins with one: an equi-join on prefixes of the lengths that keywords have."""
    kw = words.select("kw").distinct()
    lengths = sorted(r.n for r in kw.select(F.length("kw").alias("n")).distinct().collect())
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("word"))
    starts = vocab.select("word", F.explode(F.transform(sizes, lambda n: F.substring("word", F.lit(1), n))).alias("kw"))
    return starts.join(_small(kw), "kw").select("kw", "word", F.when(F.col("kw") == F.col("word"), EXACT).otherwise(PREFIX).alias("w"))


def max_distance(kw: Column) -> Column:
    return F.floor((F.octet_length(kw) - 1) / 2).cast("int")


def fuzzy_matches(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """kw, word, w for each word within the keyword's distance: blocked by length, then the bounded distance."""
    kw = words.select("kw").distinct()
    lengths = kw.select("kw", max_distance(F.col("kw")).alias("d")).select("kw", "d", F.explode(F.sequence(F.greatest(F.lit(1), F.length("kw") - F.col("d")), F.length("kw") + F.col("d"))).alias("len"))
    pairs = vocab.select("word", F.length("word").alias("len")).join(_small(lengths), "len")
    # The bound of levenshtein is a literal, so each distance up to BOUNDS has a call of its own; beyond the bound it gives -1 after a few columns.
    most = [r.d for r in kw.select(max_distance(F.col("kw")).alias("d")).distinct().orderBy("d").limit(BOUNDS).collect()]
    e = F.levenshtein("kw", "word")
    for d in most:
        e = F.when(F.col("d") == d, F.levenshtein("kw", "word", d)).otherwise(e)
    near = pairs.withColumn("e", e).where((F.col("e") >= 0) & (F.col("e") <= F.col("d")))
    return near.select("kw", "word", F.greatest(1 - 0.25 * F.col("e"), F.lit(0.25)).alias("w"))


def _assigned(index: TextIndex, queries: DataFrame, matches, params: Params, allow: DataFrame | None) -> DataFrame:
    words = query_words(queries)
    # Stored, so that the vocabulary is made once.
    hit = materialise(words.join(matches(words, index.vocabulary), "kw"))
    found = allowed(index.postings, allow).join(_small(hit), "word")
    most = words.agg(F.max("n").alias("n")).first().n or 0
    scored = assignment.field_scores(found, most)
    if not params.exact:
        scored = cut(scored, budget(params, index.max_fields, index.avg_fields))
    return finish(scored, params)


def keyword(index: TextIndex, queries: DataFrame, params: Params = Params(), allow: DataFrame | None = None) -> DataFrame:
    """Hits of queries (q_id, query) by whole words and prefixes."""
    return _assigned(index, queries, prefix_matches, params, allow)


def fuzzy(index: TextIndex, queries: DataFrame, params: Params = Params(), allow: DataFrame | None = None) -> DataFrame:
    """Hits by words within edit distance."""
    return _assigned(index, queries, fuzzy_matches, params, allow)


def parse_clauses(query: str) -> list[tuple[int, list[str]]]:
    """Clauses of a query as sign (1 required, 0 optional, -1 excluded) and words, of which a phrase has several: a, +a, -a, "a b", +"a b", -"a b"."""
    out = []
    for sign, quoted, phrase, word in re.findall(r'([+-]?)(?:("([^"]*)")|(\S+))', query):
        found = re.findall("[a-z0-9]+", (phrase if quoted else word).lower())
        if found:
            value = {"+": 1, "-": -1}.get(sign, 0)
            out += [(value, found)] if quoted else [(value, [w]) for w in found]
    return out


def _clauses(query: str) -> Column:
    def parse(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: [{"sign": s, "words": w} for s, w in parse_clauses(q or "")])

    parse.__annotations__ = {"queries": pd.Series, "return": pd.Series}
    return F.pandas_udf(parse, "array<struct<sign:int,words:array<string>>>")(query)


def full_text(index: TextIndex, queries: DataFrame, params: Params = Params(), allow: DataFrame | None = None) -> DataFrame:
    """Hits by BM25 over fields; build the index with plain_tokens.

    A clause is a word or a phrase; its matches in a field are counted once, scored by the summed weights of its words, and a field is a hit if it has
    all required clauses, no excluded one, and one that isn't excluded. Postings are read for the words of the queries only; where the index is
    made as it is read, texts are cut into words once, and what concerns the queries is stored.
    """
    clauses = queries.select("q_id", F.posexplode(_clauses("query")).alias("cl", "c")).select("q_id", "cl", "c.sign", "c.words").distinct()
    # Words said twice count once.
    clauses = clauses.groupBy("q_id", "sign", "words").agg(F.min("cl").alias("cl"))
    asked = clauses.select("q_id", "cl", "sign", F.size("words").alias("size"), F.posexplode("words").alias("k", "word"))
    words = [r.word for r in asked.select("word").distinct().limit(PUSHED_WORDS + 1).collect()]
    if not words:
        return queries.sparkSession.createDataFrame([], "q_id long, id long, field_idx int, score double, rank int")
    post = index.postings if index.words is None else index.words
    if len(words) <= PUSHED_WORDS:
        of_queries = F.col("word").isin(words)
    else:
        post = post.join(_small(asked.select("word").distinct().withColumn("_asked", F.lit(True))), "word", "left")
        of_queries = F.col("_asked").isNotNull()
    if index.words is not None:
        # The first word of each field is kept for the fields' number and length.
        post = materialise(post.where(of_queries | (F.col("pos") == 0)).withColumn("_asked", of_queries))
        if index.docs is None:
            index.docs, index.mean = TextIndex(post, post, 0, 0).lengths()
        of_queries = F.col("_asked")
    post = post.where(of_queries).drop("_asked")
    docs, mean = index.lengths()
    once = post.where("occurrence = 0") if index.words is None else post.select("word", "id", "field_idx").distinct()
    df = once.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "word").groupBy("q_id", "cl").agg(F.sum(idf).alias("weight"))
    hits = allowed(post, allow).join(_small(asked), "word")
    where = ["q_id", "cl", "sign", "id", "field_idx", "length"]
    single = hits.where("size = 1").groupBy(*where).agg(F.count("*").alias("tf"))
    if not asked.where("size > 1").isEmpty():
        runs = hits.where("size > 1").groupBy(*where, "size", (F.col("pos") - F.col("k")).alias("at")).agg(F.count("*").alias("met")).where("met = size")
        single = single.unionByName(runs.groupBy(*where).agg(F.count("*").alias("tf")))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    part = single.join(_small(weights), ["q_id", "cl"])
    of = part.groupBy("q_id", "id", "field_idx").agg(F.sum(F.when(F.col("sign") >= 0, F.col("weight") * gain)).alias("score"), F.count(F.when(F.col("sign") == 1, 1)).alias("have"), F.min("sign").alias("least"))
    needed = clauses.groupBy("q_id").agg(F.count(F.when(F.col("sign") == 1, 1)).alias("needed"))
    scored = of.join(_small(needed), "q_id").where("have = needed and least >= 0").select("q_id", "id", "field_idx", "score")
    if not params.exact:
        scored = cut(scored, budget(params, index.max_fields, index.avg_fields))
    return finish(scored, params)
