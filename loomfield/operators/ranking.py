"""The end that all searches share: candidates, one hit for each item, order, limit, names."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores that agree to so many decimals are equal in an order: how a sum is split up must not decide which of two hits is first. FINE: in a cut of candidates that are scored anew.
DIGITS, FINE = 9, 12


@dataclass(frozen=True)
class Params:
    """k hits at most, of at least min_score. Not exact: only about k * (fields of an item on average) candidates are looked at. rerank: how many times more candidates are scored anew."""

    k: int = 10
    min_score: float | None = None
    exact: bool = False
    rerank: float | None = None

    @staticmethod
    def of(raw: dict) -> Params:
        """From names and values as a request has them; numbers and truth values may be strings."""
        get = lambda n: raw.get(n, raw.get(n.replace("_", "-")))
        flag = get("exact")
        k, low, more = get("k"), get("min_score"), get("rerank")
        if isinstance(flag, str):
            if flag.lower() not in ("true", "false"):
                raise ValueError("exact must be true or false")
            flag = flag.lower() == "true"
        return Params(10 if k is None else int(k), None if low is None else float(low), bool(flag), None if more is None else float(more))


def budget(params: Params, max_fields: int, avg_fields: float) -> int:
    """Candidates (fields) that are kept for each query."""
    k = math.ceil(params.k * params.rerank) if params.rerank else params.k
    return k * max(1, max_fields) if params.exact else math.ceil(k * max(avg_fields, 1e-9))


def allowed(df: DataFrame, allow: DataFrame | None) -> DataFrame:
    """df of the items in `allow` (a column id), if given. Before any ranking."""
    return df if allow is None else df.join(allow.select("id").distinct(), "id", "left_semi")


def level(score: Column | np.ndarray, digits: int = DIGITS) -> Column | np.ndarray:
    """What scores are ordered by."""
    return (np if isinstance(score, np.ndarray) else F).rint(score * 10.0**digits)


def cut(scored: DataFrame, most: int, digits: int = DIGITS) -> DataFrame:
    """The best `most` fields of each query."""
    by = Window.partitionBy("q_id").orderBy(level(F.col("score"), digits).desc(), "id", F.desc("field_idx"))
    return scored.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def best_fields(scored: DataFrame) -> DataFrame:
    """The best field of each item for each query, the first on ties."""
    best = scored.groupBy("q_id", "id").agg(F.max(F.struct("score", (-F.col("field_idx")).alias("neg"))).alias("b"))
    return best.select("q_id", "id", (-F.col("b.neg")).alias("field_idx"), F.col("b.score").alias("score"))


def finish(scored: DataFrame, params: Params, check_min: bool = True) -> DataFrame:
    """Hits: the best field of each item (the first on ties), the k best items of each query."""
    if check_min and params.min_score is not None:
        scored = scored.where(F.col("score") >= params.min_score)
    return top(best_fields(scored), params.k)


def top(best: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("q_id").orderBy(level(F.col("score")).desc(), "id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def merge_neighbors(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several vectors of one query item as one list: the best score of each item."""
    return top(hits.groupBy("q_id", "id").agg(F.max_by("field_idx", F.struct("score", (-F.col("field_idx")))).alias("field_idx"), F.max("score").alias("score")), k)


def enrich(hits: DataFrame, items: DataFrame) -> DataFrame:
    """Hits with the identifier and the matched field's text, joined after the limit."""
    named = items.select("id", "identifier", "fields")
    return hits.join(named, "id").withColumn("field", F.try_element_at("fields", F.col("field_idx") + 1)["value"]).drop("fields")


def flat_rank(hits: DataFrame) -> DataFrame:
    """Hits with a running rank over the queries in order of q_id, from the hits of each query, not from a window over all."""
    sizes = hits.groupBy("q_id").agg(F.max("rank").alias("n"))
    before = sizes.select("q_id", (F.sum("n").over(Window.orderBy("q_id")) - F.col("n")).alias("before"))
    return hits.join(before, "q_id").withColumn("rank", (F.col("rank") + F.col("before")).cast("int")).drop("before")
