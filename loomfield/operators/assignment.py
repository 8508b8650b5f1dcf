"""Score of a field for the words of a query: the best one-to-one assignment of the two."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most words of a query for the assignment over subsets inside the JVM, 2^n steps for a row; beyond, an augmenting path method in Python.
SUBSETS = 8
UNKNOWN, EXTRA = 0.5, 0.25


def subsets(rows: Column, n: Column) -> Column:
    """Greatest weight of an assignment of rows, arrays of (kwi, w), to n words."""
    start = F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), n).cast("int") - 1), lambda _: F.lit(0.0))

    def with_row(acc: Column, row: Column) -> Column:
        def better(v: Column, m: Column) -> Column:
            bit = lambda c: F.pow(F.lit(2), c["kwi"]).cast("int")
            usable = F.filter(row, lambda c: m.bitwiseAND(bit(c)) > 0)
            return F.greatest(v, F.coalesce(F.array_max(F.transform(usable, lambda c: F.element_at(acc, m - bit(c) + 1) + c["w"])), F.lit(0.0)))

        return F.transform(acc, better)

    return F.aggregate(rows, start, with_row, lambda acc: F.element_at(acc, -1))


def matching(rows: list[list[tuple[int, float]]], n: int) -> float:
    """The same by successive best augmenting paths; for any n."""
    match: list[int | None] = [None] * n
    weight = [dict(r) for r in rows]
    used: set[int] = set()
    total = 0.0
    while True:
        # Longest path from a free row to a free word: Bellman-Ford over the residual graph.
        gain = [float("-inf")] * n
        came: list[tuple[int, int | None]] = [(-1, None)] * n
        for i, w in enumerate(weight):
            if i not in used:
                for j, v in w.items():
                    if v > gain[j]:
                        gain[j], came[j] = v, (i, None)
        for _ in range(n):
            moved = False
            for j in range(n):
                i = match[j]
                if i is None or gain[j] == float("-inf"):
                    continue
                for k, v in weight[i].items():
                    g = gain[j] - weight[i][j] + v
                    if k != j and g > gain[k] + 1e-12:
                        gain[k], came[k], moved = g, (i, j), True
            if not moved:
                break
        free = [j for j in range(n) if match[j] is None and gain[j] > 1e-12]
        if not free:
            return total
        j = max(free, key=lambda x: gain[x])
        total += gain[j]
        while True:
            i, before = came[j]
            match[j] = i
            if before is None:
                used.add(i)
                break
            j = before


@F.pandas_udf(T.DoubleType())
def _matching(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for rows, n in parts:
        yield pd.Series([matching([[(c["kwi"], float(c["w"])) for c in r] for r in json.loads(x)], int(k)) for x, k in zip(rows, n, strict=True)], dtype=float)


def field_scores(found: DataFrame, most_words: int) -> DataFrame:
    """q_id, id, field_idx, score of rows (q_id, n, id, field_idx, length, word, occurrence, kwi, w).

    Partitioned once by query and field, for all three groupings. Rows alike in weights count at most n times
    in the assignment, so long fields stay short; M counts them all.
    """
    key = ["q_id", "id", "field_idx"]
    placed = found.repartition(*key)
    rows = placed.groupBy(*key, "word", "occurrence").agg(F.first("n").alias("n"), F.first("length").alias("length"), F.sort_array(F.collect_list(F.struct("kwi", "w"))).alias("row"))
    alike = rows.groupBy(*key, "row").agg(F.first("n").alias("n"), F.first("length").alias("length"), F.count("*").alias("c"))
    each = alike.groupBy(*key).agg(F.first("n").alias("n"), F.first("length").alias("length"), F.sum("c").alias("m"), F.flatten(F.collect_list(F.array_repeat("row", F.least("c", F.col("n")).cast("int")))).alias("rows"))
    weight = subsets(F.col("rows"), F.col("n"))
    if most_words > SUBSETS:
        each = each.withColumn("a", F.when(F.col("n") <= SUBSETS, F.lit(None).cast("double")).otherwise(_matching(F.to_json("rows"), "n")))
        weight = F.coalesce("a", F.when(F.col("n") <= SUBSETS, weight))
    both = F.least(F.col("n").cast("long"), F.col("m"))
    unknown = F.greatest(F.lit(0), F.col("n") - both)
    extra = F.greatest(F.lit(0), F.col("length") - both - unknown)
    return each.select(*key, (weight - UNKNOWN * unknown - EXTRA * extra).alias("score"))
