"""Operator 5: weighted rendezvous hashing of stable record keys over shards.

Each (key, shard) pair has a uniform number u from its MD5; the shard with the largest
-weight / ln(u) takes the record. A new shard only takes records, in proportion to its weight, and
a removed one only gives its own away. One narrow projection: no shuffle and no state.

Null keys become the key of an empty string prefixed by 'null'; equal keys always share a shard.
Shards with weight 0 or less get nothing. Ties go to the lower shard number. An empty table gives an
empty one. A column of the input that has the name of the shard column is kept as NAME_given; `reshard` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Production layout: 16 shards, of which every fourth has a double weight.
WEIGHTS = {i: 2.0 if i % 4 == 0 else 1.0 for i in range(16)}


def key_of(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("key:"), column.cast("string")), F.lit("null:"))


def shard(key: Column, weights: Mapping[int, float]) -> Column:
    """Number of the shard that takes the key (a string column)."""
    live = {int(k): float(w) for k, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no shard has a positive weight")
    scores = []
    for number, weight in sorted(live.items()):
        digits = F.substring(F.md5(F.concat(key, F.lit(f"|{number}"))), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 1.0) / F.lit(float(2**52 + 2))
        scores.append(F.struct((F.lit(-weight) / F.log(u)).alias("score"), F.lit(-number).alias("place")))
    return -(F.greatest(*scores)["place"] if len(scores) > 1 else scores[0]["place"])


def assign(df: DataFrame, key: str, weights: Mapping[int, float] | None = None, into: str = "shard") -> DataFrame:
    """df with the column `into`; one of that name in df becomes `into`_given."""
    name = f"{into}_given"
    while into in df.columns and name in df.columns:
        name += "_"
    df = df.withColumnRenamed(into, name)
    key = name if key == into else key
    return df.withColumn(into, shard(key_of(F.col(key)), weights or WEIGHTS))


def reshard(docs: DataFrame, before: Mapping[int, float], after: Mapping[int, float]) -> DataFrame:
    """doc_id, its shard under either layout, and whether it moves."""
    key = key_of(F.col("doc_id"))
    out = docs.select("doc_id", shard(key, before).alias("shard"), shard(key, after).alias("new_shard"))
    return out.withColumn("moved", F.col("shard") != F.col("new_shard"))


def write_shards(docs: DataFrame, path: str, weights: Mapping[int, float] | None = None) -> None:
    """Write docs with one folder for each shard. Rows are spread by shard and a salt, so that a heavy shard is written by several tasks."""
    placed = assign(docs, "doc_id", weights)
    placed.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("shard").parquet(path)


def grown() -> dict[int, float]:
    return WEIGHTS | {16: 1.0}


def oracle() -> str:
    def pick(weights: Mapping[int, float]) -> str:
        rows = ", ".join(f"({n}, {w!r}::DOUBLE)" for n, w in weights.items())
        return f"""SELECT doc_id, arg_max(n, (score, -n)) AS shard FROM (
            SELECT doc_id, n, -w / ln((('0x' || substr(md5(k || '|' || n), 1, 13))::BIGINT::DOUBLE + 1.0) / {float(2**52 + 2)!r}::DOUBLE) AS score
            FROM (SELECT DISTINCT doc_id, coalesce('key:' || doc_id::VARCHAR, 'null:') AS k FROM documents), (VALUES {rows}) s(n, w)) GROUP BY doc_id"""

    return f"""WITH a AS ({pick(WEIGHTS)}), b AS ({pick(grown())})
        SELECT d.doc_id, a.shard::INTEGER AS shard, b.shard::INTEGER AS new_shard, a.shard <> b.shard AS moved
        FROM documents d JOIN a ON d.doc_id IS NOT DISTINCT FROM a.doc_id JOIN b ON d.doc_id IS NOT DISTINCT FROM b.doc_id"""
