"""Tables of keys as prefix tries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_matches(keys: DataFrame, inputs: DataFrame) -> DataFrame:
    """input, key, value, length for each key that the input begins with: an equi-join on the input's prefixes."""
    starts = inputs.select("input", F.explode(F.transform(F.sequence(F.lit(0), F.length("input")), lambda n: F.substring("input", F.lit(1), n))).alias("key"))
    return starts.join(keys, "key").select("input", "key", "value", F.length("key").alias("length"))


def continuations(keys: DataFrame, prefix: str) -> DataFrame:
    """Keys that begin with a prefix; the filter reaches the scan."""
    return keys.where(F.col("key").startswith(prefix))


def contains(keys: DataFrame, inputs: DataFrame) -> DataFrame:
    return inputs.join(keys.select(F.col("key").alias("input")).distinct(), "input", "left_semi")


def contains_prefix(keys: DataFrame, inputs: DataFrame) -> DataFrame:
    """The inputs that some key begins with: an equi-join on the keys' prefixes of the lengths that inputs have."""
    lengths = sorted(r.n for r in inputs.where("input is not null").select(F.length("input").alias("n")).distinct().collect())
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("key"))
    starts = keys.select(F.explode(F.transform(sizes, lambda n: F.substring("key", F.lit(1), n))).alias("input")).distinct()
    return inputs.join(starts, "input", "left_semi")


def size(keys: DataFrame) -> DataFrame:
    """One row: how many keys there are, and whether there are none."""
    return keys.agg(F.count("key").alias("len")).withColumn("is_empty", F.col("len") == 0)


def upsert(keys: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys with `new` put in, and the values that were replaced."""
    return keys.join(new, "key", "left_anti").unionByName(new), keys.join(new.select("key"), "key", "left_semi")


def delete(keys: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys without `gone`, and the values that went."""
    return keys.join(gone.select("key"), "key", "left_anti"), keys.join(gone.select("key"), "key", "left_semi")
