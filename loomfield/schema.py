"""Data model: items with ordered, typed, tagged fields; and the rules they must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

FIELD = "struct<type:string,value:string,data:binary,tags:array<string>>"
RAW_ITEM = "identifier string, fields array<struct<type:string,value:string,tags:array<string>>>"
ITEM = f"id long, identifier string, fields array<{FIELD}>"
HIT = "q_id long, id long, field_idx int, score double, rank int"
TYPES = ("text", "image", "image-inline")
MOST = 65_535


class DataError(ValueError):
    """Input that breaks a rule of the data model."""


def item_fields(fields: Column, default_type: str = "text") -> Column:
    """Fields as read, with defaults filled in; inline images get their decoded bytes."""
    return F.transform(
        F.coalesce(fields, F.array().cast("array<struct<type:string,value:string,tags:array<string>>>")),
        lambda f: F.struct(
            F.coalesce(f["type"], F.lit(default_type)).alias("type"),
            f["value"].alias("value"),
            F.when(f["type"] == "image-inline", F.unbase64(f["value"])).alias("data"),
            F.coalesce(f["tags"], F.array().cast("array<string>")).alias("tags"),
        ),
    )


def number(df: DataFrame, *order: str, into: str = "id") -> DataFrame:
    """df with dense numbers from 0 in the given order, without a window over the whole table: parts of a range sort, offset by the sizes of those before.

    The sorted parts are written to the shared folder once, so that a row's part, its place there and the parts' sizes come from the same sort, whatever
    a plan that is run again would sample. Among rows that tie in `order`, those of least hash come first: many ties lie in several parts.
    """
    hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    placed = df.withColumn("_tie", F.xxhash64(*hashed) if hashed else F.lit(0))
    placed = placed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    # Within a part the second number counts rows in the order in which they come.
    placed = placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = materialise(placed)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def problems(items: DataFrame) -> DataFrame:
    """identifier and problem, for each rule that an item breaks."""
    bad_type = F.exists("fields", lambda f: ~f["type"].isin(*TYPES))
    rules = [
        (F.col("identifier").isNull(), "missing identifier"),
        (F.octet_length("identifier") > MOST, "identifier too long"),
        (F.size("fields") > MOST, "too many fields"),
        (bad_type, "unknown field type"),
        (F.exists("fields", lambda f: f["value"].isNull()), "field without value"),
    ]
    broken = items.select("identifier", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])).alias("p")).select("identifier", F.explode("p").alias("problem"))
    twice = items.groupBy("identifier").count().where("count > 1").select("identifier", F.lit("duplicate identifier").alias("problem"))
    return broken.unionByName(twice)


def check(items: DataFrame) -> DataFrame:
    """items, if they keep all rules."""
    first = problems(items).orderBy("problem", "identifier").limit(1).collect()
    if first:
        raise DataError(f"{first[0].problem}: {(first[0].identifier or '')[:80]}")
    return items


def require_text(items: DataFrame) -> DataFrame:
    """items, failing when read if a field isn't text (text indices take nothing else)."""
    ok = F.forall("fields", lambda f: f["type"] == "text")
    return items.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("only text fields can be indexed: "), "identifier")).cast("boolean")))
