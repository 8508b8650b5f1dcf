"""Lookups and figures over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(items: DataFrame) -> DataFrame:
    """One row for each field: id, identifier, field_idx, type, value, tags. (id, field_idx) is the order of fields."""
    return items.select("id", "identifier", F.posexplode("fields").alias("field_idx", "f")).select("id", "identifier", "field_idx", "f.type", "f.value", "f.tags")


def by_identifier(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """id of each identifier of `wanted` that is there."""
    return items.select("id", "identifier").join(wanted.select("identifier").distinct(), "identifier")


def by_id(items: DataFrame, wanted: DataFrame) -> DataFrame:
    return items.join(wanted.select("id").distinct(), "id", "left_semi")


def value_at(n: int | Column) -> Column:
    """Value of field n of an item, counted from 0; null if there is none."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n >= 0, F.try_element_at("fields", (n + 1).cast("int"))["value"])


def main_field() -> Column:
    """The first field tagged `main`, or null."""
    return F.try_element_at(F.filter("fields", lambda f: F.array_contains(f["tags"], "main")), F.lit(1))


def has_type(f: Column, kind: str) -> Column:
    return f["type"] == kind


def has_tag(f: Column, tag: str) -> Column:
    return F.array_contains(f["tags"], tag)


def stats(items: DataFrame) -> DataFrame:
    """items, total_fields, max_fields, avg_fields."""
    n = F.size("fields")
    out = items.agg(F.count("*").alias("items"), F.coalesce(F.sum(n), F.lit(0)).alias("total_fields"), F.coalesce(F.max(n), F.lit(0)).alias("max_fields"))
    return out.withColumn("avg_fields", F.col("total_fields") / F.greatest(F.col("items"), F.lit(1)))


def values(items: DataFrame) -> DataFrame:
    """identifier and the values of all its fields."""
    return items.select("identifier", F.transform("fields", lambda f: f["value"]).alias("values"))


def save(items: DataFrame, path: str, force: bool = False) -> bool:
    """Write items as Parquet, unless they are there; whether they were written."""
    try:
        items.write.mode("overwrite" if force else "errorifexists").parquet(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            return False
        raise
    return True
