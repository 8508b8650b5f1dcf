"""Readers of items: JSON lines, tables, rows in memory, and query results as JSON, XML or TSV."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import RAW_ITEM, DataError, check, item_fields, number

XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
_TERM = "struct<type:string,value:string,datatype:string,`xml:lang`:string>"


def build(raw: DataFrame, order: str = "ordinal", default_type: str = "text") -> DataFrame:
    """Checked items with dense ids in the order of a column of raw (identifier, fields)."""
    return check(number(raw, order).select("id", "identifier", item_fields(F.col("fields"), default_type).alias("fields")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON lines in the order of the file; a bad line is an error."""
    raw = spark.read.schema(RAW_ITEM).option("mode", "FAILFAST").json(path)
    return build(raw.withColumn("ordinal", F.monotonically_increasing_id()))


def from_rows(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """Items of dicts with identifier and fields; a field is a dict, or a string for plain text."""
    out = []
    for k, row in enumerate(rows):
        if "identifier" not in row or "fields" not in row:
            raise DataError("an item needs identifier and fields")
        fields = [{"value": f} if isinstance(f, str) else f for f in row["fields"]]
        out.append((k, row["identifier"], [(f.get("type", "text"), f["value"], list(f.get("tags", []))) for f in fields]))
    return build(spark.createDataFrame(out, f"ordinal long, {RAW_ITEM}"))


def from_columns(df: DataFrame, identifier: str, *columns: str, order: str | None = None) -> DataFrame:
    """Items of a table, one text field for each column; null columns are left out."""
    fields = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit("text").alias("type"), F.col(c).cast("string").alias("value"), F.array().cast("array<string>").alias("tags"))) for c in columns]))
    return build(df.select(F.col(order or identifier).alias("ordinal"), F.col(identifier).cast("string").alias("identifier"), fields.alias("fields")))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Items of tab-separated lines: identifier, then text fields."""
    parts = spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.split("value", "\t").alias("p"))
    fields = F.transform(F.slice("p", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))), lambda v: F.struct(F.lit("text").alias("type"), v.alias("value"), F.array().cast("array<string>").alias("tags")))
    return build(parts.select("ordinal", F.col("p")[0].alias("identifier"), fields.alias("fields")))


def guess_format(path: str) -> str:
    kind = os.path.splitext(path)[1].lower().lstrip(".")
    if kind not in ("json", "xml", "tsv"):
        raise DataError(f"no format is known for '.{kind}'")
    return kind


def check_header(names: list[str]) -> dict[str, int]:
    """Places of id, value, type and tags; the first two are named so and stand first, the others may follow."""
    if not 2 <= len(names) <= 4:
        raise DataError(f"Expected 2 to 4 variables, got {len(names)}")
    if names[0] != "id" or names[1] != "value":
        raise DataError("the first two variables must be id and value")
    out = {"id": 0, "value": 1}
    for k, name in enumerate(names[2:], 2):
        if name not in ("type", "tags", "tag"):
            raise DataError(f"unexpected variable {name}")
        out["type" if name == "type" else "tags"] = k
    return out


def _terms_json(spark: SparkSession, path: str, rename: dict[str, str]) -> tuple[DataFrame, list[str]]:
    head = spark.read.option("multiLine", True).schema("head struct<vars:array<string>>").json(path).first()
    names = list(head.head.vars) if head and head.head and head.head.vars else []
    shown = [rename.get(n, n) for n in names]
    body = ",".join(f"`{n}`:{_TERM}" for n in names)
    rows = spark.read.option("multiLine", True).schema(f"results struct<bindings:array<struct<{body}>>>").json(path).select(F.posexplode("results.bindings").alias("ordinal", "b"))
    term = lambda c: F.when(c.isNotNull(), F.struct(F.when(c["type"] == "uri", "iri").when(c["type"] == "bnode", "bnode").otherwise("literal").alias("kind"), c["value"].alias("value"), c["datatype"].alias("datatype")))
    return rows.select("ordinal", *[term(F.col("b")[n]).alias(s) for n, s in zip(names, shown, strict=True)]), shown


def _terms_xml(spark: SparkSession, path: str, rename: dict[str, str]) -> tuple[DataFrame, list[str]]:
    head = spark.read.format("xml").option("rowTag", "head").schema("variable array<struct<_name:string>>").load(path).first()
    names = [v["_name"] for v in (head.variable if head and head.variable else [])]
    shown = [rename.get(n, n) for n in names]
    schema = "binding array<struct<_name:string,uri:string,bnode:string,literal:struct<_VALUE:string,_datatype:string>>>"
    rows = spark.read.format("xml").option("rowTag", "result").schema(schema).load(path).withColumn("ordinal", F.monotonically_increasing_id())

    def term(name: str):
        b = F.filter("binding", lambda x: x["_name"] == name)
        b = F.try_element_at(b, F.lit(1))
        kind = F.when(b["uri"].isNotNull(), "iri").when(b["bnode"].isNotNull(), "bnode").otherwise("literal")
        return F.when(b.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(b["uri"], b["bnode"], b["literal"]["_VALUE"]).alias("value"), b["literal"]["_datatype"].alias("datatype")))

    return rows.select("ordinal", *[term(n).alias(s) for n, s in zip(names, shown, strict=True)]), shown


def _terms_tsv(spark: SparkSession, path: str, rename: dict[str, str]) -> tuple[DataFrame, list[str]]:
    lines = spark.read.text(path).withColumn("ordinal", F.monotonically_increasing_id())
    head = lines.orderBy("ordinal").first()
    if head is None:
        raise DataError("Expected 2 to 4 variables, got 0")
    names = [rename.get(n.lstrip("?"), n.lstrip("?")) for n in head.value.split("\t")]
    cells = F.split("value", "\t")

    def term(k: int):
        c = F.try_element_at(cells, F.lit(k + 1))
        text = F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)
        # In one pass: pieces between escaped backslashes hold the other escapes only.
        pieces = F.split(text, r"\\\\")

        def plain(x: Column) -> Column:
            for code, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ('"', '"')):
                x = F.replace(x, F.lit("\\" + code), F.lit(char))
            return x

        text = F.array_join(F.transform(pieces, plain), "\\")
        kind = F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "bnode").otherwise("literal")
        value = F.when(c.startswith("<"), F.regexp_extract(c, "^<(.*)>$", 1)).when(c.startswith('"'), text).otherwise(c)
        datatype = F.nullif(F.regexp_extract(c, r'"\^\^<([^>]*)>$', 1), F.lit(""))
        return F.when(c.isNotNull() & (c != ""), F.struct(kind.alias("kind"), value.alias("value"), datatype.alias("datatype")))

    body = lines.where((F.col("ordinal") > head.ordinal) & (F.col("value") != ""))
    return body.select("ordinal", *[term(k).alias(n) for k, n in enumerate(names)]), names


def solutions(spark: SparkSession, path: str, fmt: str | None = None, rename: dict[str, str] | None = None) -> tuple[DataFrame, list[str]]:
    """ordinal and one term (kind, value, datatype) for each variable; and the variables."""
    read = {"json": _terms_json, "xml": _terms_xml, "tsv": _terms_tsv}[fmt or guess_format(path)]
    return read(spark, path, rename or {})


def field_rows(terms: DataFrame, names: list[str], default_type: str = "text") -> DataFrame:
    """ordinal, identifier, field of each solution; wrong kinds of terms are an error."""
    check_header(names)
    tags = next((n for n in names if n in ("tags", "tag")), None)
    fail = lambda text: F.raise_error(F.lit(text))
    literal = F.col("value.kind") == "literal"
    plain = F.col("value.datatype").isNull() | F.col("value.datatype").isin(XSD_STRING, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")
    identifier = F.when(F.col("id.kind") == "iri", F.col("id.value")).otherwise(fail("Expected first variable to be an IRI").cast("string"))
    value = F.when(F.col("value.kind") == "iri", F.col("value.value")).when(literal & plain, F.col("value.value")).otherwise(fail("Expected second variable to be a string or an IRI").cast("string"))
    kind = F.coalesce(F.col("type.value"), F.lit(default_type)) if "type" in names else F.lit(default_type)
    marks = F.filter(F.transform(F.split(F.coalesce(F.col(f"{tags}.value"), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "") if tags else F.array().cast("array<string>")
    return terms.select("ordinal", identifier.alias("identifier"), F.struct(kind.alias("type"), value.alias("value"), marks.alias("tags")).alias("field"))


def group_runs(rows: DataFrame, key: str = "identifier", order: str = "ordinal", mode: str = "run") -> DataFrame:
    """rows (key, order, field) as items. Mode `run`: rows one after another with the same key are one item; `group`: all rows with the same key."""
    if mode == "group":
        grouped = rows.groupBy(key).agg(F.min(order).alias("ordinal"), F.sort_array(F.collect_list(F.struct(order, "field"))).alias("f"))
        return grouped.select("ordinal", key, F.transform("f", lambda x: x["field"]).alias("fields"))
    dense = number(rows, order, into="_n")
    # A run is told by the difference of two dense orders only within a key; a neighbour of the same key has the number before.
    by = Window.partitionBy(key).orderBy("_n")
    runs = dense.withColumn("_new", F.coalesce((F.col("_n") - F.lag("_n").over(by) > 1).cast("int"), F.lit(0))).withColumn("_run", F.sum("_new").over(by))
    grouped = runs.groupBy(key, "_run").agg(F.min(order).alias("ordinal"), F.sort_array(F.collect_list(F.struct(F.col("_n"), "field"))).alias("f"))
    return grouped.select("ordinal", key, F.transform("f", lambda x: x["field"]).alias("fields"))


def read_results(spark: SparkSession, path: str, fmt: str | None = None, default_type: str = "text", mode: str = "run", rename: dict[str, str] | None = None) -> DataFrame:
    """Items of query results; a solution without identifier or value is skipped, as one that can't be parsed."""
    terms, names = solutions(spark, path, fmt, rename)
    check_header(names)
    return build(group_runs(field_rows(terms.where("id is not null and value is not null"), names, default_type), mode=mode), default_type=default_type)
