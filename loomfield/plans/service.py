"""Requests as tables: batched search by value, identifier or vector; the graph-query service; and search joined to a table of bindings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import text_search, vector_search
from ..operators.ranking import Params, enrich, flat_rank

OUTPUTS = ("rank", "id", "score", "identifier", "field")
KINDS = {"keyword": ["value"], "fuzzy": ["value"], "full-text": ["value"], "embedding": ["embedding", "identifier"], "embedding-with-data": ["value", "embedding", "identifier"]}
MODALITIES = ("text", "image", "image-base64", "iri")


class BadRequest(ValueError):
    """A request that can't be answered; as status 400."""


@dataclass
class Engine:
    """An index with its items, by a name. embed: texts to vectors, for vector indices."""

    name: str
    kind: str
    index: text_search.TextIndex | vector_search.VectorIndex
    items: DataFrame | None = None
    embed: Callable[[list[str]], list] | None = None
    description: str = ""
    options: dict = field(default_factory=dict)

    def takes(self, what: str) -> None:
        """An error if queries of this modality can't be embedded by the index's model, or searched for by its words."""
        has = "text" if self.kind in ("keyword", "fuzzy", "full-text") else getattr(self.embed, "modality", "text")
        if has not in (what, "multimodal"):
            raise BadRequest(f"index {self.name} takes {has}, no {what}")

    def by_text(self, queries: DataFrame, params: Params, allow: DataFrame | None = None) -> DataFrame:
        if self.kind in ("keyword", "fuzzy", "full-text"):
            f = {"keyword": text_search.keyword, "fuzzy": text_search.fuzzy, "full-text": text_search.full_text}[self.kind]
            return f(self.index, queries, params, allow)
        if self.embed is None:
            raise BadRequest(f"index {self.name} has no model")
        rows = queries.collect()
        vectors = [(r.q_id, [float(x) for x in v]) for r, v in zip(rows, self.embed([r.query for r in rows]), strict=True)]
        return self.by_vector(queries.sparkSession.createDataFrame(vectors, "q_id long, embedding array<float>"), params, allow)

    def by_vector(self, queries: DataFrame, params: Params, allow: DataFrame | None = None) -> DataFrame:
        if not isinstance(self.index, vector_search.VectorIndex):
            raise BadRequest(f"index {self.name} takes no vectors")
        return vector_search.search(self.index, queries, params, allow)

    def by_item(self, wanted: DataFrame, params: Params, allow: DataFrame | None = None) -> DataFrame:
        """wanted: q_id, id. Hits under q_id."""
        if not isinstance(self.index, vector_search.VectorIndex):
            raise BadRequest(f"index {self.name} finds no neighbours")
        found = vector_search.neighbors(self.index, wanted, params, allow)
        return wanted.select("q_id", F.col("id").alias("_of")).join(found.withColumnRenamed("q_id", "_of"), "_of").drop("_of")

    def named(self, hits: DataFrame) -> DataFrame:
        if self.items is None:
            return hits.withColumns({"identifier": F.lit(None).cast("string"), "field": F.lit(None).cast("string")})
        return enrich(hits, self.items)


def catalog(spark: SparkSession, engines: list[Engine]) -> DataFrame:
    rows = [(e.name, e.description, e.kind, KINDS[e.kind]) for e in engines]
    return spark.createDataFrame(rows, "name string, description string, type string, supported_query_types array<string>")


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok",)], "status string")


def ids_of(engine: Engine, wanted: DataFrame, by: str = "identifier") -> DataFrame:
    """wanted with id: of an identifier, with or without angle brackets, or a whole number as such."""
    bare = wanted.withColumn("_key", text.bare_iri(F.col(by)))
    numbers = bare.where(F.col("_key").rlike("^[0-9]+$")).withColumn("id", F.col("_key").cast("long"))
    rest = bare.where(~F.col("_key").rlike("^[0-9]+$"))
    if engine.items is None:
        return numbers.drop("_key")
    named = rest.join(engine.items.select("id", F.col("identifier").alias("_key")), "_key")
    return numbers.unionByName(named).drop("_key")


def request(spark: SparkSession, engine: Engine, body: str | dict, allow: DataFrame | None = None) -> DataFrame:
    """Hits of a JSON request with `queries` and parameters; q_id is a query's place."""
    raw = json.loads(body) if isinstance(body, str) else body
    queries = raw.get("queries")
    if not isinstance(queries, list):
        raise BadRequest("queries must be a list")
    try:
        params = Params.of(raw)
    except (TypeError, ValueError) as e:
        raise BadRequest(str(e)) from e
    values, names, vectors = [], [], []
    for k, q in enumerate(queries):
        kind, value = q.get("type"), q.get("value")
        mode = q.get("modality")
        if mode is not None and mode not in MODALITIES:
            raise BadRequest(f"unknown modality {mode}")
        if kind == "value" and mode in ("text", "image", "image-base64"):
            engine.takes("image" if mode.startswith("image") else "text")
        if kind == "identifier" or (kind == "value" and mode == "iri"):
            names.append((k, value))
        elif kind == "embedding":
            vectors.append((k, [float(x) for x in value]))
        elif kind == "value":
            values.append((k, value))
        else:
            raise BadRequest(f"unknown query type {kind}")
    parts = []
    if values:
        parts.append(engine.by_text(spark.createDataFrame(values, "q_id long, query string"), params, allow))
    if names:
        parts.append(engine.by_item(ids_of(engine, spark.createDataFrame(names, "q_id long, identifier string")).select("q_id", "id"), params, allow))
    if vectors:
        parts.append(engine.by_vector(spark.createDataFrame(vectors, "q_id long, embedding array<float>"), params, allow))
    if not parts:
        return spark.createDataFrame([], "q_id long, id long, field_idx int, score double, rank int, identifier string, field string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return engine.named(out)


def response(hits: DataFrame) -> DataFrame:
    """One row, the hits as JSON: matches of each query in order of q_id."""
    match = F.struct("rank", F.struct("id", "score", F.when(F.col("identifier").isNotNull(), F.struct("identifier", "field")).alias("info")).alias("m"))
    lists = hits.groupBy("q_id").agg(F.sort_array(F.collect_list(match)).alias("m"))
    return lists.select("q_id", F.to_json(F.transform("m", lambda x: x["m"])).alias("matches"))


def binding_rows(hits: DataFrame, outputs: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """Hits as one JSON binding each, in the form of query results."""
    kinds = {"rank": "integer", "id": "integer", "score": "float"}
    term = {}
    for name in outputs:
        value = F.col(name).cast("string")
        if name == "identifier":
            plain = F.struct(F.when(text.is_iri(value), "uri").otherwise("literal").alias("type"), value.alias("value"), F.lit(None).cast("string").alias("datatype"))
        else:
            datatype = f"http://www.w3.org/2001/XMLSchema#{kinds[name]}" if name in kinds else None
            plain = F.struct(F.lit("literal").alias("type"), value.alias("value"), F.lit(datatype).cast("string").alias("datatype"))
        term[name] = F.when(value.isNotNull(), plain).alias(name)
    return hits.select(*[c for c in ("row", "q_id", "rank") if c in hits.columns], F.to_json(F.struct(*term.values())).alias("binding"))


def results_json(hits: DataFrame, outputs: tuple[str, ...] = OUTPUTS) -> str:
    """A whole results document, of a limited list of hits."""
    rows = [json.loads(r.binding) for r in binding_rows(hits, outputs).orderBy(*[c for c in ("q_id", "rank") if c in hits.columns]).collect()]
    return json.dumps({"head": {"vars": list(outputs)}, "results": {"bindings": rows}})


@dataclass
class ServiceCall:
    query: str
    modality: str | None
    outputs: dict[str, str]
    params: Params


_TRIPLE = re.compile(r'(<[^>]*>|[\w-]*:[\w-]*)\s+(<[^>]*>|[\w-]*:[\w-]*)\s+(\?\w+|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^\S+)?|<[^>]*>|[+-]?[\d.]+(?:[eE][+-]?\d+)?|true|false)\s*[.;]?\s*')


def parse_service(sparql: str, prefix: str) -> ServiceCall:
    """A SELECT whose pattern says, of the subject PREFIXconfig, the query, output variables and parameters."""
    spaces = dict(re.findall(r"PREFIX\s+([\w-]*):\s*<([^>]*)>", sparql, re.I))
    m = re.search(r"SELECT\s+(.*?)(?:WHERE)?\s*\{(.*)\}\s*$", sparql, re.S | re.I)
    if not m:
        raise BadRequest("only SELECT queries with one basic pattern are answered")
    body, at = m.group(2).strip(), 0

    def full(term: str) -> str:
        if term.startswith("<"):
            return term[1:-1]
        p, _, name = term.partition(":")
        return spaces.get(p, p + ":") + name

    outputs: dict[str, str] = {}
    raw: dict[str, str] = {}
    while at < len(body):
        t = _TRIPLE.match(body, at)
        if not t:
            raise BadRequest(f"can't read the pattern at: {body[at : at + 40]}")
        at = t.end()
        s, p, o = t.groups()
        if full(s) != prefix + "config":
            raise BadRequest(f"the subject must be {prefix}config")
        if not full(p).startswith(prefix):
            raise BadRequest(f"unknown predicate {p}")
        name = full(p)[len(prefix) :]
        if name in OUTPUTS:
            if not o.startswith("?"):
                raise BadRequest(f"{name} must be a variable")
            outputs[name] = o[1:]
        elif o.startswith("?"):
            raise BadRequest(f"{name} must have a value")
        else:
            raw[name] = full(o) if o.startswith("<") else re.sub(r'^"((?:[^"\\]|\\.)*)".*$', r"\1", o).replace('\\"', '"')
    if "identifier" not in outputs:
        raise BadRequest("the identifier must be asked for")
    if "query" not in raw:
        raise BadRequest("Missing required 'query'")
    query, modality = raw.pop("query"), raw.pop("modality", None)
    try:
        return ServiceCall(query, modality, outputs, Params.of(raw))
    except (TypeError, ValueError) as e:
        raise BadRequest(str(e)) from e


def service(spark: SparkSession, engine: Engine, sparql: str, prefix: str) -> DataFrame:
    """Hits of a service call, under the variables' names, in order of rank, id, score, identifier, field."""
    call = parse_service(sparql, prefix)
    if call.modality == "iri" or (call.modality is None and re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$", call.query) and isinstance(engine.index, vector_search.VectorIndex)):
        wanted = ids_of(engine, spark.createDataFrame([(0, call.query)], "q_id long, identifier string")).select("q_id", "id")
        if wanted.isEmpty():
            raise BadRequest(f"unknown identifier {call.query}")
        hits = engine.by_item(wanted, call.params)
    else:
        hits = engine.by_text(spark.createDataFrame([(0, call.query)], "q_id long, query string"), call.params)
    return engine.named(hits).select(*[F.col(n).alias(call.outputs[n]) for n in OUTPUTS if n in call.outputs])


def federate(engine: Engine, bindings: DataFrame, params: Params = Params(), query: str | None = None) -> DataFrame:
    """row, rank, id, score, identifier, field of a table of bindings (row, and filter and query where there are such; ordinal for its order).

    With a column `query` of identifiers each row asks for the neighbours of its item, among the items of `filter` if that is there; the rank runs
    on over the rows. Else the text `query` is searched for among the items of `filter`, and a hit has the row that names it,
    the last one if several do; without a filter no row can be found, and there are no hits.
    """
    order = F.col("ordinal") if "ordinal" in bindings.columns else F.monotonically_increasing_id()
    rows = bindings.withColumn("_o", order)
    allow = ids_of(engine, rows.where("filter is not null"), "filter").select("id", "row", "_o") if "filter" in bindings.columns else None
    shape = ["row", "rank", "id", "score", "identifier", "field"]
    if "query" in bindings.columns:
        wanted = ids_of(engine, rows.where("query is not null"), "query").select(F.col("_o").alias("q_id"), "id", "row")
        hits = engine.by_item(wanted.select("q_id", "id"), params, allow)
        return engine.named(flat_rank(hits)).join(wanted.select("q_id", "row"), "q_id").select(*shape)
    if query is None:
        raise BadRequest("Missing required 'query'")
    spark = bindings.sparkSession
    if allow is None:
        return spark.createDataFrame([], "row string, rank int, id long, score double, identifier string, field string")
    hits = engine.by_text(spark.createDataFrame([(0, query)], "q_id long, query string"), params, allow)
    last = allow.groupBy("id").agg(F.max_by("row", "_o").alias("row"))
    return engine.named(hits).join(last, "id").select(*shape)
