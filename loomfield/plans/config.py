"""A pipeline as configured: data sets, models, embeddings, indices; each step a job with Parquet output."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import items as item_ops
from ..operators import text_search, vector_search
from ..schema import DataError
from ..sources import items as sources
from ..sources import tensors
from ..sources.remote import EndpointSource
from ..storage import exists, shared_dir
from .embedders import PROVIDERS, Clip, Hashing, Images, Sentences, Served
from .service import KINDS, Engine

DEFAULTS = {"metric": "cosine-normalized", "precision": "bfloat16", "connectivity": 16, "expansion_add": 128, "expansion_search": 64}
#: Vectors from which on an index has cells.
MANY = 10_000
SERVER = {"host": "127.0.0.1", "port": 8080, "cors": False, "max_input_size": "100MB"}


@dataclass
class Config:
    datasets: list[dict] = field(default_factory=list)
    models: list[dict] = field(default_factory=list)
    embeddings: list[dict] = field(default_factory=list)
    indices: list[dict] = field(default_factory=list)
    server: dict = field(default_factory=dict)

    @staticmethod
    def of(raw: dict) -> Config:
        unknown = set(raw) - {"datasets", "models", "embeddings", "indices", "server"}
        if unknown:
            raise DataError(f"unknown section {sorted(unknown)[0]}")
        c = Config(**{k: v or ([] if k != "server" else {}) for k, v in raw.items()})
        for part, needed in (("datasets", ("name", "output", "source")), ("models", ("name", "type")), ("embeddings", ("name", "output", "model", "data")), ("indices", ("name", "output", "type"))):
            for x in getattr(c, part):
                for n in needed:
                    if n not in x:
                        raise DataError(f"{part}: {n} is missing")
        for d in c.datasets:
            if d["source"].get("type") not in ("sparql-query", "sparql", "jsonl"):
                raise DataError(f"unknown source {d['source'].get('type')}")
            if d["source"]["type"] != "jsonl" and "default_field_type" not in d["source"]:
                raise DataError("default_field_type is missing")
        for m in c.models:
            if m["type"] not in (*PROVIDERS, "hashing"):
                raise DataError(f"unknown model {m['type']}")
        for i in c.indices:
            if i["type"] not in KINDS:
                raise DataError(f"unknown index {i['type']}")
        c.server = SERVER | c.server if c.server else {}
        return c

    @staticmethod
    def load(path: str) -> Config:
        try:
            import yaml
        except ImportError as e:
            raise DataError("reading a configuration needs yaml") from e
        with open(path) as f:
            return Config.of(yaml.safe_load(f) or {})


def model(spec: dict):
    dims = (spec.get("params") or {}).get("num_dimensions")
    if spec["type"] == "hashing":
        return Hashing(dims or 64)
    if spec["type"] == "vllm":
        return Served(spec["endpoint"], spec["model"], dims or spec.get("dims"), spec.get("max_input_len"), spec.get("batch_size", 16))
    kind = {"sentence-transformer": Sentences, "huggingface-image": Images, "open-clip": Clip}[spec["type"]]
    return kind(spec["model"], dims, spec.get("device", "cpu"), spec.get("batch_size", 16))


def guarded(fields: DataFrame, modality: str) -> DataFrame:
    """fields (with a type), failing when read if one is of a type that a model of this modality doesn't take."""
    takes = {"text": ["text"], "image": ["image", "image-inline"]}.get(modality, ["text", "image", "image-inline"])
    wrong = F.raise_error(F.concat(F.lit(f"a model for {modality} can't embed a field of type "), F.col("type"), F.lit(" of "), F.col("identifier"))).cast("boolean")
    return fields.where(F.when(F.col("type").isin(takes), F.lit(True)).otherwise(wrong))


@dataclass
class Pipeline:
    spark: SparkSession
    config: Config
    force: bool = False

    def _by(self, part: str, name: str) -> dict:
        return next(x for x in getattr(self.config, part) if x["name"] == name)

    def data(self) -> dict[str, bool]:
        return {d["name"]: item_ops.save(self._read(d["source"]), d["output"], self.force) for d in self.config.datasets}

    def _read(self, source: dict) -> DataFrame:
        if source["type"] == "jsonl":
            return sources.read_jsonl(self.spark, source["path"])
        if "path" in source and ("query" in source or "endpoint" in source):
            raise DataError("either a query or a path")
        if source["type"] == "sparql":
            return sources.read_results(self.spark, source["path"], source.get("format"), source["default_field_type"])
        # An executor asks the endpoint and writes its answer to the shared folder, from which all read.
        fmt = source.get("format", "json")
        self.spark.dataSource.register(EndpointSource)
        asked = self.spark.read.format(EndpointSource.name()).option("url", source["endpoint"]).option("query", source["query"]).option("format", fmt)
        for name, value in (source.get("headers") or {}).items():
            asked = asked.option(f"header.{name}", value)
        path = os.path.join(source.get("staging") or shared_dir(self.spark), f"answer-{uuid.uuid4().hex}.{fmt}")
        asked.load().select("body").write.text(path)
        return sources.read_results(self.spark, path, fmt, source["default_field_type"])

    def items(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._by("datasets", name)["output"])

    def embed(self) -> dict[str, int]:
        out = {}
        for e in self.config.embeddings:
            embed = model(self._by("models", e["model"]))
            f = guarded(item_ops.fields(self.items(e["data"])), embed.modality).select("id", "field_idx", "value")
            out[e["name"]] = vector_search.write_embedded(f, embed, e["output"], self.spark)
        return out

    def index(self) -> None:
        for i in self.config.indices:
            if i["type"] in ("keyword", "fuzzy", "full-text") and (self.force or not exists(self.spark, os.path.join(i["output"], "figures"))):
                words = text.plain_tokens if i["type"] == "full-text" else text.tokens
                text_search.build(self.items(i["data"]), words).save(i["output"], "overwrite")
            elif i["type"] not in ("keyword", "fuzzy", "full-text") and (self.force or not exists(self.spark, os.path.join(i["output"], "figures"))):
                options = DEFAULTS | (i.get("params") or {})
                v = self._vectors(i)
                few = v.limit(MANY + 1).count() <= MANY
                vector_search.index_table(v, i["output"], options["metric"], options["precision"], cells=not few and options["precision"] != "binary")

    def _vectors(self, i: dict) -> DataFrame:
        made = any(e["name"] == i["embedding_data"] for e in self.config.embeddings)
        source = self._by("embeddings", i["embedding_data"])["output"] if made else i["embedding_data"]
        if source.endswith(".safetensors"):
            return tensors.read_vectors(self.spark, source)[0].withColumnRenamed("pos", "field_idx")
        return self.spark.read.parquet(source)

    def engines(self) -> list[Engine]:
        out = []
        for i in self.config.indices:
            options = DEFAULTS | (i.get("params") or {})
            if i["type"] in ("keyword", "fuzzy", "full-text"):
                out.append(Engine(i["name"], i["type"], text_search.TextIndex.load(self.spark, i["output"]), self.items(i["data"]), description=i.get("description", "")))
                continue
            embed = model(self._by("models", i["model"])) if "model" in i else None
            items = self.items(i["data"]) if "data" in i else None
            out.append(Engine(i["name"], i["type"], vector_search.load_table(self.spark, i["output"]), items, embed, i.get("description", ""), options))
        return out

    def run(self) -> list[Engine]:
        self.data()
        self.embed()
        self.index()
        return self.engines()
