"""Classes for interactive use: a data set, and indices over it, on the session that is there."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import items as ops
from .operators import text_search, vector_search
from .operators.ranking import Params
from .schema import DataError
from .sources import items as sources
from .sources import tensors


class Data:
    def __init__(self, items: DataFrame) -> None:
        self.items = items

    @classmethod
    def build_from_items(cls, items: list[dict], path: str) -> Data:
        return cls._saved(sources.from_rows(_spark(), items), path)

    @classmethod
    def build_from_jsonl(cls, file: str, path: str) -> Data:
        return cls._saved(sources.read_jsonl(_spark(), file), path)

    @classmethod
    def build_from_sparql_result(cls, file: str, path: str, format: str | None = None, default_field_type: str = "text") -> Data:
        return cls._saved(sources.read_results(_spark(), file, format, default_field_type), path)

    @classmethod
    def _saved(cls, items: DataFrame, path: str) -> Data:
        ops.save(items, path, force=True)
        return cls.load(path)

    @classmethod
    def load(cls, path: str) -> Data:
        return cls(_spark().read.parquet(path))

    def __len__(self) -> int:
        return self.items.count()

    def is_empty(self) -> bool:
        return self.items.isEmpty()

    def __iter__(self) -> Iterator[tuple[str, list[str]]]:
        for r in ops.values(self.items.orderBy("id")).toLocalIterator():
            yield r.identifier, r["values"]

    def _one(self, id: int, *cols):
        return self.items.where(F.col("id") == id).select(*cols).first()

    def identifier(self, id: int) -> str | None:
        r = self._one(id, "identifier")
        return r and r[0]

    def id_from_identifier(self, identifier: str) -> int | None:
        r = self.items.where(F.col("identifier") == identifier).select("id").first()
        return r and r[0]

    def num_fields(self, id: int) -> int | None:
        r = self._one(id, F.size("fields"))
        return r and r[0]

    def field(self, id: int, n: int) -> str | None:
        r = self._one(id, ops.value_at(n))
        return r and r[0]

    def fields(self, id: int) -> list[str] | None:
        r = self._one(id, F.transform("fields", lambda f: f["value"]))
        return r and r[0]

    def main_field(self, id: int) -> str | None:
        r = self._one(id, ops.main_field()["value"])
        return r and r[0]


class _TextIndex:
    index_type = ""

    def __init__(self, data: Data, index: text_search.TextIndex) -> None:
        self._data, self._index = data, index

    @classmethod
    def build(cls, data: Data, path: str) -> None:
        text_search.build(data.items, text.tokens).save(path, "overwrite")

    @classmethod
    def load(cls, data: Data, path: str):
        return cls(data, text_search.TextIndex.load(_spark(), path))

    def data(self) -> Data:
        return self._data

    def search(self, query: str, k: int = 10, exact: bool = False, min_score: float | None = None, allow_ids: set[int] | None = None) -> list[tuple[int, int, float]]:
        find = text_search.keyword if self.index_type == "keyword" else text_search.fuzzy
        return _tuples(find(self._index, _spark().createDataFrame([(0, query)], "q_id long, query string"), Params(k, min_score, exact), _allow(allow_ids)))


class KeywordIndex(_TextIndex):
    index_type = "keyword"


class FuzzyIndex(_TextIndex):
    index_type = "fuzzy"


class EmbeddingIndex:
    index_type = "embedding-with-data"

    def __init__(self, data: Data, index: vector_search.VectorIndex, meta: dict[str, str]) -> None:
        self._data, self._index, self._meta = data, index, meta

    @classmethod
    def build(cls, data: Data, embeddings: str, path: str, metric: str | None = None, precision: str | None = None) -> None:
        vectors, meta = tensors.read_vectors(_spark(), embeddings)
        f = ops.fields(data.items).select("id", "field_idx")
        from .schema import number

        joined = vector_search.attach(number(f, "id", "field_idx", into="field_id"), vectors.select(F.col("id").alias("n"), "embedding"))
        tensors.write_vectors(joined, path, meta | {"metric": metric or "", "precision": precision or "float32"}, "overwrite")

    @classmethod
    def load(cls, data: Data, path: str) -> EmbeddingIndex:
        meta = tensors.read_meta(_spark(), path)
        vectors = _spark().read.parquet(*[os.path.join(path, "*.parquet")])
        return cls(data, vector_search.build(vectors, meta.get("metric") or None, meta.get("precision") or "float32"), meta)

    def data(self) -> Data:
        return self._data

    @property
    def num_dimensions(self) -> int:
        r = self._index.vectors.select(F.size("embedding")).first()
        return r[0] if r else 0

    @property
    def model(self) -> str | None:
        return self._meta.get("model")

    @property
    def provider(self) -> str | None:
        return self._meta.get("provider")

    @property
    def modality(self) -> str | None:
        return self._meta.get("modality")

    def search(self, embedding: list[float], k: int = 10, exact: bool = False, min_score: float | None = None, rerank: float | None = None, allow_ids: set[int] | None = None) -> list[tuple[int, int, float]]:
        q = _spark().createDataFrame([(0, [float(x) for x in embedding])], "q_id long, embedding array<float>")
        return _tuples(vector_search.search(self._index, q, Params(k, min_score, exact, rerank), _allow(allow_ids)))

    def search_neighbor(self, id: int, k: int = 10, exact: bool = False, min_score: float | None = None, rerank: float | None = None, allow_ids: set[int] | None = None) -> list[tuple[int, int, float]]:
        if self._index.vectors.where(F.col("id") == id).isEmpty():
            raise DataError(f"no vectors of item {id}")
        wanted = _spark().createDataFrame([(id,)], "id long")
        return _tuples(vector_search.neighbors(self._index, wanted, Params(k, min_score, exact, rerank), _allow(allow_ids)))


def _spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _allow(ids: set[int] | None) -> DataFrame | None:
    return None if ids is None else _spark().createDataFrame([(i,) for i in sorted(ids)], "id long")


def _tuples(hits: DataFrame) -> list[tuple[int, int, float]]:
    return [(r.id, r.field_idx, r.score) for r in hits.orderBy("rank").collect()]
