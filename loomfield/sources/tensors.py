"""Vectors in safetensors files, read and written without further libraries; and Parquet with a metadata side file."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import DataError

#: Bytes of vectors in a task, and in a batch of it.
PART, BATCH = 64 << 20, 4 << 20
_TYPES = {"F32": "<f4", "U32": "<u4", "F64": "<f8", "I64": "<i8", "I32": "<i4", "F16": "<f2"}


def read_tensors(path: str) -> tuple[dict[str, np.ndarray], dict[str, str]]:
    with open(path, "rb") as f:
        head = json.loads(f.read(struct.unpack("<Q", f.read(8))[0]))
        base = f.tell()
        meta = head.pop("__metadata__", {})
        out = {}
        for name, t in head.items():
            a, b = t["data_offsets"]
            f.seek(base + a)
            out[name] = np.frombuffer(f.read(b - a), _TYPES[t["dtype"]]).reshape(t["shape"])
    return out, meta


def write_tensors(path: str, tensors: dict[str, np.ndarray], meta: dict[str, str] | None = None) -> None:
    names = {np.dtype(v): k for k, v in _TYPES.items()}
    head: dict = {"__metadata__": meta or {}}
    at = 0
    for k, v in tensors.items():
        head[k] = {"dtype": names[v.dtype], "shape": list(v.shape), "data_offsets": [at, at + v.nbytes]}
        at += v.nbytes
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text)
        for v in tensors.values():
            f.write(np.ascontiguousarray(v).tobytes())


def read_header(path: str) -> tuple[dict[str, dict], dict[str, str], int]:
    """The tensors' types, shapes and offsets, the metadata, and where the data begin."""
    with open(path, "rb") as f:
        n = struct.unpack("<Q", f.read(8))[0]
        head = json.loads(f.read(n))
    return head, head.pop("__metadata__", {}), 8 + n


class VectorSource(DataSource):
    """Batch source `safetensors_vectors`: id, n and embedding of a file, read by ranges of rows. Option: path, of a file that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "safetensors_vectors"

    def schema(self) -> str:
        return "id long, n long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(self.options["path"])


class _VectorReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        head, _, _ = read_header(self.path)
        rows, dims = head["embedding"]["shape"]
        step = max(1, PART // max(1, 4 * dims))
        return [InputPartition((a, min(rows, a + step))) for a in range(0, rows, step)] or [InputPartition((0, 0))]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        head, _, base = read_header(self.path)
        lo, hi = partition.value
        dims = head["embedding"]["shape"][1]
        step = max(1, BATCH // max(1, 4 * dims))
        with open(self.path, "rb") as f:

            def part(name: str, kind: str, a: int, b: int, width: int) -> np.ndarray:
                f.seek(base + head[name]["data_offsets"][0] + a * width)
                return np.frombuffer(f.read((b - a) * width), kind)

            for a in range(lo, hi, step):
                b = min(hi, a + step)
                kind = _TYPES[head["id"]["dtype"]] if "id" in head else ""
                ids = part("id", kind, a, b, np.dtype(kind).itemsize).astype(np.int64) if kind else np.arange(a, b)
                flat = part("embedding", "<f4", a, b, 4 * dims)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * dims), pa.array(flat))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.arange(a, b)), vectors], ["id", "n", "embedding"])


def read_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """(id, pos, embedding) and the metadata of a file with `embedding` and, where vectors are keyed, `id`; else a vector's id is its place. The driver reads the header only."""
    head, meta, _ = read_header(path)
    vectors = head.get("embedding")
    if vectors is None or len(vectors["shape"]) != 2 or vectors["dtype"] != "F32":
        raise DataError("embedding must be a matrix of F32")
    ids = head.get("id")
    if ids is not None and (ids["shape"] != vectors["shape"][:1] or ids["dtype"] not in ("U32", "I32", "I64")):
        raise DataError("id must hold one number for each vector")
    spark.dataSource.register(VectorSource)
    return keyed(spark.read.format(VectorSource.name()).option("path", path).load()), meta


def keyed(df: DataFrame, order: str = "n") -> DataFrame:
    """(id, pos, embedding) of vectors with an id and an order."""
    return df.select("id", (F.row_number().over(Window.partitionBy("id").orderBy(order)) - 1).alias("pos"), "embedding")


def write_vectors(df: DataFrame, path: str, meta: dict[str, str], mode: str = "errorifexists") -> None:
    """Parquet, and model, provider and modality beside it."""
    df.write.mode(mode).parquet(path)
    text = json.dumps(meta, sort_keys=True)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(os.path.join(path, "_meta"))


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    row = spark.read.text(os.path.join(path, "_meta")).first()
    return json.loads(row.value) if row else {}
