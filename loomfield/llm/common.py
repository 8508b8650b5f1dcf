"""What the operators of this subpackage share: materialised tables and schema helpers."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir

__all__ = ["discard", "free_shuffles", "lean", "materialise", "one_row", "shared_dir", "table", "texts", "tokenizer", "write_bytes"]


def discard(df: DataFrame) -> None:
    """Delete a table that `materialise` or `build` wrote, when nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    for a in range(0, len(data), 1 << 22):
        out.write(bytearray(data[a : a + (1 << 22)]))
    out.close()


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop shuffle files whose plans are gone, instead of waiting for its next collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow stage whose worker gives its free memory back to the machine at the end of each task: the worker stays for further tasks, beside the JVM's heap."""

    def stage(batches: Iterator) -> Iterator:
        yield from run(batches)
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text, and the extra columns, of a table that may hold more; null texts become empty, rows without doc_id go."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)


def one_row(docs: DataFrame) -> DataFrame:
    """doc_id and text, a doc_id once: of its distinct texts, sorted and joined."""
    found = texts(docs)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("doc_id").agg(F.concat_ws("\n", F.sort_array(F.collect_set("text"))).alias("text"))


def tokenizer(name: str, folder: str | None = None) -> str:
    """Path of a vocabulary file: in the folder given, that of LOOMFIELD_TOKENIZERS, or /opt/tokenizers."""
    return os.path.join(folder or os.environ.get("LOOMFIELD_TOKENIZERS", "/opt/tokenizers"), name)
