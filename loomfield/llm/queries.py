"""Queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, langid, mpeg, neardup, pieces, secrets, sharding, store, suffix
from .common import table, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def op1_containment_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.parse(mpeg.media(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op5_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.reshard(table(spark, sf_dir, "documents"), sharding.WEIGHTS, sharding.grown())


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passages(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.detect(docs, langid.train(docs))


def op8_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.Pieces.load(tokenizer("piece_bpe_32k.model")))


def op9_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.verify(store.build(table(spark, sf_dir, "documents"), pieces.Pieces.load(tokenizer("piece_bpe_32k.model"))))


def op10_chat_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.trees(table(spark, sf_dir, "conversations"), pieces.Pieces.load(tokenizer("piece_bpe_32k.model")))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_rendezvous_sharding": sharding.oracle()}
