"""One registered query per training-data operator, with its DuckDB SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from presslens.llm import (
    alignment,
    bloomdedup,
    chat,
    harmonic,
    hostrules,
    hyperminhash,
    langid,
    packed,
    piecebpe,
    repair,
    ring,
    surrogates,
    wordbpe,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_format(_table(spark, sf_dir, "conversations"))


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op3_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_table(spark, sf_dir, "documents"))


def op4_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode_documents(_table(spark, sf_dir, "documents"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.pack_ids(_table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic.pack_documents(_table(spark, sf_dir, "documents"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.host_verdicts(_table(spark, sf_dir, "documents"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate_documents(_table(spark, sf_dir, "documents"))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_classes(_table(spark, sf_dir, "documents"))


def op10_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomdedup.exact_copies(_table(spark, sf_dir, "documents"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecebpe.encode_documents(_table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_chat_snapshots, op2_ring_shards, op3_language_centroids, op4_word_bpe, op5_packed_ids, op6_harmonic_packing, op7_host_rules,
    op8_surrogates, op9_hyperminhash, op10_bloom_dedup, op11_piece_bpe, op12_token_alignment, op13_conversation_repair)}
ORACLES: dict[str, str] = {"op1_chat_snapshots": chat.ORACLE, "op7_host_rules": hostrules.ORACLE, "op10_bloom_dedup": bloomdedup.ORACLE,
                           "op13_conversation_repair": repair.ORACLE}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
