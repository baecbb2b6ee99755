"""Registered queries of the numbered operators, each over its whole table, in the columns their contracts fix."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat_format, collocations, conversation_repair, fingerprint, licenses, packing, secret_scan, simhash, suffix_dedup, token_shards, toxicity
from .oracle import ORACLES

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_prefix_forest(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), RANKS, PATTERN)


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    near = simhash.near_duplicates(table(spark, sf, "documents"))
    return near.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"  # conversation -1 says a template's control strings
    extra = spark.range(2).selectExpr(
        "CAST(-1 AS BIGINT) AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{control}' AS text")
    return chat_format.digests(chat_format.examples(turns.unionByName(extra)))


def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), WORDS)


def op6_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents"), secret_scan.fit(spark, WORDS))


def op8_token_shards(spark: SparkSession, sf: str) -> DataFrame:
    return token_shards.write(table(spark, sf, "documents"), RANKS, PATTERN)


def op9_syncmer_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.edited_and_next(table(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_repair.repaired_digests(table(spark, sf, "conversations"))


REGISTERED = (
    op1_prefix_forest, op2_byte_bpe, op3_simhash, op4_chat_format, op5_packing, op6_license_scan, op7_secret_scan,
    op8_token_shards, op9_syncmer_fingerprint, op10_toxicity, op11_suffix_dedup, op12_collocations,
    op13_conversation_repair,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


def all_oracles() -> dict[str, str]:
    """Of what SQL can say; models, tokenisers, random rotations and seeded hashes are not in it."""
    return dict(ORACLES)
