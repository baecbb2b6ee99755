"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, secrets are masked, the
rest is packed into sequences.

Every stage takes all that its predecessor kept, as Parquet, and returns the columns of documents; the
last returns the packed pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight_spark.llm import packing, secret_scan, simhash, toxicity
from insight_spark.llm.common import stored
from insight_spark.llm.queries import WORDS, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model of this corpus scores below its threshold; null texts count as empty.

    Where the labels fit no classifier (none usable, one kind only, or no telling sign) nothing is known of any
    document: all of them stay, and a warning says so.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        warnings.warn("no toxicity classifier could be fitted: all documents stay", stacklevel=2)
        return docs
    score = "__llm_score"
    return toxicity.score(docs, model, score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest doc_id."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked and n_chars counted again."""
    return secret_scan.redact(docs, secret_scan.fit(spark, WORDS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: No stage can be said in SQL (trained models, tokenisers); tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; every stage's result is a stored table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
