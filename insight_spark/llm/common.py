"""Shared helpers: stored tables, worker caches, text columns, grids of chunks, components."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """Shared folder of the session: spark.checkpoint.dir, or the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and reread: lineage ends here and survives lost executors."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache(key: str, build: Callable[[], Any]) -> Any:
    """A value that a Python worker builds once; module globals do not outlive a task, as code travels by value."""
    kept = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null as empty; other columns are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def slices(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grid(chunks: DataFrame, bound: int, *payload: str) -> DataFrame:
    """Deals chunks of cells (cell, side 'a' or 'b', n, payload) to sub-cells (cell, i, j).

    Every 'a' chunk of a cell meets every 'b' chunk of it in exactly one sub-cell. A cell whose
    side holds more than `bound` entries is split by whole chunks: its 'a' chunks go to one i and
    all j, its 'b' chunks to one j and all i. Cells with an empty side are left out.
    """

    def total(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))

    def parts(total: str) -> Column:
        return F.ceil(F.col(total) / bound).cast("int")

    totals = (
        chunks.groupBy("cell").agg(total("a").alias("_a"), total("b").alias("_b"))
        .filter("_a > 0 AND _b > 0")
        .select("cell", parts("_a").alias("_na"), parts("_b").alias("_nb"))
    )
    is_a = F.col("side") == "a"
    own = F.pmod(F.xxhash64(*payload), F.when(is_a, F.col("_na")).otherwise(F.col("_nb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(is_a, F.col("_nb")).otherwise(F.col("_na")) - 1))
    dealt = chunks.join(totals, "cell").withColumn("_own", own).withColumn("_other", other)
    return dealt.select(
        "cell",
        F.when(is_a, F.col("_own")).otherwise(F.col("_other")).alias("i"),
        F.when(is_a, F.col("_other")).otherwise(F.col("_own")).alias("j"),
        "side", *payload,
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b: long): rows (node, component = smallest node) of all linked nodes.

    Alternates large-star and small-star steps, each of them two shuffles of the edges, until
    nothing changes; every round is a stored table. Self links and repeated edges do not matter.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
               "edges")
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (
            small.select("a", F.col("m").alias("b"))
            .union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        e = stored(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(e.select("b", "b").distinct())
