"""Inputs of the registered queries: the given tables, whole, and null variants of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _replace(df: DataFrame, **exprs: str) -> DataFrame:
    return df.withColumns({c: F.expr(e) for c, e in exprs.items()})


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return _replace(
        table(spark, sf, "lineitem"),
        l_tax="CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END",
        l_discount="CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END",
        l_returnflag="CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END",
    )


def lineitem_const(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem_nulls(spark, sf).withColumn("k", F.lit(5.0))


def lineitem_dups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")


def orders_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return _replace(
        table(spark, sf, "orders"),
        o_orderpriority="CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END",
    )


def orders_strdate(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as text; every fifth does not parse."""
    return _replace(
        table(spark, sf, "orders"),
        o_orderdate="CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END",
    )


def events_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth day of the month has no values at all."""
    return _replace(
        table(spark, sf, "events"), value="CASE WHEN day(ts) % 4 = 0 THEN NULL ELSE value END"
    )


# datasets of the catalogue queries that stand for a table; the others are taken as given
VARIANTS = {"lineitem": lineitem_nulls, "orders": orders_nulls, "events": events_gaps}
TABLES = (
    "lineitem", "orders", "customer", "events", "region", "nation", "supplier", "part",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
DATASETS = {
    name: VARIANTS.get(name, lambda spark, sf, name=name: table(spark, sf, name)) for name in TABLES
}

# DuckDB definitions of the same inputs
INPUT_SQL = {
    "lineitem_nulls": """SELECT * REPLACE (
        CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax,
        CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_discount END AS l_discount,
        CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM lineitem""",
    "lineitem_const": "SELECT *, CAST(5.0 AS DOUBLE) AS k FROM lineitem_nulls",
    "lineitem_dups": "SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "orders_nulls": """SELECT * REPLACE (
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM orders""",
    "orders_strdate": """SELECT * REPLACE (
        CASE WHEN o_orderkey % 5 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_orderdate)
        FROM orders""",
    "events_gaps": """SELECT * REPLACE (
        CASE WHEN day(ts) % 4 = 0 THEN NULL ELSE value END AS value) FROM events""",
}

# columns and Spark type names of the tables the SQL side spells out
COLUMNS = {
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
        "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
        "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "orders": {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    },
    "customer": {
        "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
        "value": "double", "props": "string",
    },
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {
        "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
        "p_retailprice": "double",
    },
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}

# the table each catalogue dataset stands for in SQL
DATASET_SQL = {name: VARIANTS[name].__name__ if name in VARIANTS else name for name in TABLES}
