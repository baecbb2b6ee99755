"""Comparison of two datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from insight_spark.functions.tables import small_table
from insight_spark.operators.profile import duplicate_rows, missing_by_column, shape

TOP_MISSING = 10


def metric_table(df: DataFrame, insights: int = 0) -> DataFrame:
    """(metric, value): rows, cols, duplicate_rows, insights_count.

    Duplicates need one pass; rows come from file metadata.
    """
    size = shape(df).select(F.inline(F.array(
        F.struct(F.lit("rows").alias("metric"), F.col("rows").alias("value")),
        F.struct(F.lit("cols").alias("metric"), F.col("cols").alias("value")),
        F.struct(F.lit("insights_count").alias("metric"), F.lit(insights).cast("bigint").alias("value")),
    )))
    copies = duplicate_rows(df).select(F.lit("duplicate_rows").alias("metric"), F.col("duplicate_rows").alias("value"))
    return size.unionByName(copies)


def compare_metrics(a: DataFrame, b: DataFrame) -> DataFrame:
    """(metric, a, b, diff) of two metric tables.

    A side without the metric counts as 0 in the difference; duplicates have none.
    """
    left = a.select("metric", F.col("value").alias("a"))
    right = b.select("metric", F.col("value").alias("b"))
    diff = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    return left.join(right, "metric", "full").select(
        "metric", "a", "b", F.when(F.col("metric") != "duplicate_rows", diff).alias("diff")
    )


def ranked_missing(df: DataFrame, k: int = TOP_MISSING) -> DataFrame:
    """(rank, column, missing): the k columns with most missing values."""
    # one row per column of the schema
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("missing").desc(), "position")
    table = missing_by_column(df).withColumn("rank", F.row_number().over(order))
    return table.filter(F.col("rank") <= k).select("rank", "column", "missing")


def compare_top_missing(df_a: DataFrame, df_b: DataFrame, k: int = TOP_MISSING) -> DataFrame:
    a = ranked_missing(df_a, k).toDF("rank", "column_a", "missing_a")
    b = ranked_missing(df_b, k).toDF("rank", "column_b", "missing_b")
    return a.join(b, "rank", "full")


def compare_errors(errors_a: DataFrame, errors_b: DataFrame) -> DataFrame:
    """Errors of both sides, one after the other."""
    return errors_a.unionByName(errors_b)


def compare(df_a: DataFrame, df_b: DataFrame, name_a: str, name_b: str, *, insights: tuple[int, int] = (0, 0),
            errors: tuple[DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Side-by-side metrics, missing columns and errors of two tables."""
    spark = df_a.sparkSession
    out = {
        "datasets": small_table(spark, [(name_a, name_b)], "dataset_a string, dataset_b string"),
        "metrics": compare_metrics(metric_table(df_a, insights[0]), metric_table(df_b, insights[1])),
        "top_missing": compare_top_missing(df_a, df_b),
    }
    if errors:
        out["errors"] = compare_errors(*errors)
    return out
