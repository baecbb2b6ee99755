"""The k smallest and largest distinct values of many columns, in their own types, with counts.

A task keeps the k smallest and the k largest distinct values of each column it has seen and sends only those, so
the first shuffle holds at most 2 k rows for each task and column. The k-th of them bounds the result:
a second scan counts the rows at or beyond the two bounds, which are at most 2 k distinct values of a column again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def task_edges(values: DataFrame, k: int) -> DataFrame:
    """(i, largest, value): from each task the k smallest and k largest distinct values of each column.

    The columns of `values` share one type; a missing value is NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        import pyarrow.compute as pc

        held = {}
        kind = None
        for batch in batches:
            for i, column in enumerate(batch.columns):
                kind = column.type
                seen = pc.drop_null(pc.unique(column))
                for largest in (False, True):
                    both = pa.concat_arrays([held[i, largest], seen]).unique() if (i, largest) in held else seen
                    order = pc.sort_indices(both, sort_keys=[("", "descending" if largest else "ascending")])
                    held[i, largest] = both.take(order[:k])
        for (i, largest), edge in held.items():
            n = len(edge)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * n, pa.int32()), pa.array([largest] * n, pa.bool_()), edge.cast(kind)], ["i", "largest", "value"])

    kind = values.schema.fields[0].dataType
    schema = T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("largest", T.BooleanType()), T.StructField("value", kind)])
    return values.mapInArrow(run, schema)


def bounds(values: DataFrame, k: int) -> dict[int, tuple]:
    """{column number: (k-th smallest, k-th largest distinct value)} of columns with values; two numbers a column."""
    edges = task_edges(values, k).distinct()
    value = F.col("value")
    ranked = []
    for largest, order in ((False, value.asc()), (True, value.desc())):
        rank = F.row_number().over(Window.partitionBy("i").orderBy(order))
        side = edges.filter(F.col("largest") == F.lit(largest)).withColumn("rank", rank).filter(F.col("rank") <= k)
        ranked.append(side)
    found = ranked[0].union(ranked[1]).groupBy("i").agg(
        F.max(F.when(~F.col("largest"), value)).alias("low"), F.min(F.when(F.col("largest"), value)).alias("high"))
    return {r.i: (r.low, r.high) for r in found.collect()}


def edge_counts(values: DataFrame, k: int) -> DataFrame:
    """(i, value, cnt): every value up to the k-th smallest or from the k-th largest on, of columns of one type."""
    kind = values.schema.fields[0].dataType
    limits = bounds(values, k)
    cells = []
    for i, name in enumerate(values.columns):
        if i in limits:
            c, (low, high) = F.col(name), (F.lit(v).cast(kind) for v in limits[i])
            at: Column = F.when((c <= low) | (c >= high), c)
            cells.append(F.struct(F.lit(i).alias("i"), at.alias("value")))
    if not cells:
        return values.limit(0).select(F.lit(0).alias("i"), F.col(values.columns[0]).alias("value"), F.lit(0).cast("bigint").alias("cnt"))
    long = values.select(F.inline(F.array(*cells))).filter("value IS NOT NULL")
    return long.groupBy("i", "value").agg(F.count("*").alias("cnt"))
