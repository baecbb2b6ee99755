"""Small tables made on the driver."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of a few rows as a local relation.

    A plain list would become an RDD with one task per core of the cluster and an
    unknown size; a local relation needs no task and is broadcast by its real size.
    """
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    columns = list(zip(*rows)) if rows else [()] * len(struct)
    arrays = [
        pa.array([_plain(v, f.dataType) for v in values], type=arrow.field(i).type)
        for i, (values, f) in enumerate(zip(columns, struct.fields))
    ]
    table = spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=struct)
    table.rows_at_hand = len(rows)
    return table


def rows_at_hand(df: DataFrame) -> int | None:
    """Number of rows of a table made by `small_table`, whose rows need no computing; None of any other."""
    return df.__dict__.get("rows_at_hand")


def _plain(value, dt: T.DataType):
    if value is None:
        return None
    if isinstance(dt, T.StructType):
        return {f.name: _plain(v, f.dataType) for f, v in zip(dt.fields, value)}
    if isinstance(dt, T.MapType):
        return list(value.items())
    return value
