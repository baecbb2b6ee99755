"""Write results: report JSON, report text, chart CSV, profile tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import FLOATING, col, finite


def sanitize(c: Column, dt: T.DataType) -> Column:
    """NaN and infinities become NULL at any depth."""
    if isinstance(dt, FLOATING):
        return finite(c).cast(dt)
    if not _has_floats(dt):
        return c
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: sanitize(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _, v: sanitize(v, dt.valueType))
    fields = [sanitize(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]
    return F.when(c.isNotNull(), F.struct(*fields))


def _has_floats(dt: T.DataType) -> bool:
    if isinstance(dt, FLOATING):
        return True
    if isinstance(dt, T.ArrayType):
        return _has_floats(dt.elementType)
    if isinstance(dt, T.MapType):
        return _has_floats(dt.valueType)
    return isinstance(dt, T.StructType) and any(_has_floats(f.dataType) for f in dt.fields)


def sanitize_json(df: DataFrame) -> DataFrame:
    return df.select(*[sanitize(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def to_report_json(df: DataFrame) -> DataFrame:
    """One JSON object per row; missing values are written as null."""
    clean = sanitize_json(df)
    row = F.struct(*[col(c) for c in clean.columns])
    return clean.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def write_report_json(df: DataFrame, path: str) -> None:
    to_report_json(df).write.mode("errorifexists").text(path)


def write_report_lines(lines: DataFrame, path: str) -> None:
    """Report text, one sorted part per dataset."""
    (
        lines.repartition("dataset")
        .sortWithinPartitions("dataset", "line_no")
        .select("dataset", "line")
        .write.mode("errorifexists")
        .partitionBy("dataset")
        .text(path)
    )


def write_chart_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, quotes doubled, missing values empty."""
    df.write.mode("errorifexists").csv(path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue="")


def safe_file_name(name: str) -> str:
    return re.sub("[ /]", "_", name)


def write_profile(tables: dict[str, DataFrame], path: str, dataset: str = "dataset") -> list[str]:
    """Write each table of a deep profile as parquet below the dataset's safe name."""
    written = []
    for name, table in tables.items():
        target = f"{path.rstrip('/')}/{safe_file_name(dataset)}.profile/{name}"
        table.write.mode("errorifexists").parquet(target)
        written.append(target)
    return written


def union_rows(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several chart tables under the union of their columns."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
