"""Schema, roles, missing values, duplicates, shape: the table profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insight_spark.functions.columns import (
    col,
    fields_of,
    is_datetime,
    is_numeric,
    is_string,
    name_at,
    normalize_missing,
    per_column,
)
from insight_spark.functions.datetimes import DATETIME_FORMATS, aggregated_format, best_format
from insight_spark.functions.tables import small_table
from insight_spark.operators.duplicates import repeated_groups
from insight_spark.operators.frequency import column_counts, top_values

ID_RATIO = 0.9
ID_MIN_UNIQUE = 20


def _described(counts: DataFrame, df: DataFrame) -> DataFrame:
    position = F.col("position")
    return counts.select(
        name_at(position, df.columns).alias("column"),
        "position",
        name_at(position, [f.dataType.simpleString() for f in df.schema.fields]).alias("dtype"),
        "n_rows",
        (F.col("n_rows") - F.col("non_null")).alias("missing"),
        "n_unique",
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, missing values, distinct non-missing values."""
    df = normalize_missing(df)
    return _described(column_counts(df), df)


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, position, n_rows, missing): one pass, no shuffle of data."""
    df = normalize_missing(df)
    wanted = [(p, f.name, col(f.name)) for p, f in fields_of(df)]
    stats = {"n_rows": lambda c: F.count("*"), "missing": lambda c: F.count("*") - F.count(c)}
    out = per_column(df, wanted, stats, fields=1)
    return out.select("column", "position", "n_rows", "missing")


def missing_total(df: DataFrame) -> DataFrame:
    return missing_by_column(df).agg(F.sum("missing").alias("missing_total"))


def missing_percent(missing: DataFrame) -> DataFrame:
    percent = F.col("missing") / F.greatest(F.col("n_rows"), F.lit(1)) * 100.0
    return missing.withColumn("percent", percent)


def most_missing(percent: DataFrame, k: int = 20) -> DataFrame:
    return percent.orderBy(F.col("missing").desc(), "position").limit(k).select("column", "missing", "percent")


def missing_top(df: DataFrame, k: int = 20) -> DataFrame:
    """The k columns with most missing values, ties in schema order."""
    return most_missing(missing_percent(missing_by_column(df)), k)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows; missing equals missing.

    Rows are counted by a digest of fixed width, and only rows whose digest repeats by their whole
    content (see `duplicates`); a large group of copies folds to one row per task in both shuffles.
    """
    if not df.columns:
        return df.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("duplicate_rows"))
    return repeated_groups(df).agg(F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("duplicate_rows"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("cols"))


def sample_rows(df: DataFrame, k: int = 5, order_by: Sequence[str] | None = None, tail: bool = False) -> DataFrame:
    """First (or last) k rows; give `order_by` for a repeatable choice."""
    if not order_by:
        return df.limit(k)
    keys = [col(c) for c in order_by]
    return df.orderBy(*[k_.desc() for k_ in keys] if tail else keys).limit(k)


def id_like(n_unique: Column, n_rows: Column) -> Column:
    """More than 20 distinct values filling over 90 % of the rows."""
    ratio = n_unique / F.greatest(n_rows, F.lit(1))
    return (n_rows > 0) & (n_unique > ID_MIN_UNIQUE) & (ratio > ID_RATIO)


def id_like_any_size(n_unique: Column, n_rows: Column) -> Column:
    """Distinct values fill at least 90 % of the rows, no minimum."""
    return (n_rows > 0) & (n_unique / F.greatest(n_rows, F.lit(1)) >= ID_RATIO)


def column_roles(df: DataFrame, probe: int | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Schema profile plus the roles numeric, categorical, datetime and id_like.

    A string column is a datetime when one known format parses over 70 % of its
    values. All values count; with `probe` and `order_by` only the first `probe`
    non-missing ones do.
    """
    df = normalize_missing(df)
    counts = column_counts(df, dates=True)
    if probe and order_by:
        counts = _probed(df, counts, probe, order_by)
    else:
        counts = counts.withColumn("format_no", best_format(F.col("date_hits"), F.col("non_null")))
    return roles_of(df, counts)


def _probed(df: DataFrame, counts: DataFrame, probe: int, order_by: Sequence[str]) -> DataFrame:
    hits = None
    for _, field in fields_of(df):
        if is_string(field.dataType):
            name = field.name
            first = df.filter(col(name).isNotNull()).orderBy(*[col(c) for c in order_by]).limit(probe)
            at = df.columns.index(name)
            part = column_counts(first.select(col(name)), dates=True).select(
                F.lit(at).alias("position"),
                best_format(F.col("date_hits"), F.col("non_null")).alias("format_no"),
            )
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return counts.withColumn("format_no", F.lit(None).cast("int"))
    return counts.join(hits, "position", "left")


def roles_of(df: DataFrame, counts: DataFrame) -> DataFrame:
    position = F.col("position")
    fields = df.schema.fields

    def among(test) -> Column:
        return position.isin([i for i, f in enumerate(fields) if test(f.dataType)])

    datetime = among(is_datetime) | F.col("format_no").isNotNull()
    described = counts.select(
        name_at(position, df.columns).alias("column"),
        "position",
        name_at(position, [f.dataType.simpleString() for f in fields]).alias("dtype"),
        "n_rows",
        (F.col("n_rows") - F.col("non_null")).alias("missing"),
        "n_unique",
        among(is_numeric).alias("numeric"),
        (among(is_string) & ~datetime).alias("categorical"),
        datetime.alias("datetime"),
        id_like(F.col("n_unique"), F.col("n_rows")).alias("id_like"),
        id_like_any_size(F.col("n_unique"), F.col("n_rows")).alias("id_like_any_size"),
        "format_no",
    )
    return described


def kind_roles(df: DataFrame, probe: int | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """(column, position, dtype, numeric, categorical, datetime, format_no): the roles that need no distinct counts.

    The schema decides all but string columns, and only those are read: each folds to its number of values and of
    those that each datetime format parses, a fixed width per task. With `probe` and `order_by` only the first
    `probe` non-missing values of a column count.
    """
    found = [
        (f.name, position, f.dataType.simpleString(), is_numeric(f.dataType), False, is_datetime(f.dataType), None)
        for position, f in fields_of(df) if not is_string(f.dataType)
    ]
    kinds = "column string, position int, dtype string, numeric boolean, categorical boolean, datetime boolean, format_no int"
    out = small_table(df.sparkSession, found, kinds)
    texts = [(position, f.name) for position, f in fields_of(df) if is_string(f.dataType)]
    types = [f.dataType.simpleString() for f in df.schema.fields]
    if probe and order_by:
        first = [(df.filter(col(n).isNotNull()).orderBy(*map(col, order_by)).limit(probe), [(p, n)]) for p, n in texts]
    else:
        first = [(df, texts)] if texts else []
    stats = {"format_no": lambda c: aggregated_format(c).cast("int")}
    for rows, wanted in first:
        dated = per_column(rows, [(p, n, col(n)) for p, n in wanted], stats, fields=len(DATETIME_FORMATS) + 1)
        out = out.unionByName(dated.select(
            "column", "position", name_at(F.col("position"), types).alias("dtype"), F.lit(False).alias("numeric"),
            F.col("format_no").isNull().alias("categorical"), F.col("format_no").isNotNull().alias("datetime"), "format_no"))
    return out


def datetime_roles(df: DataFrame, probe: int | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """(column, datetime) for every column."""
    return kind_roles(df, probe, order_by).select("column", "datetime")


def id_like_columns(df: DataFrame) -> DataFrame:
    profile = schema_profile(df)
    return profile.filter(id_like(F.col("n_unique"), F.col("n_rows"))).select("column", "n_unique", "n_rows")


def id_like_categorical(df: DataFrame) -> DataFrame:
    profile = schema_profile(df)
    return profile.filter(id_like_any_size(F.col("n_unique"), F.col("n_rows"))).select(
        "column", "n_unique", "n_rows"
    )


def dataset_type_of(has: dict[str, Column]) -> Column:
    return (
        F.when(has["datetime"] & has["numeric"], F.lit("timeseries"))
        .when(has["numeric"] | has["categorical"], F.lit("tabular"))
        .otherwise(F.lit("unknown"))
    )


def dataset_type(roles: DataFrame) -> DataFrame:
    """timeseries with datetime and numeric columns, else tabular, else unknown."""
    has = {r: F.coalesce(F.bool_or(r), F.lit(False)) for r in ("datetime", "numeric", "categorical")}
    return roles.agg(dataset_type_of(has).alias("dataset_type"))


def top_categoricals(df: DataFrame, cols: Sequence[str], k: int = 5, max_cols: int | None = None) -> DataFrame:
    """Top values of the categorical columns, or of the first `max_cols` of them."""
    top = top_values(df, list(cols)[:max_cols], k).filter("rank is not null")
    return top.select("column", "value", "cnt", "rank")


def snapshot(df: DataFrame, order_by: Sequence[str] | None = None, k: int = 20) -> dict[str, DataFrame]:
    """Data-quality pack: shape, duplicates, sample, missing values, skip rule."""
    top = missing_top(df, k)
    return {
        "shape": shape(df),
        "duplicate_rows": duplicate_rows(df),
        "sample_rows": sample_rows(normalize_missing(df), 5, order_by),
        "missing_top": top,
        "skip": snapshot_skip(df),
    }


def snapshot_skip(df: DataFrame) -> DataFrame:
    """One row with the skip reason when nothing is missing, else no row."""
    total = missing_total(df).withColumn("missing_total", F.coalesce("missing_total", F.lit(0)))
    return total.filter("missing_total <= 0").select(
        F.lit("snapshot").alias("pack"), F.lit("No missing values.").alias("skipped")
    )
