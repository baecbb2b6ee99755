"""Time series: daily means, rolling average, trend.

All work on raw rows is one aggregate by calendar day; what follows runs on the
daily table, whose size is the number of days (times keys), not of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight_spark.functions.columns import (
    as_double,
    col,
    fields_of,
    is_datetime,
    is_numeric,
    normalize_missing,
    significant,
)
from insight_spark.functions.datetimes import as_timestamp, choose_format
from insight_spark.functions.tables import small_table
from insight_spark.operators.frequency import column_counts
from insight_spark.sources.scratch import ensure_checkpoint_dir

WINDOW_DAYS = 7
MIN_VALUES = 3
MIN_DAYS = 14

TREND_ADVICE = "Consider checking seasonality or outliers using weekly/monthly aggregation."


def detect_format(df: DataFrame, ts_col: str) -> int | None:
    """Number of the format a string column is read with."""
    field = df.schema[ts_col]
    if is_datetime(field.dataType):
        return None
    counts = column_counts(df.select(col(ts_col)), dates=True).first()
    return choose_format(counts.date_hits or [], counts.non_null)


def ts_valid_rows(df: DataFrame, ts_col: str, format_no: int | None = None) -> DataFrame:
    """Rows whose timestamp parses, with the parsed value in place."""
    field = df.schema[ts_col]
    if format_no is None:
        format_no = detect_format(df, ts_col)
    parsed = as_timestamp(col(ts_col), field.dataType, format_no)
    return df.select(*[parsed.alias(ts_col) if c == ts_col else col(c) for c in df.columns]).filter(
        col(ts_col).isNotNull()
    )


def ts_points(df: DataFrame, ts_col: str, format_no: int | None = None) -> DataFrame:
    return ts_valid_rows(df.select(col(ts_col)), ts_col, format_no).agg(F.count("*").alias("n_points"))


def daily_mean(df: DataFrame, ts_col: str, cols: Sequence[str], keys: Sequence[str] = (),
               format_no: int | None = None) -> DataFrame:
    """Mean of each column per calendar day; days without any value are left out."""
    df = normalize_missing(df)
    fields = [f for _, f in fields_of(df, cols)]
    wrong = [f.name for f in fields if not is_numeric(f.dataType)]
    if wrong:
        raise TypeError(f"Column '{wrong[0]}' is not numeric.")
    names = [f.name for f in fields]
    valid = ts_valid_rows(df.select(*[col(c) for c in dict.fromkeys([ts_col, *keys, *names])]), ts_col, format_no)
    days = valid.select(
        *[col(k) for k in keys],
        F.to_date(col(ts_col)).alias("day"),
        *[as_double(f).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    means = days.groupBy(*[col(k) for k in keys], "day").agg(
        *[F.avg(f"m{i}").alias(n) for i, n in enumerate(names)]
    )
    return means.filter(F.coalesce(*[col(n) for n in names]).isNotNull())


def daily_head(daily: DataFrame, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The first k days, of each key if there are keys."""
    return _ends(daily, F.col("day").asc(), k, keys)


def daily_tail(daily: DataFrame, k: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """The last k days, of each key if there are keys."""
    return _ends(daily, F.col("day").desc(), k, keys)


def _ends(daily: DataFrame, order: Column, k: int, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return daily.orderBy(order).limit(k)
    nth = F.row_number().over(Window.partitionBy(*[col(c) for c in keys]).orderBy(order))
    ranked = daily.select("*", nth.alias("__nth")).filter(F.col("__nth") <= k)
    return ranked.drop("__nth")


def daily_line(daily: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return daily.select(*[col(k) for k in keys], "day", col(value).alias("value"))


def rolling_mean(daily: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over 7 daily rows with at least 3 values; nothing below 14 days."""
    part = Window.partitionBy(*[col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1))
    recent = part.orderBy("day").rowsBetween(1 - WINDOW_DAYS, 0)
    v = col(value)
    mean = F.when(F.count(v).over(recent) >= MIN_VALUES, F.avg(v).over(recent))
    return (
        daily.select(*[col(k) for k in keys], "day", mean.alias("rolling"), F.count("*").over(part).alias("days"))
        .filter(F.col("days") >= MIN_DAYS)
        .drop("days")
    )


def trend_first_last(daily: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(col, first, last, delta) over the first and last day; needs two days."""
    v = col(value)
    ends = daily.groupBy(*[col(k) for k in keys]).agg(
        F.lit(value).alias("col"),
        F.min_by(v, "day").alias("first"),
        F.max_by(v, "day").alias("last"),
        F.count("*").alias("days"),
    )
    ends = ends.filter(F.col("days") >= 2).drop("days")
    return ends.withColumn("delta", F.col("last") - F.col("first"))


def trend_insight(trend: DataFrame) -> DataFrame:
    """One info row per trend with a known delta."""
    delta = F.col("delta")
    direction = F.when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("stayed flat")
    return trend.filter(delta.isNotNull()).select(
        "col",
        direction.alias("direction"),
        F.lit("info").alias("severity"),
        F.concat(F.lit("'"), "col", F.lit("' "), direction, F.lit(" over the observed period")).alias("title"),
        F.concat(
            F.lit("First="), significant(F.col("first")),
            F.lit(", Last="), significant(F.col("last")),
            F.lit(", Delta="), significant(delta),
        ).alias("evidence"),
        F.lit(TREND_ADVICE).alias("recommendation"),
    )


def kept_daily(df: DataFrame, ts_col: str, cols: Sequence[str], keys: Sequence[str] = (),
               format_no: int | None = None) -> DataFrame:
    """The daily table, checkpointed: one pass over the raw rows for all its readers."""
    ensure_checkpoint_dir(df.sparkSession)
    return daily_mean(df, ts_col, cols, keys, format_no).checkpoint()


def timeseries(df: DataFrame, ts_col: str, cols: Sequence[str], keys: Sequence[str] = (),
               value: str | None = None, format_no: int | None = None) -> dict[str, DataFrame]:
    """Time-series pack; the trend follows `value`, by default the first column."""
    spark = df.sparkSession

    def skip(reason: str) -> dict[str, DataFrame]:
        return {"skip": small_table(spark, [("timeseries", reason)], "pack string, skipped string")}

    if ts_col not in df.columns:
        return skip(f"Datetime column '{ts_col}' not found.")
    if format_no is None:
        format_no = detect_format(df, ts_col)
    points = ts_points(df, ts_col, format_no).first().n_points
    if not cols or points == 0:
        return skip("Not enough datetime rows or no numeric columns.")
    used = [c for c in cols if c in df.columns]
    if not used:
        return skip("No numeric columns found in dataframe.")
    value = value or used[0]
    daily = kept_daily(df, ts_col, used, keys, format_no)
    trend = trend_first_last(daily, value, keys)
    return {
        "numeric_cols": small_table(spark, [(c,) for c in used], "column string"),
        "points": small_table(spark, [(points,)], "n_points bigint"),
        "daily": daily,
        "daily_head": daily_head(daily, keys=keys),
        "daily_tail": daily_tail(daily, keys=keys),
        "trend_first_last": trend,
        "insights": trend_insight(trend),
        "daily_line": daily_line(daily, value, keys),
        "rolling": rolling_mean(daily, value, keys),
    }
