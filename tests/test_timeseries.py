import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from insight_spark.functions.columns import clamp01, safe_name, significant
from insight_spark.operators import deep, profile
from insight_spark.operators import timeseries as ts


def daily(spark, values):
    data = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "day date, v double")


def test_rolling_needs_three_values_in_seven_rows(spark):
    df = daily(spark, [1.0, None, 3.0, 4.0, None, 6.0, 7.0, 8.0] + [None] * 6)
    got = [r.rolling for r in ts.rolling_mean(df, "v").orderBy("day").collect()]
    want = [None, None, None, 8 / 3, 8 / 3, 3.5, 4.2, 5.6, 28 / 5, 25 / 4, 7.0, 7.0, None, None]
    assert all((g is None and w is None) or math.isclose(g, w) for g, w in zip(got, want))


@pytest.mark.parametrize(("days", "rows"), [(13, 0), (14, 14)])
def test_rolling_needs_fourteen_days(spark, days, rows):
    assert ts.rolling_mean(daily(spark, [1.0] * days), "v").count() == rows


def test_rolling_per_key(spark):
    df = daily(spark, [1.0] * 14).withColumn("k", F.lit("a")).unionByName(
        daily(spark, [2.0] * 13).withColumn("k", F.lit("b"))
    )
    got = ts.rolling_mean(df, "v", keys=["k"])
    assert {r.k for r in got.collect()} == {"a"} and got.count() == 14


@pytest.mark.parametrize(
    ("values", "direction", "delta"),
    [
        ([1.0, 5.0], "increased", 4.0),
        ([5.0, 9.0, 1.0], "decreased", -4.0),
        ([2.0, 7.0, 2.0], "stayed flat", 0.0),
        ([None, 5.0], None, None),
        ([1.0], None, None),
    ],
)
def test_trend(spark, values, direction, delta):
    trend = ts.trend_first_last(daily(spark, values), "v")
    rows = trend.collect()
    assert len(rows) == (1 if len(values) > 1 else 0)
    if rows:
        assert rows[0].delta == delta
    insights = ts.trend_insight(trend).collect()
    assert [r.direction for r in insights] == ([direction] if direction else [])


def test_daily_mean_drops_days_without_values(spark, rows):
    data = [
        (dt.datetime(2024, 1, 1, 3), 1.0, None),
        (dt.datetime(2024, 1, 1, 23), 3.0, None),
        (dt.datetime(2024, 1, 2), None, None),
        (dt.datetime(2024, 1, 5), None, 4.0),
        (None, 9.0, 9.0),
    ]
    df = spark.createDataFrame(data, "t timestamp_ntz, a double, b double")
    got = rows(ts.daily_mean(df, "t", ["a", "b"]))
    assert got == [(dt.date(2024, 1, 1), 2.0, None), (dt.date(2024, 1, 5), None, 4.0)]


def test_daily_mean_of_nan_booleans_and_strings(spark):
    df = spark.createDataFrame(
        [("2024-01-01", float("nan"), True), ("bad", 1.0, True), ("2024-01-01", 4.0, False)],
        "t string, a double, f boolean",
    )
    r = ts.daily_mean(df, "t", ["a", "f"]).first()
    assert (r.a, r.f) == (4.0, 0.5)
    with pytest.raises(TypeError, match="'t' is not numeric"):
        ts.daily_mean(df, "t", ["t"])


def test_pack_skips(spark):
    df = spark.createDataFrame([(None, 1)], "t timestamp, v int")
    reason = {
        ("x", ("v",)): "Datetime column 'x' not found.",
        ("t", ("v",)): "Not enough datetime rows or no numeric columns.",
    }
    for (col, cols), text in reason.items():
        assert ts.timeseries(df, col, list(cols))["skip"].first().skipped == text
    filled = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1)], "t timestamp, v int")
    assert ts.timeseries(filled, "t", [])["skip"].count() == 1
    assert ts.timeseries(filled, "t", ["w"])["skip"].first().skipped == "No numeric columns found in dataframe."
    assert ts.timeseries(filled, "t", ["v"])["daily_line"].count() == 1


@pytest.mark.parametrize(
    "x",
    [0.0, 1.0, -1.0, 0.5, 12.3456, 1234.0, 1234.5, 12345.0, 9999.6, 99995.0, 0.0001, 0.00012345, 0.000012345,
     1e20, -3.1e-10, 420.0, 100.0, 1e100, 999.95, 9999.5, 2.5e-300],
)
def test_significant_matches_printf(spark, x):
    got = spark.range(1).select(significant(F.lit(x)).alias("s")).first().s
    assert got == f"{x:.4g}"


def test_small_functions(spark):
    r = spark.range(1).select(
        significant(F.lit(float("nan"))).alias("nan"), significant(F.lit(float("-inf"))).alias("inf"),
        significant(F.lit(None).cast("double")).alias("none"), clamp01(F.lit(1.5)).alias("hi"),
        clamp01(F.lit(-2.0)).alias("lo"), safe_name(F.lit("a b/c")).alias("name"),
    ).first()
    assert tuple(r) == ("nan", "-inf", None, 1.0, 0.0, "a_b_c")


def test_instants_with_offsets_fall_on_one_day(spark):
    """One instant said in two ways, in daily means, ranges and roles."""
    texts = ["2024-01-01T23:00:00-05:00", "2024-01-02T04:00:00+00:00", "2024-01-02T04:00Z", "2024-01-02T09:30:00+0530", "2024-01-02 04:00:00"]
    df = spark.createDataFrame([(t, 1.0) for t in texts], "t string, v double")
    assert [(str(r.day), r.v) for r in ts.daily_mean(df, "t", ["v"]).collect()] == [("2024-01-02", 1.0)]
    found = deep.datetime_range(df, ["t"]).first()
    assert str(found["min"]) == str(found["max"]) and str(found["min"]).startswith("2024-01-02")
    assert [r.datetime for r in profile.column_roles(df).orderBy("position").collect()] == [True, False]
