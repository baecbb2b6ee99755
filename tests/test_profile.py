import math

import pytest
from pyspark.sql import functions as F

from insight_spark.functions.columns import normalize_missing
from insight_spark.operators import frequency, profile
from insight_spark.operators.timeseries import detect_format, ts_points

NAN = float("nan")
INF = float("inf")


def one(df):
    return df.first()


def test_nan_equals_null(spark, rows):
    df = spark.createDataFrame([(NAN,), (None,), (1.0,), (NAN,)], "a double")
    assert rows(profile.schema_profile(df)) == [("a", 0, "double", 4, 3, 1)]
    assert one(profile.duplicate_rows(df))[0] == 2
    assert one(profile.missing_total(df))[0] == 3


def test_infinity_is_a_value(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (INF,)], "a double")
    assert one(profile.schema_profile(df)).missing == 0
    assert one(profile.schema_profile(df)).n_unique == 3


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "a double")
    assert one(profile.schema_profile(df)).n_unique == 1
    assert one(profile.duplicate_rows(df))[0] == 1


@pytest.mark.parametrize(
    ("n", "distinct", "strict", "loose"),
    [(20, 20, False, True), (21, 21, True, True), (100, 90, False, True), (100, 91, True, True), (100, 89, False, False)],
)
def test_id_like_edges(spark, n, distinct, strict, loose):
    df = spark.range(n).select((F.col("id") % distinct).cast("int").alias("k"))
    assert (profile.id_like_columns(df).count() == 1) is strict
    assert (profile.id_like_categorical(df).count() == 1) is loose


@pytest.mark.parametrize(
    ("values", "role"),
    [
        (["2024-01-01"] * 70 + ["x"] * 30, "categorical"),
        (["2024-01-01"] * 71 + ["x"] * 29, "datetime"),
        ([], "categorical"),
        ([None, None], "categorical"),
        (["12/31/2023", "01/02/2024"], "datetime"),
        (["31.12.2023", "01.02.2024"], "datetime"),
        (["2020", "2021"], "datetime"),
        (["1", "2"], "categorical"),
        (["20240131", "20240201"], "datetime"),
        (["2024-01-01T10:00:00", "2024-01-02 11:30:00.5"], "datetime"),
        (["2024-13-45", "2024-99-01"], "categorical"),
    ],
)
def test_datetime_roles(spark, values, role):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    r = one(profile.column_roles(df))
    assert r[role] and not r["numeric"] and r["categorical"] != r["datetime"]


def test_datetime_probe_reads_first_values_only(spark):
    data = [(i, "2024-01-01" if i < 50 else "x") for i in range(200)]
    df = spark.createDataFrame(data, "i int, s string")
    assert not profile.column_roles(df).filter("column = 's'").first().datetime
    assert profile.column_roles(df, probe=50, order_by=["i"]).filter("column = 's'").first().datetime


def test_string_dates_use_one_format(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("01/03/2024",)], "s string")
    assert detect_format(df, "s") == 0
    assert one(ts_points(df, "s")).n_points == 2


def test_roles_by_type(spark, rows):
    df = spark.sql(
        "select 1 i, 1.5D d, true b, cast(1.25 as decimal(5,2)) m, 'x' s, date'2024-01-01' t, "
        "timestamp_ntz'2024-01-01 00:00:00' z, array(1) a"
    )
    got = {r.column: r for r in profile.column_roles(df).collect()}
    assert [c for c, r in got.items() if r.numeric] and {c for c, r in got.items() if r.numeric} == set("idbm")
    assert {c for c, r in got.items() if r.categorical} == {"s"}
    assert {c for c, r in got.items() if r.datetime} == set("tz")


def test_dataset_type(spark):
    def kind(sql):
        return one(profile.dataset_type(profile.column_roles(spark.sql(sql)))).dataset_type

    assert kind("select 1 a, date'2024-01-01' t") == "timeseries"
    assert kind("select 1 a, 'x' s") == "tabular"
    assert kind("select date'2024-01-01' t") == "unknown"
    assert kind("select array(1) a") == "unknown"


def test_nested_types_are_profiled(spark):
    df = spark.sql(
        "select array(1,2) a, map('k', 1) m, struct(1 as x) s union all "
        "select array(1,2), map('k', 1), struct(2 as x) union all select null, null, null"
    )
    got = {r.column: (r.missing, r.n_unique) for r in profile.schema_profile(df).collect()}
    assert got == {"a": (1, 1), "m": (1, 1), "s": (1, 2)}
    assert one(profile.duplicate_rows(df))[0] == 0


def test_two_columns_of_one_nested_type(spark, rows):
    df = spark.sql("select map('a', 1) m, map('b', 2) n, array(1) p, array(2) q union all "
                   "select map('a', 1), map('c', 2), array(1), null")
    got = {r.column: (r.missing, r.n_unique) for r in profile.schema_profile(df).collect()}
    assert got == {"m": (0, 1), "n": (0, 2), "p": (0, 1), "q": (1, 1)}


def test_empty_table(spark, rows):
    df = spark.createDataFrame([], "a int, s string")
    assert one(profile.duplicate_rows(df))[0] == 0
    assert rows(profile.missing_top(df)) == [("a", 0, 0.0), ("s", 0, 0.0)]
    assert rows(profile.schema_profile(df)) == [("a", 0, "int", 0, 0, 0), ("s", 1, "string", 0, 0, 0)]
    assert rows(profile.shape(df)) == [(0, 2)]
    assert profile.id_like_columns(df).count() == 0


def test_names_with_dots_and_backticks(spark, rows):
    df = spark.createDataFrame([(1, "x"), (None, "y")], ["a.b", "c`d"])
    assert rows(profile.schema_profile(df), "column", "missing", "n_unique") == [("a.b", 1, 1), ("c`d", 0, 2)]
    assert rows(profile.missing_top(df), "column", "missing") == [("a.b", 1), ("c`d", 0)]


def test_top_values_ties_by_value(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), ("c",), (None,)], "c string")
    assert rows(profile.top_categoricals(df, ["c"])) == [("c", "a", 2, 1), ("c", "b", 2, 2), ("c", "c", 1, 3)]


def test_long_texts_count_whole(spark):
    base = "x" * 5000
    df = spark.createDataFrame([(base + "1",), (base + "1",), (base + "2",), ("short",)], "t string")
    assert one(profile.schema_profile(df)).n_unique == 3
    assert one(profile.duplicate_rows(df))[0] == 1
    top = frequency.top_values(df, ["t"], 1).first()
    assert (top.value, top.cnt, top.non_null, top.n_unique) == (base + "1", 2, 4, 3)


def test_text_that_looks_like_a_digest(spark):
    import hashlib

    long = "y" * 100
    fake = "#" + hashlib.sha256(long.encode()).hexdigest()
    df = spark.createDataFrame([(long,), (fake,)], "t string")
    assert one(profile.schema_profile(df)).n_unique == 2
    assert {r.value for r in frequency.top_values(df, ["t"], 5).collect()} == {long, fake}


def test_snapshot_skip_and_sample(spark, rows):
    df = spark.createDataFrame([(2,), (1,)], "a int")
    tables = profile.snapshot(df, order_by=["a"])
    assert rows(tables["skip"]) == [("snapshot", "No missing values.")]
    assert [r.a for r in tables["sample_rows"].collect()] == [1, 2]
    assert profile.snapshot_skip(spark.createDataFrame([(None,)], "a int")).count() == 0


def test_missing_top_keeps_zero_columns_and_order(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, None)], "a int, b int, c int")
    assert [(r.column, r.percent) for r in profile.missing_top(df).collect()] == [("b", 100.0), ("c", 50.0), ("a", 0.0)]


def test_n_unique_estimate_is_close(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("k"), F.lit(None).cast("string").alias("s"))
    got = {r.column: r.n_unique for r in frequency.n_unique(df, approx=True).collect()}
    assert got["s"] == 0 and math.isclose(got["k"], 5000, rel_tol=0.03)
    nested = spark.sql("select map('a', 1) m, array(1) a union all select map('b', 1), array(1)")
    assert {r.column: r.n_unique for r in frequency.n_unique(nested, approx=True).collect()} == {"m": 2, "a": 1}


def test_normalize_missing_keeps_types(spark):
    df = spark.createDataFrame([(NAN, NAN, 1)], "f float, d double, i int")
    clean = normalize_missing(df)
    assert clean.dtypes == df.dtypes and tuple(clean.first()) == (None, None, 1)


def test_kinds_are_those_of_the_whole_roles(spark):
    df = spark.sql("""SELECT id, CAST(id AS string) AS s, date_format(timestamp'2024-01-01' + make_interval(0, 0, 0, id), 'yyyy-MM-dd') AS d,
        CAST(NULL AS string) AS n, current_date() AS t, id > 3 AS b, array(id) AS a, CASE WHEN id < 6 THEN 'x' ELSE '2024/1/2' END AS m
        FROM range(10) AS r(id)""")
    kinds = ["column", "position", "dtype", "numeric", "categorical", "datetime", "format_no"]

    def sort(t):
        return sorted((tuple(r) for r in t.select(*kinds).collect()), key=lambda r: r[1])

    assert sort(profile.kind_roles(df)) == sort(profile.column_roles(df))
    empty = df.filter("id < 0")
    assert sort(profile.kind_roles(empty)) == sort(profile.column_roles(empty))
    numbers = df.select("id", "b")
    assert sort(profile.kind_roles(numbers)) == sort(profile.column_roles(numbers))
