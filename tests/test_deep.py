import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from insight_spark.operators import deep
from insight_spark.operators.numeric import numeric_histogram

INF = float("inf")


def test_types_and_overview(spark):
    data = [(i, i % 2 == 0, f"http://h/{i}", f"some text {i}", "ab"[i % 2], [i], dt.date(2024, 1, 1)) for i in range(60)]
    df = spark.createDataFrame(data, "n int, b boolean, u string, t string, c string, a array<int>, d date")
    kinds = {r.column: r.type for r in deep.variable_types(df).collect()}
    assert kinds == {"n": "numeric", "b": "boolean", "u": "url", "t": "text", "c": "categorical",
                     "a": "unsupported", "d": "datetime"}
    o = deep.overview(df.unionByName(df.limit(1))).first()
    assert (o.rows, o.columns, o.duplicate_rows, o.missing_cells) == (61, 7, 1, 0)
    assert all(o[f"n_{t}"] == 1 for t in deep.TYPES)


def test_numeric_profile_matches_pandas(spark):
    rng = np.random.default_rng(7)
    values = [None if i % 9 == 0 else float(v) for i, v in enumerate(rng.gamma(2.0, 3.0, 500) - 2)] + [0.0] * 20
    r = deep.numeric_profile(spark.createDataFrame([(v,) for v in values], "v double")).first()
    s = pd.Series(values, dtype="float64").dropna()
    want = {
        "mean": s.mean(), "std": s.std(), "variance": s.var(), "min": s.min(), "max": s.max(), "sum": s.sum(),
        "range": s.max() - s.min(), "p5": s.quantile(0.05), "median": s.median(), "p95": s.quantile(0.95),
        "iqr": s.quantile(0.75) - s.quantile(0.25), "mad": (s - s.median()).abs().median(),
        "skewness": s.skew(), "kurtosis": s.kurt(), "cv": s.std() / s.mean(),
    }
    for name, w in want.items():
        assert math.isclose(r[name], w, rel_tol=1e-9), name
    assert (r["count"], r.missing, r.n_zeros, r.n_negative) == (len(s), len(values) - len(s), 20, int((s < 0).sum()))
    assert r.n_unique == s.nunique()


def test_numeric_profile_edges(spark):
    df = spark.createDataFrame([(5.0, None, INF), (5.0, None, 1.0), (5.0, None, -INF), (5.0, None, 2.0)],
                               "k double, e double, i double")
    got = {r.column: r for r in deep.numeric_profile(df).collect()}
    assert (got["k"].skewness, got["k"].kurtosis, got["k"].mad, got["k"].std) == (0.0, 0.0, 0.0, 0.0)
    assert got["e"]["count"] == 0 and got["e"].median is None and got["e"].mean is None
    assert got["i"].n_infinite == 2 and got["i"].median == 1.5


def test_histogram(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("v"), F.lit(3.0).alias("k"))
    bins = deep.histogram(df, ["v", "k"], bins=10).collect()
    v = sorted((b.bin_start, b.cnt) for b in bins if b.column == "v")
    assert v == [(10.0 * i, 10) for i in range(9)] + [(90.0, 11)]
    assert [b.cnt for b in bins if b.column == "k"] == [101]


@pytest.mark.parametrize("values", [[5e-324, 0.0], [-1.7e308, 1.7e308], [1e-320, 1.0], [1e18, 1e18 + 256]])
def test_histograms_of_extreme_ranges(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert sum(b.cnt for b in deep.histogram(df, ["v"]).collect()) == 2
    assert sum(b.cnt for b in numeric_histogram(df, ["v"]).collect()) == 2


def test_extreme_values(spark):
    df = spark.createDataFrame([(v,) for v in (3, 1, 1, 2, 9, None)], "v int")
    got = {(r.side, r["rank"]): (r.value, r.cnt) for r in deep.extreme_values(df, ["v"], k=2).collect()}
    assert got == {("smallest", 1): (1.0, 2), ("smallest", 2): (2.0, 1), ("largest", 1): (9.0, 1), ("largest", 2): (3.0, 1)}


def test_extreme_values_keep_their_type(spark):
    big = 2**53
    rows = [(big, True, 0.5), (big + 1, None, float("nan")), (big + 3, False, -0.5)]
    df = spark.createDataFrame(rows, "i bigint, b boolean, f double").selectExpr("*", "CAST(i AS DECIMAL(38, 2)) / 100 AS d")
    got = {(r.column, r.side, r["rank"]): (r.value, r.exact, r.cnt) for r in deep.extreme_values(df, k=3).collect()}
    assert [got["i", "smallest", n][1:] for n in (1, 2, 3)] == [(str(big), 1), (str(big + 1), 1), (str(big + 3), 1)]
    assert got["i", "largest", 1][1] == str(big + 3) and got["b", "largest", 1] == (1.0, "1", 1)
    assert got["f", "smallest", 1] == (-0.5, None, 1) and ("f", "smallest", 3) not in got
    assert got["d", "smallest", 2][1].startswith("90071992547409.93")
    assert deep.extreme_values(df.select(F.lit("x").alias("t"))).collect() == []


def test_text_tables(spark, rows):
    df = spark.createDataFrame([("Hello, \u00a0hello\nWörld!",), ("-- 'hello'",), (None,), ("",)], "t string")
    assert rows(deep.word_counts(df)) == [("t", "hello", 3), ("t", "wörld", 1)]
    chars = {r.char: r.cnt for r in deep.char_counts(df).collect()}
    assert chars["l"] == 7 and chars["ö"] == 1 and chars["\n"] == 1 and "" not in chars
    r = deep.text_length(df).first()
    assert (r["count"], r["min"], r["max"], r.median, r.total) == (3, 0, 20, 10.0, 30)


def test_chars_beyond_the_basic_plane(spark, rows):
    df = spark.createDataFrame([("a😀😀",)], "t string")
    assert rows(deep.char_counts(df)) == [("t", "a", 1), ("t", "😀", 2)]


def test_url_parts(spark, rows):
    df = spark.createDataFrame([("https://a.b/x?q=1#f",), ("http://a.b/y",), ("not a url",), (None,)], "u string")
    got = {(r.part, r.value): r.cnt for r in deep.url_parts(df, ["u"]).collect()}
    assert got["host", "a.b"] == 2 and got["scheme", "https"] == 1 and got["path", "/x"] == 1


def test_datetime_tables(spark, rows):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 31),), (dt.date(2024, 3, 1),), (None,)], "d date")
    r = deep.datetime_range(df).first()
    assert (r["count"], r.range_days) == (3, 60.0)
    assert rows(deep.datetime_histogram(df)) == [("d", dt.date(2024, 1, 1), 2), ("d", dt.date(2024, 3, 1), 1)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(*[st.one_of(st.none(), st.integers(0, 6).map(float))] * 2), min_size=3, max_size=40))
def test_spearman_matches_pandas(spark, data):
    df = spark.createDataFrame(data, "a double, b double")
    pair = pd.DataFrame(data, columns=list("ab"), dtype="float64").dropna()
    got = deep.spearman(df, ["a", "b"]).collect()
    if len(pair) == 0:
        assert got == []
        return
    want = pair.a.rank().corr(pair.b.rank()) if len(pair) > 1 else math.nan
    assert got[0].n == len(pair)
    if min(pair.a.nunique(), pair.b.nunique()) > 1:
        assert math.isclose(got[0]["corr"], want, abs_tol=1e-9)
    else:
        assert got[0]["corr"] is None


def test_spearman_with_a_hot_value(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(1)).alias("a"),
        F.when(F.col("id") % 3 == 1, 0.5).otherwise(F.rand(2) + F.col("id") / 9000).alias("b"),
    )
    want = df.toPandas().rank().corr().loc["a", "b"]
    got = deep.spearman(df, ["a", "b"]).first()
    assert math.isclose(got["corr"], want, abs_tol=1e-9) and got.n == 6000


def test_cramers_v(spark):
    same = spark.range(300).select((F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 3).alias("b"))
    assert math.isclose(deep.cramers_v(same, ["a", "b"]).first().v, 1.0, abs_tol=1e-9)
    free = spark.range(400).select((F.col("id") % 2).alias("a"), (F.floor(F.col("id") / 2) % 2).alias("b"))
    assert deep.cramers_v(free, ["a", "b"]).first().v == 0.0
    wide = spark.range(500).select("id", F.lit("k").alias("k"))
    only = deep.cramers_v(wide, ["id", "k"]).first()  # columns of many values take part, here without association
    assert (only.x, only.y, only.v, only.n) == ("id", "k", None, 500)
    assert deep.cramers_v(wide, ["id", "k"], max_values=100).count() == 0
    halves = spark.range(500).select("id", (F.col("id") % 2).alias("b"))
    assert deep.cramers_v(halves, ["id", "b"]).count() == 1


def test_interactions(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0), (10.0, None), (INF, 1.0)], "a double, b double")
    got = sorted((r.x_start, r.y_start, r.cnt) for r in deep.interactions(df, ["a", "b"], bins=2).collect())
    assert got == [(0.0, 0.0, 1), (5.0, 5.0, 1)]


def test_nullity(spark):
    data = [(None if i % 2 else 1, None if i % 2 else 1, 1 if i % 2 else None, 1) for i in range(10)]
    df = spark.createDataFrame(data, "a int, b int, c int, d int")
    got = {(r.x, r.y): r["corr"] for r in deep.nullity_correlation(df).collect()}
    assert math.isclose(got["a", "b"], 1.0) and math.isclose(got["a", "c"], -1.0) and ("a", "d") not in got
    assert {(r.missing_columns, r.n_missing, r.cnt) for r in deep.nullity_patterns(df).collect()} == {
        ("a,b", 2, 5), ("c", 1, 5)}


def test_duplicate_groups(spark, rows):
    long = "z" * 500
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (2, None), (2, None), (3, "q")], "i int, s string")
    assert rows(deep.duplicate_groups(df)) == [(1, long, 2), (2, None, 3)]
    assert rows(deep.duplicate_groups(df, k=1)) == [(2, None, 3)]
    assert rows(deep.duplicate_groups(df.select("i"))) == [(1, 2), (2, 3)]
    nested = spark.sql("select map('a', 1) m, array(1) a union all select map('a', 1), array(1)")
    assert deep.duplicate_groups(nested).first().n_duplicates == 2


def test_samples(spark):
    got = deep.samples(spark.range(30), ["id"], k=2).collect()
    assert sorted((r.part, r.id) for r in got) == [("head", 0), ("head", 1), ("tail", 28), ("tail", 29)]


def test_alerts(spark):
    df = spark.range(200).select(
        F.col("id").alias("u"), F.lit(1).alias("k"), (F.col("id") * 2.0).alias("twice"),
        F.when(F.col("id") % 2 == 0, F.lit(1.0)).alias("m"),
        F.when(F.col("id") < 100, F.lit(0.0)).otherwise(F.col("id")).alias("z"),
        F.when(F.col("id") == 0, F.lit(INF)).otherwise(F.col("id")).alias("i"),
        F.concat(F.lit("v"), F.col("id")).alias("t"),
        F.when(F.col("id") < 195, "a").otherwise("b").alias("c"),
    )
    got = {(r.column, r.alert) for r in deep.alerts(df).collect()}
    assert {("u", "unique"), ("k", "constant"), ("m", "missing"), ("z", "zeros"), ("i", "infinite"),
            ("t", "high_cardinality"), ("c", "imbalance"), ("twice,u", "high_correlation")} <= got
    assert not any(a == "duplicates" for _, a in got)
    few = deep.alerts(df.select("m").limit(10)).collect()
    assert any(r.alert == "duplicates" for r in few)
    assert deep.alerts(df, {"missing": 0.9}).filter("alert = 'missing'").count() == 0


@pytest.mark.parametrize("schema", ["a int", "s string", "a array<int>", "a int, b double, s string, d date"])
def test_whole_profile_of_an_empty_table(spark, schema):
    for table in deep.deep_profile(spark.createDataFrame([], schema)).values():
        table.collect()


def test_whole_profile(spark):
    data = [(i, float(i % 7), f"http://h/{i % 5}", "ab"[i % 2], "xy"[i % 2], dt.datetime(2024, 1, 1)) for i in range(50)]
    df = spark.createDataFrame(data, "i int, v double, u string, c string, e string, t timestamp_ntz")
    tables = deep.deep_profile(df, ["i"])
    assert {"overview", "numeric", "spearman", "cramers_v", "url_parts", "samples", "datetime_range"} <= set(tables)
    assert all(t.count() >= 0 for t in tables.values())


def test_no_matching_columns_give_empty_tables(spark):
    df = spark.range(3)
    assert deep.datetime_range(df).collect() == [] and deep.datetime_histogram(df).collect() == []
    assert deep.url_parts(df, []).collect() == []


def test_text_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-03-01",), ("2024-03-09",), ("2024-03-09",), (None,)], "d string")
    r = deep.datetime_range(df, ["d"]).first()
    assert (r["count"], str(r["min"])[:10], r.range_days) == (4, "2024-01-01", 68.0)
    assert {(str(x.start), x.cnt) for x in deep.datetime_histogram(df, ["d"]).collect()} == {("2024-01-01", 1), ("2024-03-01", 3)}


def test_duplicate_groups_with_text_and_map(spark):
    data = [("x" * 100, {"a": 1, "b": 2})] * 3 + [("y", {"b": 2, "a": 1})] * 2 + [("z", None)]
    df = spark.createDataFrame(data, "t string, m map<string,int>")
    got = [(r.t[0], r.m, r.n_duplicates) for r in deep.duplicate_groups(df).collect()]
    assert sorted(got, key=repr) == sorted([("x", {"a": 1, "b": 2}, 3), ("y", {"a": 1, "b": 2}, 2)], key=repr)
