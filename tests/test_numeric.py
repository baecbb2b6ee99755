import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from insight_spark.operators import numeric, quantiles
from insight_spark.operators.hypotheses import verify_hypotheses

INF = float("inf")


def cells(df, cols, **kw):
    return {(r.x, r.y): r["corr"] for r in numeric.correlation_matrix(df, cols, **kw).collect()}


def test_constant_column_gives_zero(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "a double, b double")
    assert cells(df, ["a", "b"]) == {("a", "a"): 0.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 1.0}
    # a value whose sum rounds
    odd = spark.range(1000).select(F.lit(0.1).alias("a"), F.col("id").cast("double").alias("b"))
    assert cells(odd, ["a", "b"])["a", "b"] == 0.0


def test_pairwise_complete(spark):
    data = [(1.0, 1.0, 1.0), (2.0, 2.0, None), (None, 3.0, 3.0), (4.0, None, 9.0)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    assert all(math.isclose(v, 1.0) for v in cells(df, ["a", "b", "c"]).values())


def test_constant_only_within_a_pair(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 4.0), (7.0, None)], "a double, b double")
    assert cells(df, ["a", "b"])["a", "b"] == 0.0


def test_infinite_values_make_a_cell_undefined(spark):
    df = spark.createDataFrame([(1.0, 1.0), (INF, 2.0), (3.0, 5.0)], "a double, b double")
    assert cells(df, ["a", "b"])["a", "b"] == 0.0


def test_correlation_of_large_offsets(spark):
    df = spark.range(1000).select(
        (F.lit(1e9) + F.col("id") * 1e-3).alias("a"), (F.lit(-1e9) + F.col("id") * F.col("id") * 1e-3).alias("b")
    )
    want = df.toPandas().corr().loc["a", "b"]
    assert math.isclose(cells(df, ["a", "b"])["a", "b"], want, rel_tol=1e-6)


def test_wide_correlation_in_batches(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 14))
    data[rng.random(data.shape) < 0.2] = np.nan
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(14)])
    df = spark.createDataFrame([tuple(None if math.isnan(v) else float(v) for v in r) for r in data], list(pdf.columns))
    want, got = pdf.corr(), cells(df, list(pdf.columns))
    assert all(math.isclose(got[x, y], want.loc[x, y], abs_tol=1e-12) for x in pdf for y in pdf)


@pytest.mark.parametrize(
    ("low", "high", "start", "step", "bins"),
    [
        (1, 50, 0, 2, 25), (0, 100, 0, 5, 20), (0, 1, 0, 0.05, 20), (-10, 10, -10, 1, 20), (3, 3, 3, 0.1, 1),
        (900, 105000, 0, 5000, 21), (0, 0, 0, 0.05, 1), (0.3, 0.7, 0.3, 0.02, 20),
    ],
)
def test_nice_bins(low, high, start, step, bins):
    got = numeric.nice_bins(low, high)
    assert math.isclose(got[0], start, abs_tol=1e-9) and math.isclose(got[1], step) and got[2] == bins


def test_histogram_counts_every_finite_value(spark):
    df = spark.range(1, 51).select(F.col("id").cast("int").alias("v"))
    bins = numeric.numeric_histogram(df, ["v"]).orderBy("bin_start").collect()
    assert sum(b.cnt for b in bins) == 50
    assert len(bins) == 25 and {b.bin_end - b.bin_start for b in bins} == {2.0}
    assert bins[0].bin_start == 0.0 and bins[0].cnt == 1
    assert bins[-1].bin_end == 50.0 and bins[-1].cnt == 3
    with_inf = spark.createDataFrame([(1.0,), (2.0,), (INF,), (-INF,), (None,)], "v double")
    assert sum(b.cnt for b in numeric.numeric_histogram(with_inf, ["v"]).collect()) == 2
    assert numeric.numeric_histogram(spark.createDataFrame([], "v double"), ["v"]).count() == 0


def test_boolean_only_table(spark):
    df = spark.createDataFrame([(True,), (False,)], "f boolean")
    stats = numeric.numeric_basic_stats(df, ["f"]).first()
    assert (stats.mean, stats.min, stats.max) == (0.5, 0.0, 1.0)
    assert numeric.numeric_summary(df).first().p50 == 0.5


def test_summary_leaves_booleans_out(spark):
    df = spark.createDataFrame([(True, 1)], "f boolean, i int")
    assert [r.column for r in numeric.numeric_summary(df).collect()] == ["i"]


def test_sketch_summary(spark):
    df = spark.range(1, 102).select(F.col("id").cast("double").alias("v"))
    r = numeric.numeric_summary(df, exact=False).first()
    assert (r["count"], r.p50, r["min"], r["max"]) == (101, 51.0, 1.0, 101.0)


def test_pack_skips(spark, rows):
    df = spark.createDataFrame([("a",)], "s string")
    assert rows(numeric.numeric(df, [])["skip"]) == [("numeric", "No numeric columns.")]
    ids = spark.range(30)
    reason = "No usable numeric columns (numeric columns look like IDs)."
    assert rows(numeric.numeric(ids, ["id"], ["id"])["skip"]) == [("numeric", reason)]


def test_pack_tables(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("a"), (F.col("id") * 2.5).alias("b"))
    tables = numeric.numeric(df, ["a", "b"])
    assert tables["correlation_matrix"].count() == 4
    assert {r.column for r in tables["histogram"].select("column").distinct().collect()} == {"a", "b"}


def test_variance_rank_puts_undefined_last(spark):
    df = spark.createDataFrame([(1.0, 1.0, None), (2.0, INF, None)], "a double, b double, c double")
    assert [r.column for r in numeric.variance_rank(df, ["a", "b", "c"]).orderBy("rank").collect()] == ["a", "b", "c"]


# --- exact quantiles ---------------------------------------------------------

VALUES = st.one_of(
    st.none(),
    st.floats(allow_nan=False, allow_infinity=False, width=64),
    st.integers(-5, 5).map(float),
    st.sampled_from([INF, -INF, 0.0, -0.0, 1e-300, 1.7e308, -1.7e308, 5e-324]),
)


def quantile(values, p):
    """Linear interpolation between order statistics."""
    s = sorted(values)
    at = (len(s) - 1) * p
    a, b = s[math.floor(at)], s[math.ceil(at)]
    part = at - math.floor(at)
    return a if part == 0 or a == b else a + (b - a) * part


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(VALUES, min_size=1, max_size=60))
def test_quantiles_match_sorting(spark, monkeypatch, values):
    # tiny limits make few values take the many-pass path
    monkeypatch.setattr(quantiles, "BINS", 4)
    monkeypatch.setattr(quantiles, "PICK_ROWS", 2)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
    got = quantiles.exact_quantiles(df, [(0, F.col("v"))], probs)[0]
    kept = [v for v in values if v is not None]
    want = [quantile(kept, p) if kept else None for p in probs]
    for g, w in zip(got, want):
        assert g == w or (math.isnan(g) and math.isnan(w)) or math.isclose(g, w, rel_tol=1e-12)


def test_quantiles_with_a_hot_value(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(1) * 1e6).alias("v"))
    want = df.toPandas().v.quantile([0.1, 0.25, 0.5, 0.9]).tolist()
    got = quantiles.exact_quantiles(df, [(0, F.col("v"))], [0.1, 0.25, 0.5, 0.9])[0]
    assert np.allclose(got, want, rtol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = quantiles.exact_quantiles(df, [(0, F.col("a")), (1, F.col("b"))], [0.5])
    assert got == {0: [None], 1: [1.0]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(
        st.tuples(*[st.one_of(st.none(), st.floats(-1e3, 1e3), st.integers(0, 2).map(float))] * 3),
        min_size=2,
        max_size=40,
    )
)
def test_summary_and_correlation_match_pandas(spark, data):
    df = spark.createDataFrame(data, "a double, b double, c double")
    pdf = pd.DataFrame(data, columns=list("abc"), dtype="float64")
    want = pdf.describe()
    for r in numeric.numeric_summary(df).collect():
        w = want[r.column]
        assert r["count"] == w["count"]
        for got, name in ((r.mean, "mean"), (r.std, "std"), (r["min"], "min"), (r.p25, "25%"), (r.p50, "50%"),
                          (r.p75, "75%"), (r["max"], "max")):
            assert (got is None and math.isnan(w[name])) or math.isclose(got, w[name], rel_tol=1e-9, abs_tol=1e-9)
    corr = pdf.corr()
    for (x, y), got in cells(df, list("abc"), undefined=None).items():
        w = corr.loc[x, y]
        pair = pdf[[x, y]].dropna() if x != y else pdf[[x]].dropna()
        spread = min((pair[c].max() - pair[c].min() for c in pair), default=0) if len(pair) > 1 else 0
        if spread > 1e-6:  # pandas itself is noise below
            assert math.isclose(got, w, rel_tol=1e-6, abs_tol=1e-6)


# --- hypotheses ---------------------------------------------------------------


def test_correlation_needs_ten_pairs(spark):
    def check(n):
        df = spark.range(n).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
        return verify_hypotheses(df, [{"kind": "correlation", "x": "x", "y": "y"}]).first()

    assert not check(9).verified and check(9).n is None
    assert check(10).verified and check(10).n == 10 and math.isclose(check(10).pearson_corr, 1.0)


def test_mixed_hypotheses(spark):
    df = spark.range(12).select(
        F.col("id").cast("double").alias("v"), F.lit("k").alias("s"), F.lit(None).cast("string").alias("e"),
        F.lit(3.0).alias("c"),
    )
    hyps = [
        {"kind": "missingness", "col": "e"},
        {"kind": "missingness", "col": "nope"},
        {"kind": "category_dominance", "col": "s"},
        {"kind": "category_dominance", "col": "e"},
        {"kind": "correlation", "x": "v", "y": "s"},
        {"kind": "correlation", "x": "v", "y": "c"},
        {"kind": "correlation", "x": "v", "y": "nope"},
        {"kind": "other", "col": "s"},
        {"kind": None},
        {"kind": "category_dominance", "col": "v"},
        {"kind": "missingness", "col": "v"},
        {"kind": "missingness", "col": "v"},
    ]
    got = verify_hypotheses(df, hyps).orderBy("hyp_id").collect()
    assert len(got) == 12 and verify_hypotheses(df, hyps, k=10).count() == 10
    assert [r.verified for r in got] == [True, False, True, False, False, True, False, False, False, True, True, True]
    assert got[0].missing_rate == 1.0
    assert (got[2].top_value, got[2].top_share) == ("k", 1.0)
    assert got[4].verify_error == "Column 's' is not numeric."
    assert got[5].pearson_corr is None and got[5].n == 12
    assert math.isclose(got[9].top_share, 1 / 12)


def test_hypotheses_from_a_table(spark):
    df = spark.range(3).toDF("a")
    hyps = spark.createDataFrame([(2, "missingness", "a"), (1, "missingness", "b")], "hyp_id int, kind string, col string")
    got = verify_hypotheses(df, hyps).orderBy("hyp_id").collect()
    assert [(r.hyp_id, r.verified) for r in got] == [(1, False), (2, True)]
