"""Blocked sums of products against pairwise-complete statistics of numpy."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from insight_spark.functions.columns import col
from insight_spark.operators import gram, numeric


def frame():
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(size=(n, 9)) * [1, 1e6, 1e-9, 1, 1, 1, 1, 1e200, 1] + [0, 1e9, 0, 5, 0, 0, 0, 0, 7]
    x[:, 3] += 2 * x[:, 0]
    x[rng.random((n, 9)) < 0.3] = np.nan
    x[:, 4] = np.where(np.isnan(x[:, 0]), x[:, 4], 3.0)  # constant wherever column 0 has a value
    x[:, 5] = np.nan  # no values at all
    x[5, 6] = np.inf
    x[:, 8] = 7.0  # constant
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(9)])


@pytest.fixture(scope="module")
def spark_frame(spark):
    data = frame()
    rows = [tuple(None if v != v else v for v in r) for r in data.to_numpy().tolist()]
    schema = ", ".join(f"{c} double" for c in data.columns)
    return data, spark.createDataFrame(rows, schema).repartition(7)


@pytest.mark.parametrize("block", [2, 64])
def test_correlations_equal_numpy(spark_frame, monkeypatch, block):
    data, df = spark_frame
    monkeypatch.setattr(numeric, "gram_sums", lambda *a: gram.gram_sums(*a, block=block))
    found = numeric.pair_correlations(df, numeric.matrix_pairs(df.columns))
    for (x, y), (corr, n) in found.items():
        both = data[[x, y]].dropna().to_numpy()
        assert n == len(both), (x, y)
        a, b = both[:, 0], both[:, -1]
        if n < 2 or np.isinf(both).any() or np.ptp(a) == 0 or np.ptp(b) == 0:
            assert corr is None, (x, y)
        elif x == y:
            assert corr == 1.0
        else:
            want = np.corrcoef(a / np.abs(a).max(), b / np.abs(b).max())[0, 1]
            assert corr == pytest.approx(want, abs=1e-9), (x, y)


def test_only_wanted_blocks_are_multiplied():
    assert gram.block_pairs([3, 5, 9, 11], [(3, 11), (5, 3)], 2) == [(0, 0), (0, 1)]
    assert gram.block_pairs(list(range(10)), list(combinations(range(10), 2)), 5) == [(0, 0), (0, 1), (1, 1)]


def test_sums_of_a_pair(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (None, 4.0), (5.0, math.inf), (-1.0, 0.5)], "x double, y double")
    sums = gram.gram_sums(df, {0: col("x"), 1: col("y")}, [(0, 1)], {0: (0.0, 1.0), 1: (0.0, 2.0)})[0, 1]
    assert sums["n"] == 3 and sums["infinite"] == 1
    assert (sums["sx"], sums["sy"], sums["xy"]) == (5.0, 1.25, 1.0 - 0.25)  # the infinite value counts as 0
    assert (sums["lox"], sums["hix"]) == (-1.0, 5.0)


def test_no_rows(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert numeric.pair_correlations(df, [("x", "y")]) == {("x", "y"): (None, 0)}


def test_no_row_per_pair(spark, monkeypatch):
    """The rows of a table are never multiplied by pairs of columns."""
    seen = []
    df = spark.createDataFrame([(float(i), None if i % 3 else 1.0 * i, 2.0 * i) for i in range(50)], "a double, b double, c double")
    kind = type(df)
    monkeypatch.setattr(kind, "collect", lambda self, f=kind.collect: (
        seen.append(self._jdf.queryExecution().optimizedPlan().toString()), f(self))[1])
    numeric.pair_correlations(df, numeric.matrix_pairs(df.columns))
    sums = [p for p in seen if "MapInArrow" in p]
    assert len(sums) == 1 and "Generate" not in sums[0]
