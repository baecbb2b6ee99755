"""Repeated rows: exact whatever the digests do, and only candidates are shuffled whole."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from insight_spark.operators import deep, duplicates, profile


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def wide_rows(n=400):
    rng = random.Random(8)
    text = lambda: "".join(rng.choices("ab", k=rng.choice([0, 1, 2, 70]))) if rng.random() < 0.9 else None
    rows = [(rng.choice([0.0, -0.0, 1.5, float("nan"), None]), text(), rng.choice([1, 2, None]),
             {"k": rng.randint(0, 1), "j": None} if rng.random() < 0.7 else None, [rng.randint(0, 1), None]) for _ in range(n)]
    return rows + rows[:50] + [rows[0]] * 300


SCHEMA = "x double, t string, i int, m map<string,int>, a array<int>"


def expected(rows):
    same = lambda v: None if v is None or v != v else v
    return Counter((same(x), t, i, None if m is None else tuple(sorted(m.items())), tuple(a)) for x, t, i, m, a in rows)


@pytest.mark.parametrize("weak", [None, "constant", "one_bit"])
def test_counts_are_exact_under_collisions(spark, monkeypatch, weak):
    """Planted collisions: all rows share a digest, or one of two."""
    def digest(df):
        text = F.col("t" if "t" in df.columns else "v1")
        value = F.lit(7).cast("bigint") if weak == "constant" else F.pmod(F.xxhash64(text), F.lit(2))
        return [value.alias("d1"), value.alias("d2")]

    if weak:
        monkeypatch.setattr(duplicates, "row_digest", digest)
    rows = wide_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    assert profile.duplicate_rows(df).first()[0] == len(rows) - len(want)
    groups = duplicates.repeated_groups(df).collect()
    assert sorted(r.cnt for r in groups) == sorted(n for n in want.values() if n > 1)
    assert [r.n_duplicates for r in deep.duplicate_groups(df, 3).collect()] == sorted(want.values(), reverse=True)[:3]


def test_a_filter_of_one_word_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "FILTER_WORDS", 1)
    rows = wide_rows()
    assert profile.duplicate_rows(spark.createDataFrame(rows, SCHEMA)).first()[0] == len(rows) - len(expected(rows))


def test_missing_values_are_told_apart_by_place(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    assert profile.duplicate_rows(df).first()[0] == 1
    assert df.select(*duplicates.row_digest(df)).distinct().count() == 2


@pytest.mark.parametrize("schema", ["x struct<m: map<string,int>>", "x array<map<string,int>>", "x map<string,map<string,int>>"])
def test_nested_maps(spark, schema):
    value = {"x struct<m: map<string,int>>": lambda m: (m,), "x array<map<string,int>>": lambda m: [m, None],
             "x map<string,map<string,int>>": lambda m: {"o": m, "p": None}}[schema]
    one, two = {"a": 1, "b": 2}, {"b": 2, "a": 1}
    df = spark.createDataFrame([(value(one),), (value(two),), (value({"a": 1}),), (None,)], schema)
    assert profile.duplicate_rows(df).first()[0] == 1


def test_first_shuffle_has_a_fixed_width(spark):
    """Whole rows are shuffled only behind the filter of repeated digests; nothing else than digests before it."""
    df = spark.createDataFrame([("x" * 500 + str(i), "y" * 300, i) for i in [*range(2000), 5]], "t string, u string, i long")
    counted = profile.duplicate_rows(df)
    plan = plan_of(counted)
    keys = [m for m in re.findall(r"hashpartitioning\(([^)]*)\)", plan) if not re.search(r"v\d", m)]
    assert any("d1" in k and "d2" in k for k in keys) and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert counted.first()[0] == 1


def test_tables_without_columns_or_rows(spark):
    assert profile.duplicate_rows(spark.createDataFrame([], SCHEMA)).first()[0] == 0
    assert deep.duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert profile.duplicate_rows(spark.range(3).select()).first()[0] == 2
