"""Bounded extremes against sorted distinct values."""

import math
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from insight_spark.operators import deep, extremes


def expected(values, k):
    counts = Counter(v for v in values if v is not None and v == v)
    order = sorted(counts)
    return {("smallest", i + 1): (v, counts[v]) for i, v in enumerate(order[:k])} | {
        ("largest", i + 1): (v, counts[v]) for i, v in enumerate(order[::-1][:k])}


def columns():
    rng = random.Random(3)
    n = 5000
    big = 2**60
    return {
        "l": ("bigint", [rng.choice([None, big + rng.randint(0, 3000), big + 3000]) for _ in range(n)]),  # the largest is hot
        "s": ("smallint", [rng.randint(-5, 5) for _ in range(n)]),
        "d": ("decimal(30,3)", [None if rng.random() < 0.2 else Decimal(rng.randint(-10**25, 10**25)).scaleb(-3) for _ in range(n)]),
        "f": ("double", [rng.choice([0.0, -0.0, math.inf, -math.inf, math.nan, rng.random(), None]) for _ in range(n)]),
        "e": ("double", [None] * n),
    }


@pytest.mark.parametrize("k", [1, 2, 7])
def test_extremes_equal_sorted_values(spark, k):
    table = columns()
    df = spark.createDataFrame(list(zip(*(v for _, v in table.values()))), ", ".join(f"{c} {t}" for c, (t, _) in table.items()))
    got = deep.extreme_values(df.repartition(6), k=k).collect()
    for name, (kind, values) in table.items():
        want = expected([v + 0.0 if isinstance(v, float) else v for v in values], k)
        mine = {(r.side, r["rank"]): r for r in got if r.column == name}
        assert set(mine) == set(want), name
        for key, (value, cnt) in want.items():
            assert (mine[key].value, mine[key].cnt) == (float(value), cnt), (name, key)
            if kind == "double":
                assert mine[key].exact is None
            else:
                assert Decimal(mine[key].exact) == Decimal(value)


def test_tasks_send_no_more_than_their_edges(spark):
    df = spark.range(0, 100_000, 1, 5).select(F.col("id").alias("e0"), (F.col("id") % 3).alias("e1"))
    k = 4
    sent = extremes.task_edges(df, k)
    assert sent.count() <= 2 * k * 5 * 2
    assert sent.filter("i = 1").count() == 2 * 3 * 5
    counted = extremes.edge_counts(df, k)
    assert sorted((r.i, r.value, r.cnt) for r in counted.collect())[:4] == [(0, 0, 1), (0, 1, 1), (0, 2, 1), (0, 3, 1)]
    assert counted.filter("i = 0").count() == 2 * k
    counted.collect()
    plan = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "partial_count(1)" in plan and "MapInArrow" not in plan  # beyond the bounds nothing is shuffled


def test_no_values(spark):
    df = spark.createDataFrame([], "x bigint, y double")
    assert deep.extreme_values(df).collect() == []
