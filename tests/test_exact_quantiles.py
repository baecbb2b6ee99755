"""Quantiles in their own type: digits that doubles lose, hot values, many rows a bracket, a fixed number of jobs."""

import random
import uuid
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from insight_spark.operators import numeric, quantiles

SCHEMA = "big bigint, tiny decimal(38,20), money decimal(20,2), hot bigint, small smallint, none bigint, flag boolean, x double"


def table(n=3000):
    rng = random.Random(12)
    base = Decimal("99999999999999999")
    return [(2**62 + rng.randint(0, 5000), base + Decimal(rng.randint(0, 10**6)).scaleb(-20), Decimal(rng.randint(-10**6, 10**6)).scaleb(-2),
             -(2**63) if rng.random() < 0.4 else 2**63 - 1, rng.randint(-3, 3), None, rng.random() < 0.5, rng.random()) for _ in range(n)]


def at(values, p):
    place = (len(values) - 1) * Fraction(str(p))
    low = place.numerator // place.denominator
    a, b = Fraction(values[low]), Fraction(values[min(low + 1, len(values) - 1)])
    return a + (b - a) * (place - low)


@pytest.mark.parametrize("plain_rows", [1 << 18, 10])
def test_exact_summary(spark, monkeypatch, plain_rows):
    monkeypatch.setattr(quantiles, "PICK_ROWS", plain_rows)
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    probs = (0.05, 0.25, 0.5, 0.999)
    got = {(r.column, r.statistic): r.exact for r in numeric.exact_summary(df, probs=probs).collect()}
    assert {c for c, _ in got} == {"big", "tiny", "money", "hot", "small", "none"}
    assert all(v is None for (c, _), v in got.items() if c == "none")
    for c in ("big", "tiny", "money", "hot", "small"):
        values = sorted(r[SCHEMA.split(", ").index(next(x for x in SCHEMA.split(", ") if x.startswith(c + " ")))] for r in rows)
        for name, p in zip(("min", "p5", "p25", "p50", "p99.9", "max"), (0, *probs, 1)):
            assert Fraction(got[c, name]) == at(values, p), (c, name)
        if c != "tiny":  # 38 digits leave no room for distances
            middle = at(values, 0.5)
            assert Fraction(got[c, "mad"]) == at(sorted(abs(Fraction(v) - middle) for v in values), 0.5), c
    assert got["big", "max"] == str(max(r[0] for r in rows))


def jobs_of(spark, run):
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_jobs_do_not_grow_with_rows_columns_or_ranks(spark):
    jobs = set()
    for n, width, probs in ((2000, 1, [0.5]), (200_000, 1, [0.1, 0.5, 0.9]), (50_000, 6, [0.05, 0.25, 0.5, 0.75, 0.95])):
        df = spark.range(n).select(*[((F.col("id") * 7919 + i) % 10007).alias(f"c{i}") for i in range(width)]).coalesce(2)
        cols = quantiles.typed_columns(numeric.numeric_fields(df))
        basics = quantiles.range_basics(df, [(p, c) for p, c, _ in cols])
        jobs.add(jobs_of(spark, lambda: quantiles.exact_quantiles(df, cols, probs, basics)))
    assert max(jobs) - min(jobs) <= 1  # adaptive execution may run a broadcast of its own


def test_a_missed_rank_is_found_in_a_wider_bracket(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 3)  # a poor sketch; its margin is wide, so spoil that too
    real = quantiles._sketched
    margins = []

    def narrow(df, numbers, ranks, margin):
        margins.append(margin)
        return real(df, numbers, ranks, 0.0 if len(margins) == 1 else margin)

    monkeypatch.setattr(quantiles, "_sketched", narrow)
    values = [random.Random(5).randint(0, 10**9) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(6)
    cols = quantiles.typed_columns(numeric.numeric_fields(df))
    probs = [0.1, 0.33, 0.5, 0.77]
    got = quantiles.exact_quantiles(df, cols, probs)[0]
    assert [Fraction(x) for x in got] == [at(sorted(values), p) for p in probs]


def test_written_out():
    assert [numeric.written_out(x) for x in (None, 0, 100, Decimal("1.500"), Decimal("0.00"), Decimal("1E+3"), -5)] == [
        None, "0", "100", "1.5", "0", "1000", "-5"]
