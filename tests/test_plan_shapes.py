"""What the physical plans must and must not contain."""

import uuid

import pytest
from pyspark.sql import functions as F

from catalog.inputs import lineitem_nulls, table
from insight_spark.operators import categorical, deep, numeric, profile, timeseries
from insight_spark.operators.frequency import top_values
from insight_spark.plans import packs

SF = "/root/testdata/sf0.001"


def plan_of(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def _daily(line):
    return timeseries.daily_mean(line, "l_shipdate", ["l_quantity"])


FLAGS = ["l_returnflag", "l_linestatus"]
OPERATORS = {
    "schema_profile": profile.schema_profile,
    "roles": profile.column_roles,
    "missing_top": profile.missing_top,
    "duplicate_rows": profile.duplicate_rows,
    "distribution": lambda df: categorical.categorical_distribution(df, FLAGS),
    "histogram": lambda df: numeric.numeric_histogram(df, ["l_quantity"]),
    "daily": _daily,
    "trend": lambda df: timeseries.trend_first_last(_daily(df), "l_quantity"),
    "overview": deep.overview,
    "extremes": lambda df: deep.extreme_values(df, ["l_quantity"]),
    "cramers_v": lambda df: deep.cramers_v(df, FLAGS),
    "duplicate_groups": lambda df: deep.duplicate_groups(df.select(*FLAGS)),
    "spearman": lambda df: deep.spearman(df, ["l_quantity", "l_tax"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(OPERATORS[name](lineitem_nulls(spark, SF)))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan


def test_frequency_table_is_shuffled_once(spark):
    plan = plan_of(top_values(table(spark, SF, "lineitem"), ["l_returnflag", "l_linestatus"], 10))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_schema_profile_reads_each_column_once(spark):
    plan = plan_of(profile.schema_profile(table(spark, SF, "orders")))
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    columns = [c for line in scans for c in line.split("[")[1].split("]")[0].split(",")]
    assert len(columns) == len(set(columns)) == 6


def test_only_needed_columns_are_read(spark):
    plan = plan_of(numeric.numeric_basic_stats(table(spark, SF, "lineitem"), ["l_quantity", "l_tax"]))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


@pytest.mark.parametrize("name", ["schema_profile", "duplicate_rows", "daily", "histogram"])
def test_counting_folds_before_the_shuffle(spark, name):
    assert "partial_" in plan_of(OPERATORS[name](lineitem_nulls(spark, SF)))


@pytest.mark.parametrize("columns", [["o_orderstatus"], ["o_orderstatus", "o_orderpriority"]])
def test_top_values_are_limited_before_the_shuffle(spark, columns):
    plan = plan_of(top_values(table(spark, SF, "orders"), columns, 10))
    assert "WindowGroupLimit" in plan or "TakeOrderedAndProject" in plan


def test_short_values_skip_the_text_lookup(spark):
    plan = plan_of(top_values(table(spark, SF, "orders"), ["o_orderstatus", "o_orderpriority"], 10))
    assert "BroadcastHashJoin" not in plan


def test_pair_statistics_take_as_many_scans_for_any_number_of_columns(spark):
    line = lineitem_nulls(spark, SF)
    base = ["l_tax", "l_discount", "l_quantity"]
    jobs = set()
    for n in (6, 12, 18):
        cols = [(F.col(base[i % 3]) + (i // 3) * F.col("l_linenumber")).alias(f"c{i}") for i in range(n)]
        wide = line.select(*cols)
        moments = numeric.column_moments(wide, wide.columns)  # reads each column once
        pairs = numeric.matrix_pairs(wide.columns)
        jobs.add((
            jobs_of(spark, lambda: numeric.pair_correlations(wide, pairs, moments)),
            jobs_of(spark, lambda: deep.nullity_correlation(wide)),
        ))
    assert len(jobs) == 1


def jobs_of(spark, run):
    """Number of Spark jobs that a call starts."""
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_spearman_folds_before_a_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(deep, "BROADCAST_VALUES", 0)
    found = deep.spearman(lineitem_nulls(spark, SF), ["l_orderkey", "l_extendedprice", "l_tax"])
    plan = plan_of(found)
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan
    assert plan.count("partial_count(1)") >= 1


def test_the_plan_reads_and_shuffles_no_numeric_column(spark):
    for name in ("lineitem", "orders"):
        plan = plan_of(packs.analysis_plan(profile.kind_roles(table(spark, SF, name))))
        read = ",".join(line.split("ReadSchema: ")[1] for line in plan.splitlines() if "ReadSchema: " in line)
        assert "string" in read and "bigint" not in read and "double" not in read
        assert "hashpartitioning" not in plan and "rangepartitioning" not in plan
