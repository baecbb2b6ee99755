import datetime as dt

import pytest
from pyspark.sql import functions as F

from insight_spark.operators import categorical, compare
from insight_spark.plans import charts, insights, packs, report

DAY = dt.datetime(2024, 1, 1)


def profile_of(spark, data, schema, name="d"):
    return packs.table_profile(spark.createDataFrame(data, schema), name)


# --- categorical --------------------------------------------------------------


def test_pct_sums_to_100_over_the_ten_kept(spark):
    values = [(f"v{i:02d}",) for i in range(12) for _ in range(12 - i)]
    df = spark.createDataFrame(values, "c string")
    got = categorical.categorical_distribution(df, ["c"]).collect()
    assert len(got) == 10 and abs(sum(r.pct for r in got) - 100) < 1e-9
    assert abs(sum(r.pct_of_non_null for r in got) - 100 * 75 / 78) < 1e-9


def test_chart_columns_skip_identifiers(spark, rows):
    df = spark.range(50).select(
        F.col("id").cast("string").alias("a"), *[F.lit("k").alias(c) for c in "bcd"]
    )
    cols = list("abcd")
    assert {r.column for r in categorical.categorical_chart_columns(df, cols).collect()} == {"b", "c", "d"}
    assert [r.column for r in categorical.categorical_chart_columns(df, cols, 2).collect()] == ["b", "c"]
    assert {r.column for r in categorical.categorical_distribution(df, cols).collect()} == {"b", "c", "d"}
    assert {r.column for r in categorical.categorical_distribution(df, cols, charts=2).collect()} == {"b", "c"}
    assert [r.evidence for r in categorical.categorical_id_insights(df, cols).collect()] == ["Unique ratio ≈ 50/50"]
    s = categorical.categorical_summary(df, cols).first()
    assert (s.n_cols, s.cols_used, s.n_charts) == (4, cols, 3)
    assert categorical.categorical_summary(df, cols, charts=2).first().n_charts == 2
    assert categorical.categorical_notes(df, cols).count() == 0


def test_all_columns_and_missing_ones_ignored(spark):
    df = spark.createDataFrame([tuple("x" * 10)], [f"c{i}" for i in range(10)])
    got = categorical.categorical_top(df, ["nope", *df.columns])
    assert {r.column for r in got.collect()} == {f"c{i}" for i in range(10)}


def test_column_without_values(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x")], "a string, b string")
    got = {(r.column, r.n_unique, r.value, r.cnt) for r in categorical.categorical_top(df, ["a", "b"]).collect()}
    assert got == {("a", 0, None, None), ("b", 1, "x", 2)}


def test_no_categorical_columns(spark):
    df = spark.range(3)
    tables = categorical.categorical(df, [])
    assert tables["skip"].first().skipped == "No categorical columns."
    assert tables["notes"].first().title == "No categorical columns"


# --- plan and packs -------------------------------------------------------------


@pytest.mark.parametrize(
    ("schema", "steps", "kind"),
    [
        ("a int", ["snapshot", "numeric"], "tabular"),
        ("s string", ["snapshot", "categorical"], "tabular"),
        ("t timestamp, a int", ["snapshot", "timeseries", "numeric"], "timeseries"),
        ("t timestamp, a int, s string", ["snapshot", "categorical", "timeseries", "numeric"], "timeseries"),
        ("t timestamp", ["snapshot", "timeseries"], "unknown"),
        ("a array<int>", ["snapshot"], "unknown"),
    ],
)
def test_plan(spark, schema, steps, kind):
    profile = profile_of(spark, [], schema)
    plan = packs.analysis_plan(profile.roles).orderBy("step").collect()
    assert [r.pack for r in plan] == steps and [r.step for r in plan] == list(range(1, len(steps) + 1))
    assert {r.dataset_type for r in plan} == {kind}
    assert packs.planned_packs(profile) == steps


def test_run_log_reasons(spark, rows):
    profile = profile_of(spark, [(DAY,)], "t timestamp")
    log = packs.pack_run_log(profile, ["snapshot", "categorical", "timeseries", "numeric", "other"])
    assert {r.pack: r.detail for r in log.collect()} == {
        "snapshot": "No missing values.",
        "categorical": "No categorical columns.",
        "timeseries": "No datetime+numeric.",
        "numeric": "No numeric columns.",
        "other": "Unknown pack: other",
    }
    ids = profile_of(spark, [(i,) for i in range(30)], "a int")
    assert packs.skip_reason(ids, "numeric").startswith("No usable numeric columns")
    empty = profile_of(spark, [(None, 1)], "t timestamp, a int")
    assert packs.skip_reason(empty, "timeseries").startswith("Not enough datetime rows")


def test_failing_pack_does_not_stop_the_next(spark, rows):
    profile = profile_of(spark, [(DAY, 1, "x"), (DAY, None, "x")], "t timestamp, a int, s string")
    plan = [{"pack": "timeseries", "params": {"cols": ["s"]}}, {"pack": None}, {"pack": "snapshot"}]
    out = packs.run_packs(profile, plan)
    assert set(out) == {"snapshot", "run_log"}
    assert rows(packs.run_errors(out["run_log"])) == [("d", "pack_error[timeseries]: Column 's' is not numeric.")]
    assert rows(packs.skipped_reasons(out["run_log"])) == [("d", "timeseries: Error: Column 's' is not numeric.")]


def test_a_pack_that_fails_when_read_is_logged(spark, rows):
    """The table can be planned and profiled; one of its values cannot be read any more when the packs run."""
    good = spark.createDataFrame([(i % 7, f"c{i % 3}", None if i == 3 else 1) for i in range(50)], "a int, s string, b int")
    roles = packs.table_profile(good, "d").columns
    broken = good.withColumn("b", F.when(F.col("a") == 5, F.raise_error(F.lit("unreadable block")).cast("int")).otherwise(F.col("b")))
    out = packs.run_packs(packs.TableProfile("d", broken, roles))
    log = {r.pack: r for r in out["run_log"].collect()}
    assert set(out) == {"categorical", "run_log"}
    for pack in ("snapshot", "numeric"):
        assert log[pack].status == "skipped" and log[pack].rows is None and "unreadable block" in log[pack].detail
    assert (log["categorical"].status, log["categorical"].detail) == ("done", "OK")
    errors = [r.error for r in packs.run_errors(out["run_log"]).collect()]
    assert sorted(e[:20] for e in errors) == ["pack_error[numeric]:", "pack_error[snapshot]"]


def test_log_counts_what_was_written(spark, tmp_path):
    profile = profile_of(spark, [(DAY, 1.0 * i, "x") for i in range(5)], "t timestamp, a double, s string")
    out = packs.run_packs(profile, path=str(tmp_path / "run"))
    for r in out["run_log"].collect():
        tables = out[r.pack]
        assert (r.tables, r.rows) == (len(tables), sum(t.count() for t in tables.values()))
        assert all("FileScan" in t._jdf.queryExecution().executedPlan().toString() for t in tables.values() if t.columns)
    assert (tmp_path / "run").is_dir()


def test_tables_of_odd_types_are_written(spark):
    df = spark.sql("SELECT NULL AS nothing, make_interval(1, 2) AS span, map('a', 1) AS m, 1 AS i, 'x' AS `a b.c`")
    log = packs.run_packs(packs.TableProfile("d", df, packs.table_profile(df.drop("span", "nothing"), "d").columns))["run_log"]
    assert {r.pack: r.detail for r in log.collect()}["snapshot"] == "No missing values."


def test_run_packs_from_the_plan_table(spark):
    profile = profile_of(spark, [(DAY, 1.0 * i, "x") for i in range(5)], "t timestamp, a double, s string")
    out = packs.run_packs(profile, packs.analysis_plan(profile.roles))
    assert set(out) == {"snapshot", "categorical", "timeseries", "numeric", "run_log"}
    assert out["numeric"]["correlation_matrix"].count() == 1
    assert out["timeseries"]["daily"].count() == 1


# --- charts -----------------------------------------------------------------------


def raw_charts(spark):
    base = [("d", "p", i, f"c{i}", f"t{i}", 10 * i, ["x"], "bar", True) for i in range(1, 6)]
    odd = [
        ("d", "q", 6, None, "", None, None, "bar", True),
        ("d", "q", 7, "gone", "gone", 99, ["x"], "bar", False),
        ("d", "q", 8, None, None, 20, [], "bar", True),
    ]
    return spark.createDataFrame(base + odd, charts.CHART_SCHEMA)


def test_chart_defaults(spark):
    got = {r.seq: r for r in charts.charts_normalize(raw_charts(spark)).collect()}
    assert 7 not in got
    assert (got[6].id, got[6].title, got[6].priority, got[6].tags) == ("q_chart_1", "q", 50, ["q"])
    assert (got[8].id, got[8].tags) == ("q_chart_2", ["q"])


def test_legacy_chart(spark):
    raw = raw_charts(spark).withColumn("legacy", F.col("seq") == 1)
    got = charts.charts_normalize(raw).filter("seq = 1").first()
    assert (got.id, got.title, got.priority, got.tags) == ("p_vega", "p", 50, ["p"])


def test_chart_caps(spark):
    listed = charts.charts_normalize(raw_charts(spark))
    assert [r.seq for r in charts.charts_flatten(listed).orderBy("rank").collect()] == [5, 6, 4, 3, 2, 8, 1]
    assert sorted(r.seq for r in charts.charts_top_per_pack(listed).collect()) == [3, 4, 5, 6, 8]
    assert [r.seq for r in charts.charts_cap(listed, 3, 2).orderBy("rank").collect()] == [5, 6]


def test_chart_filters(spark):
    data = [("d", "snapshot", 1, "a", "a", 1, ["z"], "bar"), ("d", "timeseries", 2, "b", "b", 1, ["time"], "bar"),
            ("d", "numeric", 3, "c", "c", 1, ["quality"], "bar")]
    listed = spark.createDataFrame(data, "dataset string, pack string, seq int, id string, title string, "
                                         "priority int, tags array<string>, mark string")
    found = {t: sorted(r.seq for r in charts.charts_by_tag(listed, t).collect())
             for t in ("all", "quality", "time", "numeric", "categorical")}
    assert found == {"all": [1, 2, 3], "quality": [1, 3], "time": [2], "numeric": [3], "categorical": []}


def test_chart_entries_of_an_empty_table(spark):
    assert charts.chart_entries(profile_of(spark, [], "t timestamp, a int, s string")).filter("has_data").count() <= 1


# --- insights and report ----------------------------------------------------------


def hand_made(spark):
    data = [
        ("d", 1, "I1", "one", "text", "RISK", 0.295, "do"),
        ("d", 2, "I2", "two", None, None, None, "do"),
        ("d", 3, "I3", "three", "text", "bogus", 0.9, ""),
        ("d", 4, "I4", "four", "text", "Opportunity", 0.9, "other"),
    ]
    return spark.createDataFrame(data, "dataset string, seq int, id string, title string, description string, "
                                       "severity string, confidence double, recommended_action string")


def test_insight_order(spark):
    def order(mode):
        return [r.seq for r in insights.insights_rank(hand_made(spark), mode).orderBy("rank").collect()]

    assert order("confidence_desc") == [3, 4, 1, 2]
    assert order("confidence_asc") == [2, 1, 3, 4]
    assert order("severity") == [1, 4, 2, 3]
    got = [r.severity for r in insights.insights_normalize(hand_made(spark)).orderBy("seq").collect()]
    assert got == ["risk", "info", "info", "opportunity"]
    assert insights.insights_filter(hand_made(spark), "info").count() == 2
    assert insights.insights_filter(hand_made(spark)).count() == 4


def report_text(spark, notes, errors, found=None):
    overview = spark.createDataFrame(
        [("d", 5, 2, 1, 4, len(errors), "clean")],
        "dataset string, rows bigint, cols bigint, duplicate_rows bigint, insights bigint, errors bigint, status string",
    )
    lines = report.report_lines(
        overview,
        hand_made(spark) if found is None else found,
        spark.createDataFrame(notes, insights.NOTE_SCHEMA),
        spark.createDataFrame(errors, "dataset string, error string"),
        generated="now",
    )
    return [r.line for r in lines.orderBy("line_no").collect()]


def test_report_sections(spark):
    notes = [("d", 1, "Missing values detected", ["a", "b"], "low", "fix")]
    text = report_text(spark, notes, [("d", "boom")])
    heads = [x for x in text if x.startswith("#") and not x.startswith("###")]
    assert heads == ["# Analytics Report", "## Overview", "## Key Risks", "## Opportunities", "## Data Quality Notes",
                     "## Insights", "## Next Steps", "## Errors / Warnings"]
    assert "- Generated: now" in text and "- **Missing values detected** | Columns: a, b | Impact: low" in text
    assert text[text.index("## Key Risks") + 1] == "- one"
    assert text[text.index("## Opportunities") + 1] == "- four"
    at = text.index("### one")
    assert text[at : at + 6] == ["### one", "- Severity: **RISK**", "- Confidence: **29%**", "- Description: text",
                                 "- Action: do", ""]
    assert "- Confidence: **—**" in text and "- Description: —" in text
    assert [x for x in text if x in ("- do", "- other")] == ["- do", "- other"]
    assert text[-2:] == ["- boom", ""]


def test_report_of_nothing(spark):
    text = report_text(spark, [], [], hand_made(spark).limit(0))
    for head in ("## Key Risks", "## Opportunities", "## Data Quality Notes", "## Insights", "## Next Steps"):
        at = text.index(head)
        assert text[at + 1 : at + 3] == ["- —", ""]
    assert "## Errors / Warnings" not in text


def test_report_caps(spark):
    many = [("d", i, "issue", ["c"], "low", "fix") for i in range(1, 15)]
    errors = [("d", f"e{i:02d}") for i in range(40)]
    text = report_text(spark, many, errors)
    assert sum(x.startswith("- **issue**") for x in text) == 10
    assert sum(x.startswith("- e") for x in text) == 30


def test_insights_of_a_table(spark):
    data = [(DAY + dt.timedelta(days=i), float(i), "x", None if i % 2 else "y") for i in range(40)]
    profile = profile_of(spark, data, "t timestamp_ntz, v double, s string, m string")
    got = insights.insights_table(profile).orderBy("seq").collect()
    by_title = {r.title: r for r in got}
    assert by_title["'v' increased over the observed period"].evidence.source_pack == "timeseries"
    assert by_title["Column 'm' has missing values."].severity == "risk"
    assert by_title["One value dominates column 's'."].severity == "warning"
    assert [r.id for r in got] == [f"I{i}" for i in range(1, len(got) + 1)]
    notes = insights.data_quality_notes(profile).collect()
    assert [(n.columns, n.impact) for n in notes] == [(["m"], "high")]


def test_overview_status(spark):
    profile = profile_of(spark, [(1,), (1,)], "a int")
    none = spark.createDataFrame([], "dataset string, error string")
    found = spark.createDataFrame([("d",), ("other",)], "dataset string")
    errors = spark.createDataFrame([("d", "e"), ("d", "f")], "dataset string, error string")
    clean = insights.overview_metrics(profile, found, none).first()
    assert tuple(clean) == ("d", 2, 1, 1, 1, 0, "clean")
    assert insights.overview_metrics(profile, found, errors).first().status == "warnings: 2"


# --- compare -----------------------------------------------------------------------


def test_compare(spark, rows):
    a = spark.createDataFrame([(1, None), (1, None)], "x int, y int")
    b = spark.createDataFrame([(1,)], "z int")
    tables = compare.compare(a, b, "a", "b", insights=(2, 5))
    assert rows(tables["metrics"]) == [
        ("cols", 2, 1, -1), ("duplicate_rows", 1, 0, None), ("insights_count", 2, 5, 3), ("rows", 2, 1, -1),
    ]
    assert rows(tables["top_missing"]) == [(1, "y", 2, "z", 0), (2, "x", 0, None, None)]


def test_compare_counts_a_missing_side_as_zero(spark, rows):
    a = spark.createDataFrame([("rows", 3)], "metric string, value bigint")
    b = spark.createDataFrame([("rows", None), ("cols", 4)], "metric string, value bigint")
    assert rows(compare.compare_metrics(a, b)) == [("cols", None, 4, 4), ("rows", 3, None, -3)]
