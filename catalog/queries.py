"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.inputs import (
    DATASETS,
    events_gaps,
    lineitem_const,
    lineitem_dups,
    lineitem_nulls,
    orders_nulls,
    orders_strdate,
    table,
)
from insight_spark.functions.columns import normalize_missing
from insight_spark.operators import categorical as cat
from insight_spark.operators import compare as cmp
from insight_spark.operators import deep, hypotheses, numeric, profile
from insight_spark.operators import frequency as freq
from insight_spark.operators import timeseries as ts
from insight_spark.plans import charts, insights, packs, report
from insight_spark.sources import load, sinks
from insight_spark.sources.scratch import scratch_dir

NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS_AND_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", *NUMBERS]
ORDER_TEXT = ["o_orderstatus", "o_orderpriority"]
CUSTOMER_TEXT = ["c_name", "c_mktsegment"]


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- profile ----------------------------------------------------------------


def schema_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile.schema_profile(lineitem_nulls(spark, sf))


def missing_by_column(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_by_column(lineitem_nulls(spark, sf))


def missing_top20(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.missing_top(lineitem_nulls(spark, sf)), "percent")


def missing_total(spark: SparkSession, sf: str) -> DataFrame:
    return profile.missing_total(lineitem_nulls(spark, sf))


def shape(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shape(lineitem_nulls(spark, sf))


def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.duplicate_rows(lineitem_dups(spark, sf))


def duplicate_rows_text(spark: SparkSession, sf: str) -> DataFrame:
    return profile.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


def n_unique(spark: SparkSession, sf: str) -> DataFrame:
    return freq.n_unique(table(spark, sf, "lineitem"))


def n_unique_text(spark: SparkSession, sf: str) -> DataFrame:
    return freq.n_unique(table(spark, sf, "documents"))


def n_unique_approx(spark: SparkSession, sf: str) -> DataFrame:
    return freq.n_unique(table(spark, sf, "lineitem"), approx=True)


def value_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return freq.value_frequencies(orders_nulls(spark, sf), ORDER_TEXT).select("column", "value", "cnt")


def column_roles(spark: SparkSession, sf: str) -> DataFrame:
    roles = profile.column_roles(lineitem_nulls(spark, sf))
    return roles.select("column", "position", "dtype", "numeric", "categorical", "datetime", "id_like")


def datetime_roles(spark: SparkSession, sf: str) -> DataFrame:
    return profile.datetime_roles(orders_strdate(spark, sf))


def datetime_roles_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Roles by the first 50 values of each column, in order of the key."""
    return profile.datetime_roles(orders_strdate(spark, sf), probe=50, order_by=["o_orderkey"])


def id_like_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile.id_like_columns(table(spark, sf, "customer"))


def id_like_categorical(spark: SparkSession, sf: str) -> DataFrame:
    return profile.id_like_categorical(table(spark, sf, "region"))


def dataset_type(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name, make in DATASETS.items():
        kind = profile.dataset_type(profile.kind_roles(make(spark, sf)))
        parts.append(kind.select(F.lit(name).alias("dataset"), "dataset_type"))
    return reduce(DataFrame.unionByName, parts)


def top_categoricals(spark: SparkSession, sf: str) -> DataFrame:
    return profile.top_categoricals(orders_nulls(spark, sf), ORDER_TEXT)


def numeric_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = numeric.numeric_summary(lineitem_nulls(spark, sf))
    return rounded(out, "mean", "std", "min", "p25", "p50", "p75", "max", digits=4)


def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return profile.sample_rows(table(spark, sf, "orders"), 5, ["o_orderkey"])


def snapshot_skip(spark: SparkSession, sf: str) -> DataFrame:
    return profile.snapshot_skip(table(spark, sf, "lineitem"))


# --- categorical ------------------------------------------------------------


def categorical_top10(spark: SparkSession, sf: str) -> DataFrame:
    return cat.categorical_top(orders_nulls(spark, sf), ORDER_TEXT)


def categorical_id_insights(spark: SparkSession, sf: str) -> DataFrame:
    return cat.categorical_id_insights(table(spark, sf, "customer"), CUSTOMER_TEXT)


def categorical_chart_columns(spark: SparkSession, sf: str) -> DataFrame:
    return cat.categorical_chart_columns(table(spark, sf, "customer"), CUSTOMER_TEXT).select("column")


def categorical_distribution(spark: SparkSession, sf: str) -> DataFrame:
    out = cat.categorical_distribution(orders_nulls(spark, sf), ORDER_TEXT)
    return rounded(out, "pct", "pct_of_non_null")


def categorical_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = cat.categorical_summary(table(spark, sf, "customer"), CUSTOMER_TEXT)
    return out.select("n_cols", F.concat_ws(",", "cols_used").alias("cols_used"), "n_charts")


def categorical_notes(spark: SparkSession, sf: str) -> DataFrame:
    return cat.categorical_notes(table(spark, sf, "region"), ["r_name"])


# --- numeric ----------------------------------------------------------------


def numeric_usable_columns(spark: SparkSession, sf: str) -> DataFrame:
    return numeric.numeric_usable_columns(profile.column_roles(table(spark, sf, "lineitem")))


def numeric_basic_stats(spark: SparkSession, sf: str) -> DataFrame:
    return numeric.numeric_basic_stats(lineitem_nulls(spark, sf), KEYS_AND_NUMBERS)


def corr_columns(spark: SparkSession, sf: str) -> DataFrame:
    return numeric.corr_columns(lineitem_nulls(spark, sf), KEYS_AND_NUMBERS)


def variance_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(numeric.variance_rank(lineitem_nulls(spark, sf), NUMBERS), "variance", digits=3)


def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = numeric.correlation_matrix(lineitem_const(spark, sf), [*NUMBERS, "k"])
    return rounded(out, "corr", digits=8)


def numeric_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return numeric.numeric_histogram(table(spark, sf, "lineitem"), ["l_quantity"])


def sample_rows_n(spark: SparkSession, sf: str) -> DataFrame:
    """How many different rows a sample of 500 holds."""
    sample = numeric.sample_rows_n(table(spark, sf, "orders"), 500)
    return sample.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("n_keys"))


# --- hypotheses -------------------------------------------------------------


def hyp_missingness(spark: SparkSession, sf: str) -> DataFrame:
    out = hypotheses.hyp_missingness(lineitem_nulls(spark, sf), ["l_tax", "l_returnflag", "l_quantity"])
    return rounded(out, "missing_rate")


def hyp_category_dominance(spark: SparkSession, sf: str) -> DataFrame:
    out = hypotheses.hyp_category_dominance(lineitem_nulls(spark, sf), ["l_returnflag", "l_linestatus"])
    return rounded(out, "top_share")


def hyp_correlation(spark: SparkSession, sf: str) -> DataFrame:
    pairs = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
    return rounded(hypotheses.hyp_correlation(lineitem_nulls(spark, sf), pairs), "pearson_corr", digits=8)


def verify_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    hyps = [
        {"kind": "missingness", "statement": "tax is incomplete", "col": "l_tax"},
        {"kind": "missingness", "statement": "no such column", "col": "l_nothing"},
        {"kind": "category_dominance", "statement": "one flag dominates", "col": "l_returnflag"},
        {"kind": "correlation", "statement": "quantity moves price", "x": "l_quantity", "y": "l_extendedprice"},
        {"kind": "correlation", "statement": "flag against tax", "x": "l_returnflag", "y": "l_tax"},
        {"kind": "seasonality", "statement": "unknown kind", "col": "l_shipdate"},
    ]
    out = hypotheses.verify_hypotheses(lineitem_nulls(spark, sf), hyps)
    out = rounded(out, "missing_rate", "top_share", digits=6)
    return rounded(out, "pearson_corr", digits=8)


def hypothesis_candidates(spark: SparkSession, sf: str) -> DataFrame:
    df = lineitem_nulls(spark, sf)
    return hypotheses.hypothesis_candidates(df, profile.column_roles(df))


def hypotheses_from_json(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates written as one JSON array and read back."""
    df = lineitem_nulls(spark, sf)
    found = hypotheses.hypothesis_candidates(df, profile.column_roles(df))
    item = F.struct("hyp_id", "kind", "statement", "col", "x", "y")
    texts = found.agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))  # one item per candidate
    return hypotheses.hypotheses_from_json(texts)


# --- time series ------------------------------------------------------------


def ts_valid_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ts.ts_valid_rows(orders_strdate(spark, sf), "o_orderdate").select(
        "o_orderkey", F.to_date("o_orderdate").alias("day")
    )


def ts_points(spark: SparkSession, sf: str) -> DataFrame:
    return ts.ts_points(orders_strdate(spark, sf), "o_orderdate")


def _event_days(spark: SparkSession, sf: str) -> DataFrame:
    return ts.daily_mean(events_gaps(spark, sf), "ts", ["value"])


def daily_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_event_days(spark, sf), "value")


def daily_mean_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates as instants with offsets: 23:00 five hours west of UTC is the next day there, 04:00 at UTC is not."""
    day, odd = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 2 == 1
    at = F.concat(day, F.when(odd, "T23:00:00-05:00").otherwise("T04:00:00+00:00")).alias("at")
    return rounded(ts.daily_mean(table(spark, sf, "orders").select(at, "o_totalprice"), "at", ["o_totalprice"]), "o_totalprice")


def daily_mean_by_key(spark: SparkSession, sf: str) -> DataFrame:
    out = ts.daily_mean(events_gaps(spark, sf), "ts", ["value"], keys=["event_type"])
    return rounded(out, "value")


def daily_head(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ts.daily_head(_event_days(spark, sf)), "value")


def _event_days_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return ts.daily_mean(events_gaps(spark, sf), "ts", ["value"], keys=["event_type"])


def daily_head_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ts.daily_head(_event_days_by_type(spark, sf), 4, ["event_type"]), "value")


def daily_tail_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ts.daily_tail(_event_days_by_type(spark, sf), 4, ["event_type"]), "value")


def daily_tail(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ts.daily_tail(_event_days(spark, sf)), "value")


def daily_line(spark: SparkSession, sf: str) -> DataFrame:
    daily = ts.daily_mean(table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"])
    return rounded(ts.daily_line(daily, "o_totalprice"), "value")


def rolling_7d(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ts.rolling_mean(_event_days(spark, sf), "value"), "rolling")


def trend_first_last(spark: SparkSession, sf: str) -> DataFrame:
    daily = ts.daily_mean(table(spark, sf, "events"), "ts", ["value"])
    return rounded(ts.trend_first_last(daily, "value"), "first", "last", "delta")


def trend_insight(spark: SparkSession, sf: str) -> DataFrame:
    daily = ts.daily_mean(table(spark, sf, "events"), "ts", ["value"])
    trend = ts.trend_insight(ts.trend_first_last(daily, "value"))
    return trend.select("col", "direction", "severity", "title", "evidence")


# --- plan, charts, insights -------------------------------------------------


def _profiles(spark: SparkSession, sf: str) -> list[packs.TableProfile]:
    return packs.profile_tables(spark, {name: make(spark, sf) for name, make in DATASETS.items()})


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def analysis_plan(spark: SparkSession, sf: str) -> DataFrame:
    plans = []
    for name, make in DATASETS.items():
        plan = packs.analysis_plan(profile.kind_roles(make(spark, sf)))
        plans.append(plan.withColumn("dataset", F.lit(name)))
    return _union(plans)


def _run_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of real runs: all packs of all tables, written and counted."""
    logs = packs.for_tables(spark, packs.pack_run_log, _profiles(spark, sf))
    return _union(logs).select("dataset", "pack", "status", "detail")


def pack_run_log(spark: SparkSession, sf: str) -> DataFrame:
    return _run_logs(spark, sf)


def skipped_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return packs.skipped_reasons(_run_logs(spark, sf))


def run_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Log of a plan with an unknown pack and a pack that fails."""
    p = packs.table_profile(orders_nulls(spark, sf), "orders")
    steps = [
        {"pack": "snapshot"},
        {"pack": "timeseries", "params": {"cols": ["o_orderstatus"]}},
        {"pack": "forecast"},
        {"pack": "numeric"},
    ]
    return packs.run_packs(p, steps)["run_log"].select("dataset", "pack", "status", "detail")


def _charts(spark: SparkSession, sf: str) -> DataFrame:
    return _union(packs.for_tables(spark, charts.chart_entries, _profiles(spark, sf)))


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.concat_ws(",", "tags")).drop("has_data")


def charts_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose ids are blanked for one pack and whose defaults apply to another."""
    snapshot, categorical = F.col("pack") == "snapshot", F.col("pack") == "categorical"
    raw = _charts(spark, sf).withColumns({
        "id": F.when(~snapshot, F.col("id")),
        "title": F.when(~snapshot, F.col("title")),
        "priority": F.when(~categorical, F.col("priority")),
        "tags": F.when(~categorical, F.col("tags")),
        "legacy": F.col("id") == "ts_daily_line",
    })
    return _listed(charts.charts_normalize(raw))


def charts_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(charts.charts_flatten(charts.charts_normalize(_charts(spark, sf))))


def charts_top3_per_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(charts.charts_top_per_pack(charts.charts_normalize(_charts(spark, sf))))


def charts_top12(spark: SparkSession, sf: str) -> DataFrame:
    return _listed(charts.charts_cap(charts.charts_normalize(_charts(spark, sf))))


def charts_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    listed = charts.charts_normalize(_charts(spark, sf))
    tags = ("all", "quality", "categorical", "numeric", "time")
    return _union([_listed(charts.charts_by_tag(listed, t)).withColumn("filter", F.lit(t)) for t in tags])


def _insights(spark: SparkSession, sf: str) -> DataFrame:
    return _union(packs.for_tables(spark, insights.insights_table, _profiles(spark, sf)))


def _flat(df: DataFrame) -> DataFrame:
    plain = df.select(
        "*",
        F.col("evidence.type").alias("evidence_type"),
        F.col("evidence.source_pack").alias("source_pack"),
        F.concat_ws(",", "evidence.columns").alias("columns"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries("evidence.metrics")))).alias("metrics"),
    )
    return plain.drop("evidence")


def insights_table(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_insights(spark, sf))


def _relabelled(spark: SparkSession, sf: str) -> DataFrame:
    """Insights with the severities of hand-made reports: other case, unknown, missing."""
    return _insights(spark, sf).withColumns({
        "severity": F.when(F.col("severity") == "warning", F.lit("RISK"))
        .when(F.col("evidence.type") == "trend", F.lit("bogus"))
        .when(F.col("evidence.type") == "correlation", F.lit(None).cast("string"))
        .otherwise(F.col("severity")),
        "confidence": F.when(F.col("evidence.type") != "correlation", F.col("confidence")),
    })


def _brief(df: DataFrame) -> DataFrame:
    return df.select("dataset", "id", "title", "severity", "confidence", "rank")


def insights_normalize(spark: SparkSession, sf: str) -> DataFrame:
    out = insights.insights_normalize(_relabelled(spark, sf))
    return out.select("dataset", "id", "title", "severity", "confidence")


def insights_by_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(insights.insights_rank(_relabelled(spark, sf), "confidence_desc"))


def insights_by_confidence_asc(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(insights.insights_rank(_relabelled(spark, sf), "confidence_asc"))


def insights_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(insights.insights_rank(_relabelled(spark, sf), "severity"))


def insights_by_severity_filter(spark: SparkSession, sf: str) -> DataFrame:
    out = insights.insights_filter(_relabelled(spark, sf), "risk")
    return out.select("dataset", "id", "title", "severity")


def data_quality_notes(spark: SparkSession, sf: str) -> DataFrame:
    parts = [packs.table_profile(lineitem_dups(spark, sf), "flags"), *_profiles(spark, sf)]
    notes = _union(packs.for_tables(spark, insights.data_quality_notes, parts))
    return notes.withColumn("columns", F.concat_ws(",", "columns"))


def _overview(spark: SparkSession, sf: str, p: packs.TableProfile) -> DataFrame:
    log = packs.run_packs(p)["run_log"]
    return insights.overview_metrics(p, insights.insights_table(p), packs.run_errors(log))


def overview_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _overview(spark, sf, packs.table_profile(lineitem_dups(spark, sf), "flags"))


def report_markdown_lines(spark: SparkSession, sf: str) -> DataFrame:
    profiles = _profiles(spark, sf)
    logs = packs.for_tables(spark, lambda p: packs.run_packs(p)["run_log"], profiles)
    found = packs.for_tables(spark, insights.insights_table, profiles)
    errors = _union([packs.run_errors(log) for log in logs])
    overview = _union([
        insights.overview_metrics(p, i, errors) for p, i in zip(profiles, found)
    ])
    notes = _union(packs.for_tables(spark, insights.data_quality_notes, profiles))
    return report.report_lines(overview, _union(found), notes, errors)


# --- compare ----------------------------------------------------------------


def compare_metrics(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (packs.table_profile(f(spark, sf)) for f in (orders_nulls, lineitem_dups))
    counts = [insights.insights_table(p).count() for p in (a, b)]
    return cmp.compare_metrics(cmp.metric_table(a.df, counts[0]), cmp.metric_table(b.df, counts[1]))


def compare_top_missing(spark: SparkSession, sf: str) -> DataFrame:
    return cmp.compare_top_missing(orders_nulls(spark, sf), lineitem_nulls(spark, sf))


def compare_errors(spark: SparkSession, sf: str) -> DataFrame:
    logs = []
    for name, text in (("orders", "o_orderstatus"), ("events", "event_type")):
        p = packs.table_profile(DATASETS[name](spark, sf), name)
        steps = [{"pack": "snapshot"}, {"pack": "timeseries", "params": {"cols": [text]}}]
        logs.append(packs.run_errors(packs.run_packs(p, steps)["run_log"]))
    return cmp.compare_errors(*logs)


# --- sources and sinks ------------------------------------------------------


def load_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Row counts of one table through every format, chosen by suffix."""
    orders = table(spark, sf, "orders").drop("o_orderdate")
    base = scratch_dir(spark)
    orders.write.csv(f"{base}/t.CSV", header=True)
    orders.write.json(f"{base}/t.jsonl")
    orders.write.json(f"{base}/t.ndjson")
    orders.write.parquet(f"{base}/t.parquet")
    counts = []
    for suffix in ("CSV", "jsonl", "ndjson", "parquet"):
        df = load.load_table(spark, f"{base}/t.{suffix}")
        counts.append(df.agg(F.lit(suffix).alias("suffix"), F.count("*").alias("n"), F.sum("o_custkey").alias("keys")))
    return _union(counts)


def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark) + "/customer.csv"
    table(spark, sf, "customer").write.csv(path, header=True, escape='"')
    return load.load_table(spark, path)


def scan_csv_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """Document texts with line breaks and quotes, written quoted and read back."""
    path = scratch_dir(spark) + "/documents.csv"
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    docs.write.csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    read = load.load_table(spark, path)
    return read.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"), "lang")


def scan_csv_latin1(spark: SparkSession, sf: str) -> DataFrame:
    """Customer names with accents, written as latin-1 and read back."""
    path = scratch_dir(spark) + "/customer.csv"
    accented = table(spark, sf, "customer").select("c_custkey", F.translate("c_name", "Cue", "Çüé").alias("c_name"))
    accented.write.csv(path, header=True, encoding="ISO-8859-1")
    return load.load_table(spark, path)


def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return load.load_table(spark, f"{sf}/orders.parquet")


def scan_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark) + "/customer.jsonl"
    table(spark, sf, "customer").write.json(path)
    return load.load_table(spark, path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _one_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turn the objects of a partition into the lines of one JSON array."""
    yield pd.DataFrame({"value": ["["]})
    mark = ""
    for batch in batches:
        lines = "," + batch["value"]
        if len(lines):
            lines.iloc[0] = mark + batch["value"].iloc[0]
            mark = ","
        yield lines.to_frame("value")
    yield pd.DataFrame({"value": ["]"]})


def scan_json_document(spark: SparkSession, sf: str) -> DataFrame:
    """Files holding one pretty-printed array each, read as documents."""
    path = scratch_dir(spark) + "/supplier.json"
    rows = table(spark, sf, "supplier")
    objects = rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("value"))
    objects.mapInPandas(_one_document, "value string").write.text(path)
    return load.load_table(spark, path).select(*rows.columns)


def scan_json_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as documents of whole columns by row label, 500 rows a document, read back as rows."""
    path = scratch_dir(spark) + "/supplier.json"
    rows = table(spark, sf, "supplier")
    labelled = [
        F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), c))).alias(c) for c in rows.columns]
    columns = rows.groupBy((F.col("s_suppkey") / 500).cast("int").alias("part")).agg(*labelled)
    documents = columns.select("part", F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("value"))
    documents.write.partitionBy("part").text(path)
    return load.load_table(spark, path).select(*rows.columns)


def scan_jsonl_bad_line(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as JSON lines, some of them cut short: loading tells how many."""
    path = scratch_dir(spark) + "/customer.jsonl"
    rows = table(spark, sf, "customer")
    line = F.to_json(F.struct(*rows.columns))
    cut = F.when(F.col("c_custkey") % 7 == 3, F.left(line, F.lit(12))).otherwise(line)
    rows.select(cut.alias("value")).write.text(path)
    try:
        load.load_table(spark, path)
    except ValueError as e:
        return rows.limit(1).select(F.lit(str(e).split(" are not JSON")[0]).alias("broken"))
    raise AssertionError("broken lines were read")


def scan_csv_mixed_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Nations in two files whose headers differ in order: refused without a schema, by position with one."""
    path = scratch_dir(spark) + "/nation.csv"
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    nation.filter("n_nationkey % 2 = 0").write.csv(path, header=True)
    nation.filter("n_nationkey % 2 = 1").select("n_regionkey", "n_nationkey").write.mode("append").csv(path, header=True)
    try:
        load.load_table(spark, path)
    except ValueError:
        return load.load_table(spark, path, schema="a bigint, b bigint")
    raise AssertionError("files with different headers were read")


def csv_na_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A numeric column holding NA texts stays numeric."""
    path = scratch_dir(spark) + "/lineitem.csv"
    lineitem_nulls(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.coalesce(F.col("l_tax").cast("string"), F.lit("NA")).alias("l_tax"),
        F.coalesce("l_returnflag", F.lit("n/a")).alias("l_returnflag"),
    ).write.csv(path, header=True)
    df = load.load_table(spark, path)
    return df.agg(
        *[F.lit(t.dataType.simpleString()).alias(f"type_{t.name}") for t in df.schema.fields],
        *[F.count(c).alias(f"n_{c}") for c in df.columns],
        F.round(F.sum("l_tax"), 2).alias("sum_tax"),
    )


def normalize_columns(spark: SparkSession, sf: str) -> DataFrame:
    """An index column without a header and one named like an export are dropped."""
    path = scratch_dir(spark) + "/nation.csv"
    nation = table(spark, sf, "nation")
    indexed = nation.select(
        F.col("n_nationkey").alias(" "), "n_nationkey", "n_name", "n_regionkey", F.lit(1).alias("Unnamed: 4")
    )
    indexed.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return load.load_table(spark, path)


def normalize_missing_values(spark: SparkSession, sf: str) -> DataFrame:
    """NaN in place of NULL gives the same counts."""
    nan = F.lit(float("nan"))
    df = lineitem_nulls(spark, sf).withColumns({c: F.coalesce(c, nan) for c in ("l_tax", "l_discount")})
    clean = normalize_missing(df)
    return clean.agg(*[F.count(c).alias(c) for c in ("l_tax", "l_discount", "l_quantity")])


def sanitize_json(spark: SparkSession, sf: str) -> DataFrame:
    """Infinite and NaN prices come back as NULL from the written report."""
    path = scratch_dir(spark) + "/orders.jsonl"
    price = (
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan")))
        .when(F.col("o_orderkey") % 10 == 1, F.lit(float("-inf")))
        .otherwise(F.col("o_totalprice"))
    )
    sinks.write_report_json(table(spark, sf, "orders").select("o_orderkey", price.alias("price")), path)
    return load.load_table(spark, path).select("o_orderkey", "price")


def chart_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Chart data written with every field quoted, read back as text."""
    path = scratch_dir(spark) + "/chart.csv"
    chart = cat.categorical_distribution(orders_nulls(spark, sf), ORDER_TEXT).select("column", "value", "cnt")
    sinks.write_chart_csv(chart, path)
    return load.load_table(spark, path)


def write_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The deep numeric table written under the safe dataset name, read back."""
    tables = {"numeric": deep.numeric_profile(table(spark, sf, "orders"), ["o_totalprice"])}
    written = sinks.write_profile(tables, scratch_dir(spark), "sales data/orders")
    out = load.load_table(spark, written[0], fmt="parquet")
    return rounded(out.select("column", "count", "min", "max", "median"), "median", digits=4)


# --- deep profile -----------------------------------------------------------


def deep_overview(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deep.overview(lineitem_nulls(spark, sf)), "missing_pct", "duplicate_pct")


def deep_variable_types(spark: SparkSession, sf: str) -> DataFrame:
    kinds = []
    for name in ("pages", "documents", "embeddings", "events"):
        out = deep.variable_types(table(spark, sf, name))
        kinds.append(out.select(F.lit(name).alias("dataset"), "column", "type"))
    return _union(kinds)


def deep_numeric(spark: SparkSession, sf: str) -> DataFrame:
    out = deep.numeric_profile(lineitem_nulls(spark, sf), NUMBERS)
    floats = [f.name for f in out.schema.fields if f.dataType.simpleString() == "double"]
    large = ["sum", "variance"]
    return rounded(rounded(out, *[c for c in floats if c not in large], digits=4), *large, digits=2)


def deep_histogram(spark: SparkSession, sf: str) -> DataFrame:
    out = deep.histogram(table(spark, sf, "lineitem"), ["l_quantity"])
    return rounded(out, "bin_start", "bin_end")


def deep_common_values(spark: SparkSession, sf: str) -> DataFrame:
    out = deep.common_values(lineitem_nulls(spark, sf), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return rounded(out, "share")


def deep_common_texts(spark: SparkSession, sf: str) -> DataFrame:
    out = deep.common_values(table(spark, sf, "documents"), ["text", "lang"], k=5)
    return rounded(out, "share")


def deep_duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    return deep.duplicate_groups(table(spark, sf, "documents").select("text", "lang"))


def deep_extreme_values(spark: SparkSession, sf: str) -> DataFrame:
    found = deep.extreme_values(lineitem_nulls(spark, sf), ["l_quantity", "l_extendedprice", "l_tax"])
    return found.drop("exact")


def exact_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Integers that doubles cannot tell apart and decimals, whole columns."""
    line = table(spark, sf, "lineitem")
    key = (F.col("l_orderkey") + F.lit(2**53)).alias("key")
    price = (F.col("l_extendedprice").cast("decimal(20, 2)") + F.lit(10**15)).cast("decimal(24, 2)").alias("price")
    return numeric.exact_summary(line.select(key, price, "l_linenumber"), probs=(0.05, 0.25, 0.5, 0.75, 0.95))


def deep_extreme_integers(spark: SparkSession, sf: str) -> DataFrame:
    """Integers that doubles cannot tell apart, beside decimals."""
    line = table(spark, sf, "lineitem")
    key = (F.col("l_orderkey") + F.lit(2**53)).alias("key")
    price = F.col("l_extendedprice").cast("decimal(20, 2)").alias("price")
    return deep.extreme_values(line.select(key, price)).select("column", "side", "rank", "exact", "cnt")


def deep_text_length(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deep.text_length(table(spark, sf, "documents"), ["text", "lang"]), "mean")


def deep_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return deep.word_counts(table(spark, sf, "documents"), ["text"])


def deep_char_counts(spark: SparkSession, sf: str) -> DataFrame:
    return deep.char_counts(table(spark, sf, "documents"), ["text"])


def deep_datetime(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deep.datetime_range(table(spark, sf, "orders")), "range_days")


def deep_datetime_text(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deep.datetime_range(orders_strdate(spark, sf), ["o_orderdate"]), "range_days")


def deep_cramers_v_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A column of many values against one of few."""
    return rounded(deep.cramers_v(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"]), "v", digits=8)


def deep_datetime_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return deep.datetime_histogram(table(spark, sf, "orders"))


def deep_url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return deep.url_parts(table(spark, sf, "pages"), ["url"])


def deep_spearman(spark: SparkSession, sf: str) -> DataFrame:
    out = deep.spearman(lineitem_nulls(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(out, "corr", digits=8)


def deep_cramers_v(spark: SparkSession, sf: str) -> DataFrame:
    out = deep.cramers_v(lineitem_nulls(spark, sf), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return rounded(out, "v", digits=8)


def deep_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return deep.interactions(lineitem_nulls(spark, sf), ["l_quantity", "l_linenumber"], bins=8)


def deep_nullity_corr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deep.nullity_correlation(lineitem_nulls(spark, sf)), "corr", digits=8)


def deep_nullity_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return deep.nullity_patterns(lineitem_nulls(spark, sf))


def deep_samples(spark: SparkSession, sf: str) -> DataFrame:
    return deep.samples(table(spark, sf, "orders"), ["o_orderkey"])


def deep_duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    return deep.duplicate_groups(lineitem_dups(spark, sf))


def deep_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(deep.alerts(lineitem_const(spark, sf)), "value")


def deep_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Number of rows of every table of a whole deep profile."""
    tables = deep.deep_profile(orders_nulls(spark, sf), ["o_orderkey"])
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in tables.items()]
    return _union(counts)


REGISTERED: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    schema_profile, missing_by_column, missing_top20, missing_total, shape, duplicate_rows,
    duplicate_rows_text, n_unique, n_unique_text, n_unique_approx, value_frequencies, column_roles,
    datetime_roles, datetime_roles_probe, id_like_columns, id_like_categorical, dataset_type, top_categoricals,
    numeric_summary, sample_rows, snapshot_skip, categorical_top10, categorical_id_insights,
    categorical_chart_columns, categorical_distribution, categorical_summary, categorical_notes,
    numeric_usable_columns, numeric_basic_stats, corr_columns, variance_rank, correlation_matrix,
    numeric_histogram, sample_rows_n, hyp_missingness, hyp_category_dominance, hyp_correlation,
    verify_hypotheses, hypothesis_candidates, hypotheses_from_json, ts_valid_rows, ts_points, daily_mean, daily_mean_by_key,
    daily_mean_offsets, daily_head, daily_tail, daily_head_by_key, daily_tail_by_key, daily_line, rolling_7d, trend_first_last, trend_insight, analysis_plan,
    pack_run_log, skipped_reasons, run_packs, charts_normalize, charts_flatten, charts_top3_per_pack,
    charts_top12, charts_by_tag, insights_table, insights_normalize, insights_by_confidence,
    insights_by_confidence_asc, insights_by_severity, insights_by_severity_filter, data_quality_notes,
    overview_metrics, report_markdown_lines, compare_metrics, compare_top_missing, compare_errors,
    load_dispatch, scan_csv, scan_csv_multiline, scan_csv_latin1, scan_parquet, scan_jsonl, scan_json_document,
    scan_json_columns, scan_jsonl_bad_line, scan_csv_mixed_headers,
    csv_na_tokens, normalize_columns, normalize_missing_values, sanitize_json, chart_csv, write_profile,
    deep_overview, deep_variable_types, deep_numeric, deep_histogram, deep_common_values,
    deep_common_texts, deep_duplicate_texts,
    exact_summary, deep_extreme_values, deep_extreme_integers, deep_text_length, deep_word_counts, deep_char_counts, deep_datetime, deep_datetime_text, deep_cramers_v_keys,
    deep_datetime_histogram, deep_url_parts, deep_spearman, deep_cramers_v, deep_interactions,
    deep_nullity_corr, deep_nullity_patterns, deep_samples, deep_duplicate_groups, deep_alerts,
    deep_profile,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {f.__name__: f for f in REGISTERED}
    named["normalize_missing"] = named.pop("normalize_missing_values")
    return named
