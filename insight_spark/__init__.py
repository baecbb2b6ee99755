"""PySpark-native data profiling and insight engine."""

from insight_spark.operators.categorical import categorical
from insight_spark.operators.compare import compare
from insight_spark.operators.deep import deep_profile
from insight_spark.operators.frequency import n_unique, top_values, value_frequencies
from insight_spark.operators.hypotheses import hypotheses_from_json, hypothesis_candidates, verify_hypotheses
from insight_spark.operators.numeric import correlation_matrix, numeric, numeric_histogram, numeric_summary
from insight_spark.operators.profile import (
    column_roles,
    dataset_type,
    duplicate_rows,
    kind_roles,
    missing_total,
    schema_profile,
    snapshot,
    top_categoricals,
)
from insight_spark.operators.timeseries import timeseries
from insight_spark.plans.charts import (
    chart_entries,
    charts_by_tag,
    charts_cap,
    charts_flatten,
    charts_normalize,
)
from insight_spark.plans.insights import (
    data_quality_notes,
    insights_filter,
    insights_normalize,
    insights_sort,
    insights_table,
    overview_metrics,
)
from insight_spark.plans.packs import analysis_plan, profile_tables, run_errors, run_packs, table_profile
from insight_spark.plans.report import report_lines
from insight_spark.sources.load import load_table
from insight_spark.sources.sinks import to_report_json, write_chart_csv, write_profile, write_report_lines

__all__ = [
    "analysis_plan", "categorical", "chart_entries", "charts_by_tag", "charts_cap", "charts_flatten",
    "charts_normalize", "column_roles", "compare", "correlation_matrix", "data_quality_notes", "dataset_type",
    "deep_profile", "duplicate_rows", "hypotheses_from_json", "hypothesis_candidates", "insights_filter",
    "insights_normalize", "insights_sort", "insights_table", "kind_roles", "load_table", "missing_total", "n_unique", "numeric",
    "numeric_histogram", "numeric_summary", "overview_metrics", "profile_tables", "report_lines", "run_errors",
    "run_packs", "schema_profile", "snapshot", "table_profile", "timeseries", "to_report_json", "top_categoricals",
    "top_values", "value_frequencies", "verify_hypotheses", "write_chart_csv", "write_profile", "write_report_lines",
]
