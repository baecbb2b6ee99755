"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog.queries import all_queries  # noqa: E402

HEADLINE = (
    "schema_profile", "missing_top20", "duplicate_rows", "duplicate_rows_text", "n_unique_text",
    "column_roles", "top_categoricals", "categorical_distribution", "numeric_summary",
    "numeric_basic_stats", "correlation_matrix", "numeric_histogram", "verify_hypotheses",
    "hypothesis_candidates", "daily_mean_by_key", "daily_line", "rolling_7d", "trend_insight",
    "pack_run_log", "charts_flatten", "insights_table", "compare_metrics", "scan_csv", "csv_na_tokens",
    "sanitize_json", "deep_numeric", "deep_extreme_values", "deep_text_length", "deep_word_counts",
    "deep_char_counts", "deep_spearman", "deep_cramers_v", "deep_interactions", "deep_alerts",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("insight_spark bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["shape"](spark, sf).collect()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # the noop sink runs the whole result without bringing it to the driver
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf).name,
    }))


if __name__ == "__main__":
    main()
