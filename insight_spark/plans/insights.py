"""Insights, data-quality notes and overview as tables over many datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight_spark.functions.tables import small_table
from insight_spark.operators.categorical import ID_ADVICE, NO_CHART_ADVICE, NO_CHART_EVIDENCE
from insight_spark.operators.hypotheses import Evidence, propose, verify_hypotheses
from insight_spark.operators.timeseries import trend_first_last, trend_insight
from insight_spark.plans.packs import TableProfile, skip_reason

SEVERITIES = ("risk", "warning", "opportunity", "info")

INSIGHT_SCHEMA = (
    "dataset string, seq int, id string, title string, description string, severity string, "
    "confidence double, evidence struct<type: string, source_pack: string, columns: array<string>, "
    "metrics: map<string, string>>, recommended_action string"
)

NOTE_SCHEMA = "dataset string, seq int, issue string, columns array<string>, impact string, suggestion string"


def confidence_of(n: int) -> float:
    """Small samples make weak evidence."""
    return 0.3 if n < 30 else 0.6 if n < 1000 else 0.9


def insights_table(profile: TableProfile, candidates: DataFrame | Sequence[dict] | None = None) -> DataFrame:
    """Evidence-backed insights of one table, numbered I1, I2, ...

    Sources: identifier hints and notes on categorical columns, the daily trend, and
    verified hypotheses. Each source is reduced on Spark to a handful of rows.
    """
    rows: list[tuple] = []
    n = profile.n_rows

    def add(title, description, severity, sample, kind, pack, columns, metrics, action):
        seq = len(rows) + 1
        evidence = (kind, pack, columns, {k: str(v) for k, v in metrics.items()})
        confidence = confidence_of(sample)
        rows.append((profile.dataset, seq, f"I{seq}", title, description, severity, confidence, evidence, action))

    shown = [r for r in profile.columns if r.categorical]
    for r in shown:
        if r.id_like_any_size:
            add(f"Column '{r.column}' looks like an identifier", f"Unique ratio ≈ {r.n_unique}/{r.n_rows}", "info", n,
                "distribution", "categorical", [r.column], {"n_unique": r.n_unique, "n_rows": r.n_rows}, ID_ADVICE)
    if not shown:
        add("No categorical columns", "", "info", n, "distribution", "categorical", [], {}, "")
    elif all(r.id_like_any_size for r in shown):
        add("No categorical charts rendered", NO_CHART_EVIDENCE, "info", n,
            "distribution", "categorical", [r.column for r in shown], {}, NO_CHART_ADVICE)

    if skip_reason(profile, "timeseries") is None:
        first, numeric_cols = profile.first_datetime, profile.with_role("numeric")
        trend = trend_first_last(profile.daily, numeric_cols[0])
        for r in trend_insight(trend).collect():  # one row
            add(r.title, r.evidence, r.severity, first.n_rows - first.missing, "trend", "timeseries",
                [first.column, r.col], {"direction": r.direction}, r.recommendation)

    known = Evidence()
    if candidates is None:
        proposed, known = propose(profile.columns, lambda _: profile.correlations)
        candidates = [dict(zip(("hyp_id", "kind", "statement", "col", "x", "y"), h)) for h in proposed]
    checked = verify_hypotheses(profile.df, candidates, profile.evidence(known))
    for h in checked.orderBy("hyp_id").collect():  # one row per hypothesis
        if not h.verified:
            continue
        if h.kind == "missingness":
            rate = h.missing_rate or 0.0
            severity = "risk" if rate > 0.3 else "warning" if rate > 0 else "info"
            add(h.statement, f"Missing rate {rate:.4g}", severity, n, "stat", "hypothesis_verify", [h.col],
                {"missing_rate": f"{rate:.6f}"}, "Consider imputation or filtering.")
        elif h.kind == "category_dominance":
            share = h.top_share
            add(h.statement, f"Top value '{h.top_value}' holds {share:.4g} of the values",
                "warning" if share > 0.9 else "info", n, "distribution", "hypothesis_verify", [h.col],
                {"top_value": h.top_value, "top_share": f"{share:.6f}"}, "Check whether rare values need grouping.")
        else:
            corr = h.pearson_corr
            strong = corr is not None and abs(corr) >= 0.8
            text = "undefined" if corr is None else f"{corr:.4g}"
            add(h.statement, f"Pearson correlation {text} over {h.n} rows", "opportunity" if strong else "info", h.n,
                "correlation", "hypothesis_verify", [h.x, h.y],
                {"pearson_corr": "" if corr is None else f"{corr:.6f}", "sample_size": h.n},
                "Validate correlation with additional data.")
    return small_table(profile.df.sparkSession, rows, INSIGHT_SCHEMA)


def normal_severity(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*SEVERITIES), low).otherwise(F.lit("info"))


def insights_normalize(insights: DataFrame) -> DataFrame:
    """Severity in lower case, unknown or missing ones as info."""
    return insights.withColumn("severity", normal_severity(F.col("severity")))


def insights_filter(insights: DataFrame, severity: str = "all") -> DataFrame:
    if severity == "all":
        return insights
    return insights.filter(normal_severity(F.col("severity")) == severity)


def insights_rank(insights: DataFrame, mode: str = "confidence_desc") -> DataFrame:
    """Insights with their rank per dataset; a missing confidence counts as -1."""
    confidence = F.coalesce("confidence", F.lit(-1.0))
    severity = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), normal_severity(F.col("severity")))
    order = {"confidence_desc": confidence.desc(), "confidence_asc": confidence.asc(), "severity": severity.asc()}
    window = Window.partitionBy("dataset").orderBy(order[mode], "seq")
    return insights.withColumn("rank", F.row_number().over(window))


def insights_sort(insights: DataFrame, mode: str = "confidence_desc") -> DataFrame:
    """Insights of each dataset in the order of `insights_rank`."""
    return insights_rank(insights, mode).orderBy("dataset", "rank").drop("rank")


def data_quality_notes(profile: TableProfile) -> DataFrame:
    """One note per column with missing values, one for duplicate rows."""
    rows: list[tuple] = []

    def add(issue: str, columns: list[str], share: float, suggestion: str) -> None:
        impact = "high" if share > 0.3 else "medium" if share > 0.05 else "low"
        rows.append((profile.dataset, len(rows) + 1, issue, columns, impact, suggestion))

    n = max(profile.n_rows, 1)
    for r in sorted(profile.columns, key=lambda r: (-r.missing, r.position)):
        if r.missing:
            add("Missing values detected", [r.column], r.missing / n, "Consider imputation or filtering")
    if profile.duplicates:
        add("Duplicate rows detected", [], profile.duplicates / n, "Remove repeated rows before aggregating")
    return small_table(profile.df.sparkSession, rows, NOTE_SCHEMA)


def overview_metrics(profile: TableProfile, insights: DataFrame, errors: DataFrame) -> DataFrame:
    """(dataset, rows, cols, duplicate_rows, insights, errors, status), one row."""
    size = [(profile.dataset, profile.n_rows, len(profile.columns), profile.duplicates)]
    schema = "dataset string, rows bigint, cols bigint, duplicate_rows bigint"
    both = small_table(profile.df.sparkSession, size, schema)
    own = F.col("dataset") == profile.dataset
    for name, table in (("insights", insights), ("errors", errors)):
        marks = table.filter(own).select("dataset", F.lit(1).cast("bigint").alias(name))
        both = both.unionByName(marks, allowMissingColumns=True)
    sums = both.groupBy("dataset").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "cols", "duplicate_rows", "insights", "errors")]
    )
    status = F.when(F.col("errors") > 0, F.concat(F.lit("warnings: "), F.col("errors").cast("string")))
    return sums.withColumn("status", F.coalesce(status, F.lit("clean")))
