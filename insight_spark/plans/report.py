"""Markdown report as a table of lines, for one or many datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight_spark.plans.insights import normal_severity

# fixed values: section number, heading, most entries shown
SECTIONS = {
    "risks": (3, "## Key Risks", 10),
    "opportunities": (4, "## Opportunities", 10),
    "notes": (5, "## Data Quality Notes", 10),
    "insights": (6, "## Insights", 20),
    "next_steps": (7, "## Next Steps", 15),
    "errors": (8, "## Errors / Warnings", 30),
}
# fixed values: shorter lists of the on-screen overview
SCREEN_CAPS = {"risks": 6, "opportunities": 6, "notes": 4}
EMPTY = "—"


def _or_dash(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(EMPTY))


def _capped(table: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("dataset").orderBy("seq")
    return table.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def _entries(table: DataFrame, section: str, caps: dict[str, int], *lines: Column) -> DataFrame:
    """Lines of each entry of a section, in entry order, capped."""
    number, _, most = SECTIONS[section]
    return _capped(table, caps.get(section, most)).select(
        "dataset",
        F.lit(number).alias("section_no"),
        F.col("n").alias("entry"),
        F.posexplode(F.array(*lines)).alias("part", "line"),
    )


def _fixed(datasets: DataFrame, number: int, entry: int, *lines: Column) -> DataFrame:
    return datasets.select(
        "dataset",
        F.lit(number).alias("section_no"),
        F.lit(entry).alias("entry"),
        F.posexplode(F.array(*lines)).alias("part", "line"),
    )


def report_lines(overview: DataFrame, insights: DataFrame, notes: DataFrame, errors: DataFrame,
                 generated: str | None = None, profile_path: str | None = None,
                 caps: dict[str, int] | None = None) -> DataFrame:
    """(dataset, section_no, line_no, line) in a fixed section order with entry caps.

    Risks and opportunities are the insights of that severity; next steps are the
    distinct actions in insight order. An empty section shows a dash; errors are
    left out when there are none. `caps` changes the most entries of a section.
    """
    caps = caps or {}
    severity = normal_severity(F.col("severity"))
    titled = F.concat(F.lit("- "), _or_dash(F.col("title")))
    steps = (
        insights.filter("recommended_action != ''")
        .groupBy("dataset", "recommended_action")
        .agg(F.min("seq").alias("seq"))
    )
    percent = F.concat((F.col("confidence") * 100).cast("int").cast("string"), F.lit("%"))
    numbered = errors.withColumn("seq", F.row_number().over(Window.partitionBy("dataset").orderBy("error")))
    bodies = {
        "risks": _entries(insights.filter(severity == "risk"), "risks", caps, titled),
        "opportunities": _entries(insights.filter(severity == "opportunity"), "opportunities", caps, titled),
        "notes": _entries(
            notes,
            "notes",
            caps,
            F.concat(
                F.lit("- **"), _or_dash(F.col("issue")),
                F.lit("** | Columns: "), _or_dash(F.nullif(F.concat_ws(", ", "columns"), F.lit(""))),
                F.lit(" | Impact: "), _or_dash(F.col("impact")),
            ),
            F.concat(F.lit("  - Suggestion: "), _or_dash(F.col("suggestion"))),
        ),
        "insights": _entries(
            insights,
            "insights",
            caps,
            F.concat(F.lit("### "), F.coalesce("title", F.lit("Untitled"))),
            F.concat(F.lit("- Severity: **"), F.coalesce("severity", F.lit("info")), F.lit("**")),
            F.concat(F.lit("- Confidence: **"), _or_dash(percent), F.lit("**")),
            F.concat(F.lit("- Description: "), _or_dash(F.col("description"))),
            F.concat(F.lit("- Action: "), _or_dash(F.col("recommended_action"))),
            F.lit(""),
        ),
        "next_steps": _entries(
            steps, "next_steps", caps, F.concat(F.lit("- "), F.col("recommended_action"))
        ),
        "errors": _entries(numbered, "errors", caps, F.concat(F.lit("- "), _or_dash(F.col("error")))),
    }
    datasets = overview.select("dataset")
    text = F.concat(
        F.lit("Dataset "), F.col("dataset"), F.lit(": "), F.col("rows").cast("string"), F.lit(" rows, "),
        F.col("cols").cast("string"), F.lit(" columns, status "), F.col("status"), F.lit("."),
    )
    head = [F.lit("# Analytics Report")]
    if generated:
        head.append(F.lit(f"- Generated: {generated}"))
    if profile_path:
        head.append(F.lit(f"- Profiling: {profile_path}"))
    parts = [
        _fixed(datasets, 1, 0, *head, F.lit("")),
        _fixed(
            overview,
            2,
            0,
            F.lit("## Overview"),
            text,
            F.lit(""),
            F.lit("### Snapshot"),
            F.concat(F.lit("- Rows: "), _or_dash(F.col("rows"))),
            F.concat(F.lit("- Columns: "), _or_dash(F.col("cols"))),
            F.concat(F.lit("- Duplicate rows: "), _or_dash(F.col("duplicate_rows"))),
            F.lit(""),
        ),
    ]
    last = 1 << 20  # after every entry of a section
    for name, body in bodies.items():
        number, heading, _ = SECTIONS[name]
        filled = body.select("dataset").distinct()
        if name == "errors":
            shown, end = filled, [F.lit("")]
        else:
            shown, end = datasets, [F.lit("")]
            empty = datasets.join(filled, "dataset", "left_anti")
            parts.append(_fixed(empty, number, 1, F.lit("- " + EMPTY)))
            if name == "insights":  # every insight already ends in a blank line
                end = []
                parts.append(_fixed(empty, number, last, F.lit("")))
        parts.append(_fixed(shown, number, 0, F.lit(heading)))
        parts.append(body)
        if end:
            parts.append(_fixed(shown, number, last, *end))
    lines = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("dataset").orderBy("section_no", "entry", "part")
    return lines.select("dataset", "section_no", F.row_number().over(order).alias("line_no"), "line")
