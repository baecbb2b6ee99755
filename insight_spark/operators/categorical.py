"""Categorical columns: top values, identifier hints, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from insight_spark.functions.columns import fields_of, name_at, normalize_missing
from insight_spark.functions.tables import small_table
from insight_spark.operators.frequency import TOP_SCHEMA, best_values, column_counts, top_values
from insight_spark.operators.profile import id_like_any_size

TOP_VALUES = 10

ID_ADVICE = "Exclude from categorical distribution charts and most modeling features."
NO_CHART_EVIDENCE = "All candidate columns look like identifiers or have no values."
NO_CHART_ADVICE = (
    "Check categorical role detection or allow 'top N + Other' for high-cardinality columns."
)


def _used(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [f.name for _, f in fields_of(df, list(cols))]


def _ranked(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """Top values of the used columns with totals and the identifier flag."""
    top = top_values(df, _used(df, cols), k)
    return top.withColumn("id_like", id_like_any_size(F.col("n_unique"), F.col("n_rows")))


def _counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, position, n_rows, non_null, n_unique, id_like); one row per used column."""
    used = _used(df, cols)
    if not used:
        schema = "column string, position int, n_rows bigint, non_null bigint, n_unique bigint, id_like boolean"
        return small_table(df.sparkSession, [], schema)
    counts = column_counts(normalize_missing(df), used)
    return counts.select(
        name_at(F.col("position"), df.columns).alias("column"),
        "*",
        id_like_any_size(F.col("n_unique"), F.col("n_rows")).alias("id_like"),
    )


def categorical_top(df: DataFrame, cols: Sequence[str], k: int = TOP_VALUES) -> DataFrame:
    """(column, n_unique, value, cnt, rank) of all the columns."""
    return _ranked(df, cols, k).select("column", "n_unique", "value", "cnt", "rank")


def categorical_id_insights(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _id_insights(_counts(df, cols))


def _id_insights(counts: DataFrame) -> DataFrame:
    return counts.filter("id_like").select(
        "column",
        F.lit("info").alias("severity"),
        F.concat(F.lit("Column '"), "column", F.lit("' looks like an identifier")).alias("title"),
        F.format_string("Unique ratio ≈ %d/%d", "n_unique", "n_rows").alias("evidence"),
        F.lit(ID_ADVICE).alias("recommendation"),
    )


def categorical_chart_columns(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """The columns that do not look like identifiers, or the first k of them."""
    shown = _counts(df, cols).filter("not id_like").select("column", "position", "non_null")
    return shown if k is None else shown.orderBy("position").limit(k)


def categorical_distribution(df: DataFrame, cols: Sequence[str], k: int = TOP_VALUES,
                             charts: int | None = None) -> DataFrame:
    """(column, value, cnt, pct, pct_of_non_null) of the chart columns, or of the first `charts` of them.

    `pct` is the share among the values kept, `pct_of_non_null` among all values.
    """
    return _distribution(_ranked(df, cols, k), charts)


def _distribution(ranked: DataFrame, charts: int | None = None) -> DataFrame:
    # k rows per column
    kept = ranked.filter("not id_like and rank is not null")
    if charts is not None:
        place = F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("position"))
        kept = kept.withColumn("place", place).filter(F.col("place") <= charts)
    total = F.sum("cnt").over(Window.partitionBy("position"))
    return kept.select(
        "column",
        "value",
        "cnt",
        (F.col("cnt") / total * 100.0).alias("pct"),
        (F.col("cnt") / F.col("non_null") * 100.0).alias("pct_of_non_null"),
    )


def categorical_summary(df: DataFrame, cols: Sequence[str], charts: int | None = None) -> DataFrame:
    """(n_cols, cols_used, n_charts)."""
    return _summary(_counts(df, cols), charts)


def _summary(counts: DataFrame, charts: int | None = None) -> DataFrame:
    shown = F.count_if(~F.col("id_like"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("position", "column"))), lambda s: s["column"])
    return counts.agg(
        F.count("*").alias("n_cols"),
        names.alias("cols_used"),
        (shown if charts is None else F.least(shown, F.lit(charts).cast("bigint"))).alias("n_charts"),
    )


def categorical_notes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Info rows for a table without categorical columns or without charts."""
    return _notes(categorical_summary(df, cols))


def _notes(summary: DataFrame) -> DataFrame:
    none = F.col("n_cols") == 0
    return summary.filter(none | (F.col("n_charts") == 0)).select(
        F.lit("info").alias("severity"),
        F.when(none, "No categorical columns").otherwise("No categorical charts rendered").alias("title"),
        F.when(none, "").otherwise(NO_CHART_EVIDENCE).alias("evidence"),
        F.when(none, "").otherwise(NO_CHART_ADVICE).alias("recommendation"),
    )


RANKED_SCHEMA = TOP_SCHEMA + ", id_like boolean"
RANKED = Row("column", "position", "n_rows", "non_null", "n_unique", "value", "cnt", "rank", "id_like")


def ranked_values(df: DataFrame, cols: Sequence[str], roles: Sequence[Row] | None = None,
                  k: int = TOP_VALUES) -> list[Row]:
    """Top values of the used columns on the driver: k rows per column.

    With the roles at hand, the totals of the columns need not be counted again.
    """
    used = _used(df, cols)
    if not used:
        return []
    if roles is None:
        return _ranked(df, cols, k).orderBy("position", "rank").collect()
    best: dict[int, list[Row]] = {}
    for r in best_values(df, used, k).orderBy("position", "rank").collect():
        best.setdefault(r.position, []).append(r)
    rows = []
    for c in (r for r in roles if r.column in used):
        totals = (c.column, c.position, c.n_rows, c.n_rows - c.missing, c.n_unique)
        listed = [(r.value, r.cnt, r["rank"]) for r in best.get(c.position, [])] or [(None, None, None)]
        rows += [RANKED(*totals, *values, c.id_like_any_size) for values in listed]
    return rows


def categorical(df: DataFrame, cols: Sequence[str], ranked: Sequence[Row] | None = None,
                charts: int | None = None) -> dict[str, DataFrame]:
    """Categorical pack; one pass serves all its tables. `charts` limits the columns with a distribution."""
    spark = df.sparkSession
    rows = ranked_values(df, cols) if ranked is None else ranked
    top = small_table(spark, [tuple(r) for r in rows], RANKED_SCHEMA)
    counts = top.select("column", "position", "n_rows", "non_null", "n_unique", "id_like").distinct()
    summary = _summary(counts, charts)
    tables = {"summary": summary, "notes": _notes(summary)}
    if not _used(df, cols):
        tables["skip"] = small_table(spark, [("categorical", "No categorical columns.")], "pack string, skipped string"
        )
        return tables
    return tables | {
        "top_values": top.select("column", "n_unique", "value", "cnt", "rank"),
        "insights": _id_insights(counts),
        "distribution": _distribution(top, charts),
    }
