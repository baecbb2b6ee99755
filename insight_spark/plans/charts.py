"""Chart catalogue: which charts a table yields, their ranks and filters.

One row per chart and a leading dataset column, so the charts of many tables form
one table; caps and ranks are windows per dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from insight_spark.functions.tables import small_table
from insight_spark.operators.numeric import by_variance
from insight_spark.operators.timeseries import MIN_DAYS
from insight_spark.plans.packs import TableProfile, skip_reason

PER_PACK = 3
TOTAL = 12
DEFAULT_PRIORITY = 50

CHART_SCHEMA = (
    "dataset string, pack string, seq int, id string, title string, priority int, "
    "tags array<string>, mark string, has_data boolean"
)


def chart_entries(profile: TableProfile) -> DataFrame:
    """Raw chart rows of one table, in pack order."""
    rows: list[tuple] = []

    def add(pack: str, id_: str, title: str, priority: int, tags: list[str], mark: str, has_data: bool = True):
        rows.append((profile.dataset, pack, len(rows) + 1, id_, title, priority, tags, mark, has_data))

    if skip_reason(profile, "snapshot") is None:
        for unit in ("Count", "Percent"):
            add("snapshot", f"missing_{unit.lower()}", f"Missing values (Top 20) — {unit}", 95,
                ["quality", "snapshot"], "bar")
    charted = [r for r in profile.columns if r.categorical and not r.id_like_any_size]
    for i, r in enumerate(charted):
        add("categorical", f"cat_top_{i + 1}", f"Top categories: {r.column}", 70 - 5 * i,
            ["categorical", "distribution"], "bar", r.n_unique > 0)
    if skip_reason(profile, "timeseries") is None:
        value = profile.with_role("numeric")[0]
        add("timeseries", "ts_daily_line", f"Daily trend — {value}", 85, ["timeseries", "trend"], "line")
        if profile.daily.count() >= MIN_DAYS:
            add("timeseries", "ts_rolling_7d", f"Rolling average (7D) — {value}", 80,
                ["timeseries", "smoothing"], "line")
    if skip_reason(profile, "numeric") is None:
        add("numeric", "numeric_corr", "Correlation heatmap", 95, ["numeric"], "rect")
        for i, c in enumerate(by_variance(profile.moments, profile.usable)):
            add("numeric", f"numeric_hist_{i + 1}", f"Histogram: {c}", 80, ["numeric"], "bar", profile.moments[c].n > 0)
    return small_table(profile.df.sparkSession, rows, CHART_SCHEMA)


def charts_normalize(charts: DataFrame) -> DataFrame:
    """Fill in default id, title, priority and tags; drop charts without data.

    A row whose `legacy` flag is set stands for a pack's single unnamed chart.
    """
    kept = charts.filter("has_data")
    legacy = F.coalesce("legacy", F.lit(False)) if "legacy" in charts.columns else F.lit(False)
    number = F.row_number().over(Window.partitionBy("dataset", "pack").orderBy("seq"))

    def unless_legacy(c: str, default: Column) -> Column:
        given = F.when(~legacy, F.nullif(F.col(c), F.lit(""))) if c in ("id", "title") else F.when(~legacy, F.col(c))
        return F.coalesce(given, default).alias(c)

    numbered = F.concat("pack", F.lit("_chart_"), number.cast("string"))
    default_id = F.when(legacy, F.concat("pack", F.lit("_vega"))).otherwise(numbered)
    tags = F.when(~legacy & (F.size("tags") > 0), F.col("tags"))
    return kept.select(
        "dataset",
        "pack",
        "seq",
        unless_legacy("id", default_id),
        unless_legacy("title", F.col("pack")),
        unless_legacy("priority", F.lit(DEFAULT_PRIORITY)),
        F.coalesce(tags, F.array("pack")).alias("tags"),
        "mark",
    )


def _best(part: list[str]):
    return Window.partitionBy(*part).orderBy(F.col("priority").desc(), "seq")


def charts_flatten(charts: DataFrame) -> DataFrame:
    """All charts of a dataset with their rank by priority, no caps."""
    return charts.withColumn("rank", F.row_number().over(_best(["dataset"])))


def charts_top_per_pack(charts: DataFrame, k: int = PER_PACK) -> DataFrame:
    return charts.withColumn("rank", F.row_number().over(_best(["dataset", "pack"]))).filter(F.col("rank") <= k)


def charts_top(charts: DataFrame, k: int = TOTAL) -> DataFrame:
    return charts_flatten(charts).filter(F.col("rank") <= k)


def charts_cap(charts: DataFrame, per_pack: int = PER_PACK, total: int = TOTAL) -> DataFrame:
    """Best charts per pack, then best of a dataset."""
    return charts_top(charts_top_per_pack(charts, per_pack).drop("rank"), total)


# fixed values: filters that cover more than their own name
TAG_GROUPS = {"quality": ("quality", "snapshot"), "time": ("time", "timeseries")}


def charts_by_tag(charts: DataFrame, tag: str) -> DataFrame:
    """Charts whose tags or pack match; `all` keeps everything."""
    if tag == "all":
        return charts
    wanted = F.array(*[F.lit(t) for t in TAG_GROUPS.get(tag, (tag,))])
    return charts.filter(F.arrays_overlap(F.array_append("tags", F.col("pack")), wanted))
