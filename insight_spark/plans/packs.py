"""Choose and run the analysis packs of a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import col, normalize_missing
from insight_spark.functions.tables import rows_at_hand, small_table
from insight_spark.operators.categorical import categorical, ranked_values
from insight_spark.operators.hypotheses import Evidence, corr_candidates
from insight_spark.operators.numeric import column_moments, matrix_pairs, numeric, pair_correlations
from insight_spark.operators.profile import (
    column_roles,
    dataset_type_of,
    duplicate_rows,
    missing_percent,
    most_missing,
    sample_rows,
)
from insight_spark.operators.timeseries import kept_daily, timeseries
from insight_spark.sources.scratch import scratch_dir

# fixed values: pack, reason, role that must be present, at most three before numeric
PACKS = (
    ("snapshot", "Baseline dataset overview.", None),
    ("categorical", "Categorical distribution overview.", "categorical"),
    ("timeseries", "Datetime + numeric indicates time trend analysis.", "datetime"),
    ("numeric", "Numeric columns detected; show distributions and correlations.", "numeric"),
)

LOG_SCHEMA = "dataset string, pack string, status string, detail string, tables int, rows bigint"


@dataclass
class TableProfile:
    """A table and its roles: one small row per column, read once."""

    dataset: str
    df: DataFrame
    columns: tuple[Row, ...]

    def with_role(self, role: str) -> list[str]:
        return [r.column for r in self.columns if r[role]]

    @property
    def n_rows(self) -> int:
        return self.columns[0].n_rows if self.columns else 0

    @property
    def missing_total(self) -> int:
        return sum(r.missing for r in self.columns)

    @property
    def usable(self) -> list[str]:
        return [r.column for r in self.columns if r.numeric and not r.id_like]

    @property
    def first_datetime(self) -> Row | None:
        return next((r for r in self.columns if r.datetime), None)

    @property
    def roles(self) -> DataFrame:
        """The roles as a table again, without another pass over the data."""
        schema = (
            "column string, position int, dtype string, n_rows bigint, missing bigint, n_unique bigint, "
            "numeric boolean, categorical boolean, datetime boolean, id_like boolean, "
            "id_like_any_size boolean, format_no int"
        )
        return small_table(self.df.sparkSession, [tuple(r) for r in self.columns], schema)

    # Each of the following makes its pass over the data on first use and is kept: a
    # few rows per column on the driver, or the daily table in the checkpoint folder.

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.df).first().duplicate_rows

    @cached_property
    def moments(self) -> dict[str, Row]:
        return column_moments(self.df, self.with_role("numeric"))

    @cached_property
    def correlations(self) -> dict:
        """(Pearson, rows) of the pairs of the usable columns with most values."""
        return pair_correlations(self.df, matrix_pairs(corr_candidates(self.columns)), self.moments)

    @cached_property
    def top_values(self) -> list[Row]:
        return ranked_values(self.df, self.with_role("categorical"), self.columns)

    @cached_property
    def daily(self) -> DataFrame:
        """Daily means of all numeric columns over the first datetime column."""
        first = self.first_datetime
        return kept_daily(self.df, first.column, self.with_role("numeric"), format_no=first.format_no)

    def evidence(self, known: Evidence) -> Evidence:
        """Add what the profile knows to the evidence for hypotheses."""
        known.dominance |= {r.column: (r.value, r.cnt / r.non_null) for r in self.top_values if r["rank"] == 1}
        return known


def table_profile(df: DataFrame, dataset: str = "dataset") -> TableProfile:
    df = normalize_missing(df)
    return TableProfile(dataset, df, tuple(column_roles(df).orderBy("position").collect()))


TABLES_AT_ONCE = 8


def for_tables(spark: SparkSession, work: Callable, tables: Sequence) -> list:
    """Results of `work` per table; the jobs of independent tables run side by side."""
    if not tables:
        return []
    with ThreadPoolExecutor(min(TABLES_AT_ONCE, len(tables))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), tables))


def profile_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> list[TableProfile]:
    return for_tables(spark, lambda item: table_profile(item[1], item[0]), list(tables.items()))


def analysis_plan(roles: DataFrame) -> DataFrame:
    """(step, pack, why, dataset_type, params, notes): snapshot, then the packs whose role occurs.

    `params` is the JSON of what a pack is run with: the columns of its role (`cols`), for the time series also
    the first datetime column (`ts_col`). A step may be changed there before `run_packs` gets the plan.
    """
    has = {r: F.coalesce(F.bool_or(r), F.lit(False)) for r in ("categorical", "datetime", "numeric")}

    def of(role: str) -> Column:
        found = F.array_sort(F.collect_list(F.when(F.col(role), F.struct("position", "column"))))
        return F.transform(found, lambda x: x["column"])

    params = {
        None: F.lit("{}"), "categorical": F.to_json(F.struct(of("categorical").alias("cols"))),
        "numeric": F.to_json(F.struct(of("numeric").alias("cols"))),
        "datetime": F.to_json(F.struct(F.get(of("datetime"), 0).alias("ts_col"), of("numeric").alias("cols"))),
    }
    steps = [
        F.when(has[role] if role else F.lit(True),
               F.struct(F.lit(pack).alias("pack"), F.lit(why).alias("why"), params[role].alias("params")))
        for pack, why, role in PACKS
    ]
    wanted = F.filter(F.array(*steps), lambda s: s.isNotNull())
    notes = F.concat(F.lit("Rule-based plan over "), F.count("*").cast("string"), F.lit(" columns."))
    one = roles.agg(wanted.alias("steps"), dataset_type_of(has).alias("dataset_type"), notes.alias("notes"))
    rows = one.select(F.posexplode("steps").alias("at", "s"), "dataset_type", "notes")
    return rows.select((F.col("at") + 1).alias("step"), "s.pack", "s.why", "dataset_type", "s.params", "notes")


def pack_run_log(profile: TableProfile, packs: Sequence[str] | None = None, path: str | None = None) -> DataFrame:
    """(dataset, pack, status, detail, tables, rows) of a run of the named packs, by default the planned ones."""
    return run_packs(profile, [{"pack": p} for p in (planned_packs(profile) if packs is None else packs)], path=path)["run_log"]


def planned_packs(profile: TableProfile) -> list[str]:
    return [pack for pack, _, role in PACKS if role is None or profile.with_role(role)]


def skip_reason(profile: TableProfile, pack: str) -> str | None:
    numeric_cols = profile.with_role("numeric")
    first = profile.first_datetime
    if pack == "snapshot":
        return None if profile.missing_total else "No missing values."
    if pack == "categorical":
        return None if profile.with_role("categorical") else "No categorical columns."
    if pack == "timeseries":
        if first is None or not numeric_cols:
            return "No datetime+numeric."
        return None if first.n_rows > first.missing else "Not enough datetime rows or no numeric columns."
    if pack == "numeric":
        if not numeric_cols:
            return "No numeric columns."
        return None if profile.usable else "No usable numeric columns (numeric columns look like IDs)."
    return f"Unknown pack: {pack}"


def skipped_reasons(run_log: DataFrame) -> DataFrame:
    """(dataset, reason) as `pack: reason`."""
    return run_log.filter("status = 'skipped'").select(
        "dataset", F.concat("pack", F.lit(": "), "detail").alias("reason")
    )


def run_errors(run_log: DataFrame) -> DataFrame:
    """(dataset, error) of the packs that failed."""
    failed = run_log.filter(F.col("detail").startswith("Error: "))
    text = F.concat(F.lit("pack_error["), "pack", F.lit("]: "), F.substr("detail", F.lit(8)))
    return failed.select("dataset", text.alias("error"))


def run_packs(table: TableProfile | DataFrame, plan: DataFrame | Sequence[dict] | None = None,
              order_by: Sequence[str] | None = None, path: str | None = None) -> dict:
    """Run the packs of a plan in order and write their tables; a failing pack does not stop the next one.

    A plan is a list of steps {pack, params}, or the table of `analysis_plan`. The result maps each pack to its
    tables, read back from below `path`, plus `run_log`. Without a path, tables that still have to be computed go
    to a new folder in the session's shared one, and those whose few rows are at hand stay as they are. The log is
    (dataset, pack, status, detail, tables, rows), filled in after the write of a pack's last table, so that a
    pack which fails only when its rows are computed is logged with its error and gives no tables.
    Parameters are a dict or its JSON: `cols` of the categorical and numeric packs, ts_col, cols, keys and value
    of the time series; all packs run with defaults.
    """
    profile = table_profile(table) if isinstance(table, DataFrame) else table
    spark = profile.df.sparkSession
    if plan is None:
        steps: list[dict] = [{"pack": p} for p in planned_packs(profile)]
    elif isinstance(plan, DataFrame):
        steps = [r.asDict() for r in plan.orderBy("step").collect()]  # at most four rows
    else:
        steps = [s for s in plan if s.get("pack")]
    base = path or scratch_dir(spark)
    results: dict = {}
    log: dict[str, tuple] = {}
    for step in steps:
        pack = step["pack"]
        try:
            tables = _run(profile, pack, _params(step.get("params")), order_by)
            written = for_tables(
                spark, lambda t: _kept(t[1], None if path else rows_at_hand(t[1]), f"{base}/{uuid.uuid4().hex}-{t[0]}"),
                list(tables.items()))
        except Exception as e:  # noqa: BLE001 - a pack may fail in any way, the next one still runs
            results.pop(pack, None)
            log[pack] = (profile.dataset, pack, "skipped", f"Error: {_reason(e)}", 0, None)
            continue
        results[pack] = {name: df for name, (df, _) in zip(tables, written)}
        skipped = results[pack]["skip"].first() if "skip" in tables else None
        status, detail = ("skipped", skipped.skipped) if skipped else ("done", "OK")
        log[pack] = (profile.dataset, pack, status, detail, len(written), sum(n for _, n in written))
    results["run_log"] = small_table(spark, list(log.values()), LOG_SCHEMA)
    return results


def _params(given: dict | str | None) -> dict:
    return json.loads(given) if isinstance(given, str) else given or {}


def _kept(df: DataFrame, at_hand: int | None, path: str) -> tuple[DataFrame, int]:
    """The table and its rows; it is written as Parquet, counted on the way and read back, unless its rows are at hand."""
    if at_hand is not None:
        return df, at_hand
    plain = df.select(*[
        (col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) else col(f.name))
        for f in df.schema.fields
    ])
    seen = Observation()
    plain.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path), seen.get["rows"]


def _reason(error: Exception) -> str:
    """First line of an error's message."""
    return next(iter(str(error).strip().splitlines()), type(error).__name__)


def _run(profile: TableProfile, pack: str, params: dict, order_by: Sequence[str] | None) -> dict[str, DataFrame]:
    df = profile.df
    if pack == "snapshot":
        return _snapshot(profile, order_by)
    reason = skip_reason(profile, pack)
    if reason is not None:
        return {"skip": small_table(df.sparkSession, [(pack, reason)], "pack string, skipped string")}
    if pack == "categorical":
        cols = params.get("cols", profile.with_role("categorical"))
        known = [r for r in profile.top_values if r.column in cols]
        return categorical(df, cols, known if set(cols) <= set(profile.with_role("categorical")) else None)
    if pack == "timeseries":
        first = profile.first_datetime
        given = {"ts_col": first.column, "cols": profile.with_role("numeric"), **params}
        return timeseries(df, **given, format_no=first.format_no if given["ts_col"] == first.column else None)
    cols = params.get("cols", profile.with_role("numeric"))
    known = cols == profile.with_role("numeric")
    return numeric(df, cols, profile.with_role("id_like"), profile.moments if known else None,
                   profile.correlations if known else None)


def _snapshot(profile: TableProfile, order_by: Sequence[str] | None) -> dict[str, DataFrame]:
    """The snapshot pack out of the profile; only the sample reads the table."""
    spark = profile.df.sparkSession
    missing = missing_percent(profile.roles.select("column", "position", "n_rows", "missing"))
    nothing = [] if profile.missing_total else [("snapshot", "No missing values.")]
    return {
        "shape": small_table(spark, [(profile.n_rows, len(profile.columns))], "rows bigint, cols bigint"),
        "duplicate_rows": small_table(spark, [(profile.duplicates,)], "duplicate_rows bigint"),
        "sample_rows": sample_rows(profile.df, 5, order_by),
        "missing_top": most_missing(missing),
        "skip": small_table(spark, nothing, "pack string, skipped string"),
    }
