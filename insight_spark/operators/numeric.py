"""Numeric columns: summaries, correlation matrix, histograms."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import (
    AGG_FIELDS,
    as_double,
    fields_of,
    finite,
    is_numeric,
    normalize_missing,
    per_column,
)
from insight_spark.functions.tables import small_table
from insight_spark.operators.gram import gram_sums
from insight_spark.operators.quantiles import RANGE_STATS, exact_quantiles, range_basics, typed_columns

MAX_BINS = 30


def numeric_fields(df: DataFrame, cols: Sequence[str] | None = None) -> list[tuple[int, T.StructField]]:
    return [(p, f) for p, f in fields_of(df, cols) if is_numeric(f.dataType)]


def usable_columns(df: DataFrame, cols: Sequence[str], id_like: Sequence[str] = ()) -> list[str]:
    """Columns that exist, are numeric and are not identifiers."""
    skip = set(id_like)
    return [f.name for _, f in numeric_fields(df, cols) if f.name not in skip]


def numeric_usable_columns(roles: DataFrame) -> DataFrame:
    return roles.filter("numeric and not id_like").select("column", "position")


def _doubles(fields: Sequence[tuple[int, T.StructField]]) -> list[tuple[int, str, Column]]:
    return [(p, f.name, as_double(f)) for p, f in fields]


def describe_fields(df: DataFrame) -> list[tuple[int, T.StructField]]:
    """Columns a summary covers: booleans only when nothing else is numeric."""
    fields = numeric_fields(df)
    real = [(p, f) for p, f in fields if not isinstance(f.dataType, T.BooleanType)]
    return real or fields


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles (linear interpolation) and max per column.

    Quartiles are exact (see `quantiles`) and found in the column's own type, rounded to a double at the end
    (`exact_summary` has them in full); `exact=False` takes Spark's sketch instead and needs a single pass.
    """
    df = normalize_missing(df)
    fields = describe_fields(df) if cols is None else numeric_fields(df, cols)
    stats = {
        "count": F.count,
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
    }
    probs = [0.25, 0.5, 0.75]
    columns = _doubles(fields)
    if not exact:
        stats["q"] = lambda c: F.percentile_approx(c, probs, 10000)
        rows = per_column(df, columns, stats, fields=9)
        return rows.select(
            "column", "count", "mean", "std", "min",
            *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
            "max",
        )
    basics = per_column(df, columns, stats | RANGE_STATS, fields=13).collect()
    quantiles = exact_quantiles(df, typed_columns(fields), probs, {r.position: r.asDict() for r in basics})
    rows = [
        (r.column, r["count"], r["mean"], r["std"], r["min"], *map(as_float, quantiles[r.position]), r["max"])
        for r in basics
    ]
    schema = (
        "column string, count bigint, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double"
    )
    return small_table(df.sparkSession, rows, schema)


def as_float(x) -> float | None:
    return None if x is None else float(x)


EXACT_SCHEMA = "column string, statistic string, exact string"


def exact_summary(df: DataFrame, cols: Sequence[str] | None = None,
                  probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, statistic, exact): min, quantiles (p25, ...), max and mad of columns of integers and decimals.

    Values are written out in full, without trailing zeros after the point. `mad` is the median distance from the median. Columns of
    floating values are left out, as doubles say them already; a column without values has NULLs.
    """
    df = normalize_missing(df)
    fields = numeric_fields(df, cols)
    kept = [(p, f, c, kind) for (p, f), (_, c, kind) in zip(fields, typed_columns(fields))
            if not isinstance(kind, T.DoubleType)]
    basics = range_basics(df, [(p, c) for p, _, c, _ in kept]) if kept else {}
    found = exact_quantiles(df, [(p, c, kind) for p, _, c, kind in kept], [0.0, *probs, 1.0, 0.5], basics)
    spread = median_distances([(p, c, kind) for p, _, c, kind in kept], {p: q[-1] for p, q in found.items()})
    mads = exact_quantiles(df, spread, [0.5])
    names = ["min", *(f"p{round(q * 100, 6):g}" for q in probs), "max"]
    rows = [(f.name, name, written_out(x)) for p, f, _, _ in kept
            for name, x in zip([*names, "mad"], [*found[p][:-1], mads[p][0] if p in mads else None])]
    return small_table(df.sparkSession, rows, EXACT_SCHEMA)


def written_out(x) -> str | None:
    """All digits of an exact number, without trailing zeros after the point."""
    if x is None:
        return None
    text = f"{x:f}" if isinstance(x, Decimal) else str(x)
    return (text.rstrip("0").rstrip(".") if "." in text else text) or "0"


def median_distances(cols: Sequence[tuple[int, Column, T.DataType]], medians: dict,
                     plain: Sequence[int] = ()) -> list[tuple[int, Column, T.DataType]]:
    """Distances from the median, in a decimal type that holds them; doubles where 38 digits do not, and for the
    positions in `plain`."""
    out = []
    for p, c, kind in cols:
        middle = medians[p]
        if middle is None:
            continue
        digits, scale = (kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else (19, 0)
        if p in plain or isinstance(kind, T.DoubleType) or digits + 2 > 38:
            out.append((p, F.abs(c.cast("double") - F.lit(float(middle))), T.DoubleType()))
        else:
            wide = T.DecimalType(digits + 2, scale + 1)  # a median lies at most half a unit beside the values
            distance = c.cast(wide) - F.lit(Decimal(middle)).cast(wide)
            out.append((p, F.abs(distance).cast(wide), wide))
    return out


MOMENTS = {
    "rows": lambda c: F.count("*"),
    "n": F.count,
    "mean": F.avg,
    "std": F.stddev_samp,
    "variance": F.var_samp,
    "min": F.min,
    "max": F.max,
    "low": lambda c: F.min(finite(c)),
    "high": lambda c: F.max(finite(c)),
}


def column_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, Row]:
    """Basic statistics per column from one pass, on the driver (one row per column).

    They choose columns, centre correlations and place histogram bins, so that these
    need no pass of their own.
    """
    df = normalize_missing(df)
    columns = _doubles(numeric_fields(df, cols))
    rows = per_column(df, columns, MOMENTS, fields=14).collect() if columns else []
    return {r.column: r for r in rows}


def numeric_basic_stats(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """mean, std, min and max, rounded to 4 digits, of all or the first k usable columns."""
    df = normalize_missing(df)
    fields = numeric_fields(df, cols)[:k]
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    rounded = {s: (lambda c, agg=agg: F.round(agg(c), 4)) for s, agg in stats.items()}
    return per_column(df, _doubles(fields), rounded, fields=7).drop("position")


def corr_columns(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """The columns by number of values, most first, ties in schema order; k keeps the first of them."""
    df = normalize_missing(df)
    counts = per_column(df, _doubles(numeric_fields(df, cols)), {"non_null": F.count}, fields=1)
    return _ranked(counts, F.col("non_null").desc(), k).select("column", "non_null", "rank")


def variance_rank(df: DataFrame, cols: Sequence[str], k: int | None = None) -> DataFrame:
    """Columns by sample variance, largest first, undefined last."""
    df = normalize_missing(df)
    table = per_column(df, _doubles(numeric_fields(df, cols)), {"variance": F.var_samp}, fields=3)
    table = table.withColumn("variance", F.nanvl("variance", F.lit(None).cast("double")))
    return _ranked(table, F.col("variance").desc_nulls_last(), k).select("column", "variance", "rank")


def _ranked(table: DataFrame, order: Column, k: int | None) -> DataFrame:
    # one row per column of the schema
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(order, "position"))
    ranked = table.withColumn("rank", rank)
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def sample_rows_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Opt-in random sample of n rows (all, if there are fewer); nothing else in the library samples."""
    return df.orderBy(F.rand(seed)).limit(n)


# --- correlation ------------------------------------------------------------


def pair_moments(df: DataFrame, pairs: Sequence[tuple[int, int]], exprs: dict[int, Column],
                 moments: dict[int, Row] | None = None) -> dict:
    """Pairwise-complete Pearson correlation of many pairs: {(x, y): (corr, n)}.

    A first pass takes count, mean, min and max of every column, unless `moments`
    brings them. Values are then centred, which makes plain sums numerically safe, and one scan
    reduces all pairs to sums, however many there are: complete columns that fit into one aggregate need a sum
    of products per pair; others are multiplied block by block of columns (see `gram`).
    """
    used = sorted({p for pair in pairs for p in pair})
    own = moments
    if own is None:
        stats = {k: MOMENTS[k] for k in ("rows", "n", "mean", "min", "max", "low", "high")}
        own = {r.position: r for r in per_column(df, [(p, str(p), exprs[p]) for p in used], stats, fields=8).collect()}
    products = sum(x != y for x, y in pairs)
    if all(own[p].n == own[p].rows for p in used) and products + 2 * len(used) <= AGG_FIELDS:
        z = df.select(*[(exprs[p] - F.lit(_centre(own[p]))).alias(f"z{p}") for p in used])
        sums = _complete_sums(z, pairs, used, own)
    else:
        filled = [(x, y) for x, y in pairs if own[x].n and own[y].n]
        sums = gram_sums(df, exprs, filled, {p: _frame(own[p]) for p in used}) if filled else {}
    return {pair: (_pearson(sums.get(pair), *pair), sums[pair]["n"] if pair in sums else 0) for pair in pairs}


def _frame(row) -> tuple[float, float]:
    """Centre and scale that bring the finite values of a column into -1 to 1 (a constant one to 0)."""
    if row.low is None:
        return 0.0, 1.0
    mean = row.mean if row.mean is not None and math.isfinite(row.mean) else row.low / 2 + row.high / 2
    centre = row.low if row.low == row.high else mean
    reach = max(abs(row.low / 2 - centre / 2), abs(row.high / 2 - centre / 2))
    return centre, max(reach, sys.float_info.min) * 2 if reach <= sys.float_info.max / 2 else reach


def _complete_sums(z: DataFrame, pairs: Sequence[tuple[int, int]], used: Sequence[int], own: dict) -> dict:
    aggs = [F.sum(f"z{p}").alias(f"s_{p}") for p in used]
    aggs += [F.sum(F.col(f"z{x}") * F.col(f"z{y}")).alias(f"xy_{x}_{y}") for x, y in pairs if x != y]
    aggs += [F.sum(F.col(f"z{p}") * F.col(f"z{p}")).alias(f"xy_{p}_{p}") for p in used]
    got = z.agg(*aggs).first().asDict()
    return {
        (x, y): {
            "n": own[x].n, "xy": got[f"xy_{x}_{y}"],
            "sx": got[f"s_{x}"], "sxx": got[f"xy_{x}_{x}"], "lox": own[x].min, "hix": own[x].max,
            "sy": got[f"s_{y}"], "syy": got[f"xy_{y}_{y}"], "loy": own[y].min, "hiy": own[y].max,
        }
        for x, y in pairs
    }


def _centre(row) -> float:
    """Mean of a column; its only value when it is constant."""
    if row.n == 0:
        return 0.0
    return row.min if row.min == row.max else row.mean


def _pearson(sums: dict | None, x: int, y: int) -> float | None:
    if sums is None or sums["n"] < 2 or sums.get("infinite") or sums["lox"] == sums["hix"] or sums["loy"] == sums["hiy"]:
        return None
    n = sums["n"]
    spread_x = sums["sxx"] - sums["sx"] * sums["sx"] / n
    spread_y = sums["syy"] - sums["sy"] * sums["sy"] / n
    if x == y:
        return 1.0 if math.isfinite(spread_x) else None
    covered = sums["xy"] - sums["sx"] * sums["sy"] / n
    below = math.sqrt(spread_x) * math.sqrt(spread_y) if min(spread_x, spread_y) > 0 else 0.0
    corr = covered / below if below else math.nan
    return None if math.isnan(corr) else max(-1.0, min(1.0, corr))


def pair_correlations(df: DataFrame, pairs: Sequence[tuple[str, str]],
                      moments: dict[str, Row] | None = None) -> dict[tuple[str, str], tuple[float | None, int]]:
    """(Pearson, complete rows) per pair of numeric columns, on the driver."""
    if not pairs:
        return {}
    df = normalize_missing(df)
    fields = {f.name: (p, f) for p, f in fields_of(df)}
    at = {c: fields[c][0] for pair in pairs for c in pair}
    exprs = {p: as_double(fields[c][1]) for c, p in at.items()}
    known = None if moments is None else {p: moments[c] for c, p in at.items()}
    found = pair_moments(df, list(dict.fromkeys((at[x], at[y]) for x, y in pairs)), exprs, known)
    return {(x, y): found[at[x], at[y]] for x, y in pairs}


def matrix_pairs(cols: Sequence[str]) -> list[tuple[str, str]]:
    """Diagonal and upper triangle."""
    return [(c, c) for c in cols] + list(combinations(cols, 2))


def matrix_rows(cols: Sequence[str], found: dict, undefined: float | None) -> list[tuple]:
    rows = []
    for x in cols:
        for y in cols:
            corr = found[(x, y) if (x, y) in found else (y, x)][0]
            rows.append((x, y, undefined if corr is None else corr))
    return rows


MATRIX_SCHEMA = "x string, y string, corr double"


def correlation_matrix(df: DataFrame, cols: Sequence[str], undefined: float | None = 0.0) -> DataFrame:
    """All cells (x, y, corr) of the Pearson matrix; undefined cells become 0."""
    names = [f.name for _, f in numeric_fields(df, cols)]
    found = pair_correlations(df, matrix_pairs(names))
    return small_table(df.sparkSession, matrix_rows(names, found, undefined), MATRIX_SCHEMA)


# --- histograms -------------------------------------------------------------


EDGE = 1e-14
TINY = 1e-290  # steps stay normal numbers


def nice_bins(low: float, high: float, max_bins: int = MAX_BINS) -> tuple[float, float, int]:
    """(start, step, number) of at most max_bins bins whose step is 1, 2 or 5 times a power of ten."""
    span = min(high - low, sys.float_info.max) or abs(low) or 1.0
    span = max(span, TINY)
    level = math.ceil(math.log10(max_bins))
    step = 10.0 ** (math.floor(math.log10(span) + 0.5) - level)
    while math.ceil(span / step) > max_bins:
        step *= 10
    for part in (5, 2):
        if span / (step / part) <= max_bins:
            step /= part
    digits = 0 if step >= 1 else int(-math.log10(step)) + 1
    first = math.floor(low / step + 10.0 ** (-digits - 1))
    first -= low < first * step
    return first * step, step, max(1, math.ceil(high / step) - first)


def numeric_histogram(df: DataFrame, cols: Sequence[str], max_bins: int = MAX_BINS,
                      moments: dict[str, Row] | None = None) -> DataFrame:
    """(column, bin_start, bin_end, cnt) of the non-empty bins, over all finite values.

    A value on the right edge belongs to the last bin.
    """
    df = normalize_missing(df)
    columns = _doubles(numeric_fields(df, cols))
    ranges = value_ranges(df, columns) if moments is None else [moments[name] for _, name, _ in columns]
    edges = {r.position: nice_bins(r.low, r.high, max_bins) for r in ranges if r.low is not None}
    return binned_counts(df, [c for c in columns if c[0] in edges], edges)


def value_ranges(df: DataFrame, columns: Sequence[tuple[int, str, Column]]) -> list:
    """Smallest and largest finite value per column, on the driver."""
    stats = {"low": lambda c: F.min(finite(c)), "high": lambda c: F.max(finite(c))}
    return per_column(df, columns, stats, fields=2).collect()


def bin_number(c: Column, start: float, step: float, bins: int) -> Column:
    """0-based bin of a finite value, NULL for others; the last bin includes its right edge."""
    place = (finite(c) - start) / F.lit(step) + EDGE
    return F.when(place.isNotNull(), F.floor(F.least(place, F.lit(bins - 1.0))).cast("int"))


def binned_counts(df: DataFrame, columns: Sequence[tuple[int, str, Column]],
                  edges: dict[int, tuple[float, float, int]]) -> DataFrame:
    """Count finite values per bin; `edges` holds start, step and number of bins."""
    schema = "column string, bin_start double, bin_end double, cnt bigint"
    if not columns:
        return small_table(df.sparkSession, [], schema)
    numbers = [
        F.struct(F.lit(i).alias("i"), bin_number(c, *edges[p]).alias("bin")) for i, (p, _, c) in enumerate(columns)
    ]
    counts = (
        df.select(F.inline(F.array(*numbers)))
        .filter(F.col("bin").isNotNull())
        .groupBy("i", "bin")
        .agg(F.count("*").alias("cnt"))
    )

    def per(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("i") + 1)

    start = per([edges[p][0] for p, _, _ in columns])
    step = per([edges[p][1] for p, _, _ in columns])
    return counts.select(
        per([n for _, n, _ in columns]).alias("column"),
        (start + F.col("bin") * step).alias("bin_start"),
        (start + (F.col("bin") + 1) * step).alias("bin_end"),
        "cnt",
    )


def by_count(moments: dict[str, Row], cols: Sequence[str], k: int | None = None) -> list[str]:
    """The columns by number of values, most first, ties in schema order."""
    return sorted(cols, key=lambda c: (-moments[c].n, moments[c].position))[:k]


def by_variance(moments: dict[str, Row], cols: Sequence[str], k: int | None = None) -> list[str]:
    """The columns by variance, largest first, undefined ones last."""

    def spread(c: str) -> float:
        v = moments[c].variance
        return -math.inf if v is None or math.isnan(v) else v

    return sorted(cols, key=lambda c: (-spread(c), moments[c].position))[:k]


def numeric(df: DataFrame, cols: Sequence[str], id_like: Sequence[str] = (),
            moments: dict[str, Row] | None = None, correlations: dict | None = None,
            stat_cols: int | None = None, corr_cols: int | None = None,
            histograms: int | None = None) -> dict[str, DataFrame]:
    """Numeric pack: basic stats, correlation matrix, histograms; the last three arguments limit their columns.

    One pass for the moments, one for the correlations and one when the histogram is
    read; `moments` and `correlations` at hand save theirs.
    """
    spark = df.sparkSession
    df = normalize_missing(df)
    if not cols:
        return {"skip": _skip(spark, "No numeric columns.")}
    usable = usable_columns(df, cols, id_like)
    if not usable:
        return {"skip": _skip(spark, "No usable numeric columns (numeric columns look like IDs).")}
    moments = column_moments(df, usable) if moments is None else moments
    chosen = by_count(moments, usable, corr_cols)
    if correlations is None:
        correlations = pair_correlations(df, matrix_pairs(chosen), moments)
    stats = [(c, *[moments[c][k] for k in ("mean", "std", "min", "max")]) for c in usable[:stat_cols]]
    table = small_table(spark, stats, "column string, mean double, std double, min double, max double")
    return {
        "numeric_cols": small_table(spark, [(c,) for c in usable[:corr_cols]], "column string"),
        "basic_stats": table.withColumns({c: F.round(c, 4) for c in ("mean", "std", "min", "max")}),
        "correlation_matrix": small_table(spark, matrix_rows(chosen, correlations, 0.0), MATRIX_SCHEMA),
        "histogram": numeric_histogram(df, by_variance(moments, usable, histograms), moments=moments),
    }


def _skip(spark, reason: str) -> DataFrame:
    return small_table(spark, [("numeric", reason)], "pack string, skipped string")
