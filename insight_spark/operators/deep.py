"""Deep profile: the numbers behind a full profiling report, as tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import (
    as_double,
    col,
    compact_key,
    fields_of,
    is_datetime,
    is_string,
    name_at,
    normalize_missing,
    per_column,
)
from insight_spark.functions.datetimes import as_timestamp
from insight_spark.functions.tables import small_table
from insight_spark.operators.duplicates import repeated_groups
from insight_spark.operators.extremes import edge_counts
from insight_spark.operators.frequency import column_counts, top_values, value_family, value_frequencies
from insight_spark.operators.numeric import (
    MOMENTS,
    TINY,
    as_float,
    bin_number,
    binned_counts,
    correlation_matrix,
    describe_fields,
    median_distances,
    numeric_fields,
    pair_correlations,
    value_ranges,
)
from insight_spark.operators.profile import column_roles, duplicate_rows, sample_rows
from insight_spark.operators.quantiles import RANGE_STATS, exact_quantiles, typed_columns
from insight_spark.operators.timeseries import detect_format
from insight_spark.sources.scratch import ensure_checkpoint_dir

BINS = 50
INTERACTION_BINS = 20
CATEGORY_VALUES = 50
CATEGORY_SHARE = 0.5
URL = r"^https?://"
# fixed values: Unicode white space and ASCII punctuation
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _text_columns(df: DataFrame, cols: Sequence[str] | None) -> list[tuple[int, T.StructField]]:
    return [(p, f) for p, f in fields_of(df, cols) if is_string(f.dataType)]


# --- overview and types -----------------------------------------------------


TYPE_SCHEMA = "column string, position int, n_rows bigint, missing bigint, n_unique bigint, type string"


def variable_types(df: DataFrame) -> DataFrame:
    """(column, position, n_rows, missing, n_unique, type) per column.

    Strings with few values are categorical, the others text, or url when every
    value starts with http:// or https://.
    """
    df = normalize_missing(df)
    roles = column_roles(df)
    texts = [(p, f.name, col(f.name)) for p, f in _text_columns(df, None)]
    is_url = F.lit(False)
    if texts:
        stats = {"urls": lambda c: F.count_if(c.rlike(URL)), "filled": F.count}
        urls = per_column(df, texts, stats, fields=2).select("position", "urls", "filled")
        roles = roles.join(urls, "position", "left")
        is_url = (F.col("filled") > 0) & (F.col("urls") == F.col("filled"))
    non_null = F.greatest(F.col("n_rows") - F.col("missing"), F.lit(1))
    few = (F.col("n_unique") <= CATEGORY_VALUES) & (
        (F.col("n_unique") / non_null <= CATEGORY_SHARE) | (F.col("n_unique") == 1)
    )
    kind = (
        F.when(F.col("dtype") == "boolean", F.lit("boolean"))
        .when(F.col("datetime"), F.lit("datetime"))
        .when(F.col("numeric"), F.lit("numeric"))
        .when(F.col("categorical") & is_url, F.lit("url"))
        .when(F.col("categorical") & few, F.lit("categorical"))
        .when(F.col("categorical"), F.lit("text"))
        .otherwise(F.lit("unsupported"))
    )
    return roles.select("column", "position", "n_rows", "missing", "n_unique", kind.alias("type"))


# fixed values: variable types
TYPES = ("numeric", "boolean", "datetime", "categorical", "text", "url", "unsupported")


def overview(df: DataFrame, types: DataFrame | None = None, copies: DataFrame | None = None) -> DataFrame:
    """One row: size, missing cells, duplicate rows, number of columns by type.

    `types` and `copies` at hand save their passes.
    """
    types = (variable_types(df) if types is None else types).agg(
        F.max("n_rows").alias("rows"),
        F.count("*").alias("columns"),
        F.sum("missing").alias("missing_cells"),
        *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES],
    )
    # two one-row tables side by side, without a join
    both = types.unionByName(duplicate_rows(df) if copies is None else copies, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    cells = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    return both.select(
        "rows",
        "columns",
        "missing_cells",
        (F.col("missing_cells") / cells * 100.0).alias("missing_pct"),
        "duplicate_rows",
        (F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)) * 100.0).alias("duplicate_pct"),
        *[f"n_{t}" for t in TYPES],
    )


# --- numeric ----------------------------------------------------------------

NUMERIC_SCHEMA = (
    "column string, count bigint, missing bigint, n_unique bigint, n_infinite bigint, n_zeros bigint, "
    "n_negative bigint, mean double, std double, variance double, cv double, min double, max double, "
    "range double, sum double, p5 double, p25 double, median double, p75 double, p95 double, iqr double, "
    "mad double, skewness double, kurtosis double"
)


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Moments, quantiles, spread and counts per numeric column.

    Skewness and kurtosis carry the small-sample correction; kurtosis is in excess
    of a normal distribution. `mad` is the median absolute deviation from the median.
    """
    df = normalize_missing(df)
    fields = describe_fields(df) if cols is None else numeric_fields(df, cols)
    columns = [(p, f.name, as_double(f)) for p, f in fields]
    stats = {
        "rows": lambda c: F.count("*"),
        "n_zeros": lambda c: F.count_if(c == 0),
        "n_negative": lambda c: F.count_if(c < 0),
        "mean": F.avg,
        "variance": F.var_samp,
        "total": F.sum,
        "skewness": F.skewness,
        "kurtosis": F.kurtosis,
        "min": F.min,
        "max": F.max,
    }
    basics = per_column(df, columns, stats | RANGE_STATS, fields=27).collect()
    unique = {r.position: r.n_unique for r in column_counts(df, [f.name for _, f in fields]).collect()}
    ranges = {r.position: r.asDict() for r in basics}
    typed = typed_columns(fields)
    quantiles = exact_quantiles(df, typed, [0.05, 0.25, 0.5, 0.75, 0.95], ranges)
    medians = {p: q[2] for p, q in quantiles.items()}
    # halves of such integers are doubles; results are doubles anyway
    plain = [p for p, r in ranges.items() if r["finite"] and max(abs(r["low"]), abs(r["high"])) < 2**51]
    mads = exact_quantiles(df, median_distances(typed, medians, plain), [0.5])
    rows = []
    for r in basics:
        n = r.finite + r.neg_inf + r.pos_inf
        p5, p25, p50, p75, p95 = map(as_float, quantiles[r.position])
        std = None if r.variance is None else math.sqrt(r.variance)
        rows.append((
            r.column, n, r.rows - n, unique[r.position], r.neg_inf + r.pos_inf, r.n_zeros, r.n_negative,
            r.mean, std, r.variance, std / r.mean if std is not None and r.mean else None,
            r.min, r.max, r.max - r.min if n else None, r.total, p5, p25, p50, p75, p95,
            p75 - p25 if n else None, as_float(mads[r.position][0]) if r.position in mads else None,
            _sample_skewness(r.skewness, n, r.variance), _sample_kurtosis(r.kurtosis, n, r.variance),
        ))
    return small_table(df.sparkSession, rows, NUMERIC_SCHEMA)


def _sample_skewness(g: float | None, n: int, variance: float | None) -> float | None:
    if n < 3:
        return None
    if variance == 0:
        return 0.0
    return None if g is None else g * math.sqrt(n * (n - 1)) / (n - 2)


def _sample_kurtosis(g: float | None, n: int, variance: float | None) -> float | None:
    if n < 4:
        return None
    if variance == 0:
        return 0.0
    return None if g is None else (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """Equal-width bins between the smallest and largest finite value."""
    df = normalize_missing(df)
    columns = [(p, f.name, as_double(f)) for p, f in numeric_fields(df, cols)]
    edges = _equal_edges(df, columns, bins)
    return binned_counts(df, [c for c in columns if c[0] in edges], edges)


def _equal_edges(df: DataFrame, columns: Sequence[tuple[int, str, Column]], bins: int) -> dict:
    edges = {}
    for r in value_ranges(df, columns):
        if r.low is not None:
            low, high = (r.low, r.high) if r.high - r.low > TINY else (r.low - 0.5, r.high + 0.5)
            edges[r.position] = low, (high - low) / bins, bins
    return edges


EXTREMES_SCHEMA = "column string, side string, rank int, value double, exact string, cnt bigint"


def extreme_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(column, side, rank, value, exact, cnt): the k smallest and largest values with counts.

    Values are told apart, ordered and counted in their own type: `exact` writes out integers and decimals, of which
    the double in `value` may have lost digits; it is NULL for floating values. No frequency table is made: tasks
    send their k outermost values, and only rows at or beyond the bounds these give are counted (see `extremes`).
    """
    df = normalize_missing(df)
    families: dict[str, tuple[T.DataType, list[T.StructField]]] = {}
    for _, f in numeric_fields(df, cols):
        kind = value_family(T.IntegerType() if isinstance(f.dataType, T.BooleanType) else f.dataType)
        families.setdefault(kind.json(), (kind, []))[1].append(f)
    parts = []
    for kind, fields in families.values():
        floating = isinstance(kind, T.DoubleType)
        # adding zero makes one value of both zeros
        numbers = [col(f.name).cast("int").cast(kind) if isinstance(f.dataType, T.BooleanType) else col(f.name).cast(kind)
                   for f in fields]
        counted = edge_counts(
            df.select(*[(c + F.lit(0.0) if floating else c).alias(f"e{i}") for i, c in enumerate(numbers)]), k)
        value = F.col("value")
        exact = F.lit(None).cast("string") if floating else value.cast("string")
        for side, order in (("smallest", value.asc()), ("largest", value.desc())):
            rank = F.row_number().over(Window.partitionBy("i").orderBy(order))
            parts.append(counted.withColumn("rank", rank).filter(F.col("rank") <= k).select(
                name_at(F.col("i"), [f.name for f in fields]).alias("column"), F.lit(side).alias("side"), "rank",
                value.cast("double").alias("value"), exact.alias("exact"), "cnt",
            ))
    return reduce(DataFrame.unionByName, parts) if parts else small_table(df.sparkSession, [], EXTREMES_SCHEMA)


# --- values, text, dates, urls ----------------------------------------------


def common_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """(column, value, cnt, share): most frequent values and their share of the non-missing ones."""
    cols = list(df.columns if cols is None else cols)
    return (
        top_values(df, cols, k)
        .filter("rank is not null")
        .select("column", "value", "cnt", (F.col("cnt") / F.col("non_null")).alias("share"), "rank")
    )


def text_length(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, count, min, max, mean, median, total) of the lengths in characters."""
    fields = _text_columns(df, cols)
    columns = [(p, f.name, F.length(col(f.name)).cast("double")) for p, f in fields]
    stats = {"mean": F.avg, "total": F.sum}
    basics = per_column(df, columns, stats | RANGE_STATS, fields=8).collect()
    medians = exact_quantiles(
        df, [(p, c) for p, _, c in columns], [0.5], {r.position: r.asDict() for r in basics}
    )

    def whole(x: float | None) -> int | None:
        return None if x is None else int(x)

    rows = [
        (r.column, r.finite, whole(r.low), whole(r.high), r.mean, medians[r.position][0], whole(r.total))
        for r in basics
    ]
    schema = "column string, count bigint, min bigint, max bigint, mean double, median double, total bigint"
    return small_table(df.sparkSession, rows, schema)


def _exploded_counts(df: DataFrame, fields: Sequence[tuple[int, T.StructField]], pieces, name: str) -> DataFrame:
    """Count the pieces of each text; equal pieces fold before the shuffle."""
    parts = []
    for p, f in fields:
        rows = df.filter(col(f.name).isNotNull()).select(
            F.lit(f.name).alias("column"), F.explode(pieces(col(f.name))).alias(name)
        )
        parts.append(rows)
    if not parts:
        return small_table(df.sparkSession, [], f"column string, {name} string, cnt bigint")
    return reduce(DataFrame.unionByName, parts)


def word_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, word, cnt): lower-case words at white space, outer punctuation removed."""
    split = _exploded_counts(df, _text_columns(df, cols), lambda c: F.split(F.lower(c), SPACE), "word")
    words = split.select("column", F.btrim("word", F.lit(PUNCTUATION)).alias("word")).filter("word != ''")
    return words.groupBy("column", "word").agg(F.count("*").alias("cnt"))


def char_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, char, cnt) of every character."""
    chars = _exploded_counts(df, _text_columns(df, cols), lambda c: F.split(c, ""), "char")
    return chars.filter("char != ''").groupBy("column", "char").agg(F.count("*").alias("cnt"))


def _datetimes(df: DataFrame, cols: Sequence[str] | None) -> list[tuple[str, Column]]:
    """Datetime columns as timestamps: native ones, and text ones named in `cols` by the format they are read with."""
    out = []
    for _, f in fields_of(df, cols):
        if is_datetime(f.dataType):
            out.append((f.name, col(f.name).cast("timestamp_ntz")))
        elif cols is not None and is_string(f.dataType):
            out.append((f.name, as_timestamp(col(f.name), f.dataType, detect_format(df, f.name))))
    return out


def datetime_range(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, count, min, max, range_days) of datetime columns, native or text that reads as one."""
    parts = []
    for name, c in _datetimes(df, cols):
        ends = df.agg(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"))
        parts.append(ends.withColumn("column", F.lit(name)))
    if not parts:
        schema = "column string, count bigint, min timestamp_ntz, max timestamp_ntz, range_days double"
        return small_table(df.sparkSession, [], schema)
    days = F.timestamp_diff("SECOND", F.col("min"), F.col("max")) / 86400.0
    out = reduce(DataFrame.unionByName, parts)
    return out.select("column", "count", "min", "max", days.alias("range_days"))


def datetime_histogram(df: DataFrame, cols: Sequence[str] | None = None, unit: str = "month") -> DataFrame:
    """(column, start, cnt) per calendar unit."""
    parts = [
        df.select(F.lit(name).alias("column"), F.date_trunc(unit, c).cast("date").alias("start"))
        for name, c in _datetimes(df, cols)
    ]
    if not parts:
        return small_table(df.sparkSession, [], "column string, start date, cnt bigint")
    rows = reduce(DataFrame.unionByName, parts).filter("start is not null")
    return rows.groupBy("column", "start").agg(F.count("*").alias("cnt"))


def url_parts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, part, value, cnt) for scheme, host and path of each URL."""
    parts = []
    for _, f in _text_columns(df, cols):
        c = col(f.name)
        wide = df.select(
            F.try_parse_url(c, F.lit("PROTOCOL")).alias("scheme"),
            F.try_parse_url(c, F.lit("HOST")).alias("host"),
            F.try_parse_url(c, F.lit("PATH")).alias("path"),
        )
        long = wide.unpivot([], ["scheme", "host", "path"], "part", "value").filter("value is not null")
        parts.append(long.withColumn("column", F.lit(f.name)))
    if not parts:
        return small_table(df.sparkSession, [], "column string, part string, value string, cnt bigint")
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("column", "part", "value").agg(F.count("*").alias("cnt"))


# --- association ------------------------------------------------------------

BROADCAST_VALUES = 100_000  # rows of all rank tables together that one broadcast holds, by their counted sizes


def _average_ranks(freq: DataFrame) -> DataFrame:
    """(key, value, cnt, rank, total): average rank of each distinct value of a key.

    Values are range-partitioned, so no key is sorted in one task; each partition
    adds the row count of the partitions before it. The first checkpoint fixes which
    partition a value is in, the second keeps the ranks for their several readers.
    """
    ensure_checkpoint_dir(freq.sparkSession)
    placed = (
        freq.repartitionByRange("key", "value").withColumn("part", F.spark_partition_id()).checkpoint()
    )
    parts = placed.groupBy("key", "part").agg(F.sum("cnt").alias("rows"))
    by_key = Window.partitionBy("key")  # one row per partition
    before = by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "key",
        "part",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(by_key).alias("total"),
    )
    inside = Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("offset") + F.coalesce(F.sum("cnt").over(inside), F.lit(0))
    ranks = placed.join(offsets, ["key", "part"]).select(
        "key",
        "value",
        "cnt",
        (below + (F.col("cnt") + 1) / 2.0).alias("rank"),
        "total",
    )
    return ranks.checkpoint()


def spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, corr, n): rank correlation of every pair over its complete rows.

    Ties take the average rank. A column has one rank table, and one more for each
    other column with missing values. With centred ranks a and b the wanted sum of a b
    over the rows is the sum over distinct values of the first column of a times the
    sum of their b: rows meet only the ranks of the column with fewer values and fold
    to one row per value of the other before they meet its ranks. Rank tables that together have at most
    `BROADCAST_VALUES` rows, by count, meet the rows where they lie; pairs with larger ones fold to one row per pair
    of values first and take a shuffle join, which adaptive execution splits where a value has many partners.
    """
    df = normalize_missing(df)
    spark = df.sparkSession
    schema = "x string, y string, corr double, n bigint"
    fields = numeric_fields(df, cols)
    pairs = list(combinations(range(len(fields)), 2))
    if not pairs:
        return small_table(spark, [], schema)
    values = df.select(*[as_double(f).alias(f"v{i}") for i, (_, f) in enumerate(fields)])
    stats = {"n": F.count, "rows": lambda c: F.count("*")}
    counts = per_column(values, [(i, str(i), F.col(f"v{i}")) for i in range(len(fields))], stats, fields=2).collect()
    full = {r.position: r.n == r.rows for r in counts}

    def table_of(i: int, other: int) -> tuple[int, int | None]:
        return i, None if full[other] else other

    tables = list(dict.fromkeys(t for i, j in pairs for t in (table_of(i, j), table_of(j, i))))
    key = {t: k for k, t in enumerate(tables)}

    def ranked_value(i: int, other: int | None) -> Column:
        return F.col(f"v{i}") if other is None else F.when(F.col(f"v{other}").isNotNull(), F.col(f"v{i}"))

    members = [F.struct(F.lit(k).alias("key"), ranked_value(*t).alias("value")) for t, k in key.items()]
    freq = values.select(F.inline(F.array(*members))).filter("value is not null")
    freq = freq.groupBy("key", "value").agg(F.count("*").alias("cnt"))
    n = F.col("total")
    z = (F.col("rank") - (n + 1) / 2.0) / n  # -0.5 .. 0.5
    ranks = _average_ranks(freq).select("key", "value", "cnt", "total", z.alias("z"))
    # one row per rank table
    own = {
        r.key: r
        for r in ranks.groupBy("key")
        .agg(F.sum(F.col("cnt") * F.col("z") * F.col("z")).alias("squares"), F.max("total").alias("n"),
             F.count("*").alias("size"))
        .collect()
    }

    cells: dict[int, list[Column]] = {}  # by the rank table that the rows meet
    for number, (i, j) in enumerate(pairs):
        sides = [(key[table_of(i, j)], i), (key[table_of(j, i)], j)]
        sides.sort(key=lambda s: own[s[0]].size if s[0] in own else 0)
        (few, few_col), (many, many_col) = sides
        if few in own:
            cells.setdefault(few, []).append(F.struct(
                F.lit(number).alias("pair"), F.lit(few).alias("key"), F.col(f"v{few_col}").alias("value"),
                F.lit(many).alias("to_key"), F.col(f"v{many_col}").alias("to_value"),
            ))
    small, held = [], 0
    for few in sorted(cells, key=lambda k: own[k].size):
        held += own[few].size
        if held <= BROADCAST_VALUES:
            small.append(few)
    large = [few for few in cells if few not in small]

    def rows_of(keys: list[int]) -> DataFrame:
        members = [c for k in keys for c in cells[k]]
        return values.select(F.inline(F.array(*members))).filter("value is not null and to_value is not null")

    on = ["key", "value"]
    scored = []
    if small:
        near = ranks.filter(F.col("key").isin(small)).select("key", "value", "z")
        scored.append(rows_of(small).join(F.broadcast(near), on).select("pair", "to_key", "to_value", "z"))
    if large:
        cnt = rows_of(large).groupBy("pair", "key", "value", "to_key", "to_value").agg(F.count("*").alias("cnt"))
        met = cnt.join(ranks.select("key", "value", "z"), on)
        scored.append(met.select("pair", "to_key", "to_value", (F.col("cnt") * F.col("z")).alias("z")))
    if not scored:
        return small_table(spark, [], schema)
    folded = reduce(DataFrame.unionByName, scored).groupBy("pair", "to_key", "to_value").agg(F.sum("z").alias("b"))
    to = ranks.select(F.col("key").alias("to_key"), F.col("value").alias("to_value"), F.col("z").alias("a"))
    crossed = folded.join(to, ["to_key", "to_value"]).groupBy("pair").agg(F.sum(F.col("a") * F.col("b")).alias("ab"))

    def per_pair(of) -> Column:
        return F.element_at(F.array(*[F.lit(of(i, j)) for i, j in pairs]), F.col("pair") + 1)

    def squares(i: int, other: int) -> float:
        k = key[table_of(i, other)]
        return own[k].squares if k in own else 0.0

    spread = per_pair(lambda i, j: math.sqrt(squares(i, j)) * math.sqrt(squares(j, i)))
    total = per_pair(lambda i, j: own[key[table_of(i, j)]].n if key[table_of(i, j)] in own else 0)
    return crossed.select(
        per_pair(lambda i, j: fields[i][1].name).alias("x"),
        per_pair(lambda i, j: fields[j][1].name).alias("y"),
        F.when(spread > 0, F.col("ab") / spread).alias("corr"),
        total.cast("bigint").alias("n"),
    )


def cramers_v(df: DataFrame, cols: Sequence[str], max_values: int | None = None) -> DataFrame:
    """(x, y, v, n): bias-corrected association of categorical pairs.

    Cells are counted with map-side folding, their row and column sums by grouping cells, so columns of any
    number of values take part; `max_values` leaves out columns with more.
    """
    df = normalize_missing(df)
    spark = df.sparkSession
    counts = {r.position: r.n_unique for r in column_counts(df, cols).collect()}
    fields = [(p, f) for p, f in fields_of(df, cols) if 0 < counts[p] and (max_values is None or counts[p] <= max_values)]
    pairs = list(combinations(range(len(fields)), 2))
    if not pairs:
        return small_table(spark, [], "x string, y string, v double, n bigint")
    texts = df.select(*[col(f.name).cast("string").alias(f"v{i}") for i, (_, f) in enumerate(fields)])
    cells = (
        texts.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("pair"), F.col(f"v{i}").alias("a"), F.col(f"v{j}").alias("b"))
                        for n, (i, j) in enumerate(pairs)
                    ]
                )
            )
        )
        .filter("a is not null and b is not null")
        .groupBy("pair", "a", "b")
        .agg(F.count("*").cast("double").alias("o"))
    )
    in_row = cells.groupBy("pair", "a").agg(F.sum("o").alias("r"))
    in_col = cells.groupBy("pair", "b").agg(F.sum("o").alias("c"))
    sums = (
        cells.join(in_row, ["pair", "a"]).join(in_col, ["pair", "b"])
        .groupBy("pair")
        .agg(
            F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"),
            F.sum("o").alias("n"),
            F.count_distinct("a").alias("ra"),
            F.count_distinct("b").alias("cb"),
        )
    )
    n = F.greatest(F.col("n") - 1, F.lit(1.0))
    ra, cb = F.col("ra"), F.col("cb")
    phi2 = F.greatest(F.lit(0.0), F.col("s") - 1 - (ra - 1) * (cb - 1) / n)
    smaller = F.least(ra - (ra - 1) * (ra - 1) / n - 1, cb - (cb - 1) * (cb - 1) / n - 1)
    v = F.when(smaller > 0, F.sqrt(phi2 / smaller))
    names = [(fields[i][1].name, fields[j][1].name) for i, j in pairs]
    return sums.select(
        name_at(F.col("pair"), [x for x, _ in names]).alias("x"),
        name_at(F.col("pair"), [y for _, y in names]).alias("y"),
        v.alias("v"),
        F.col("n").cast("bigint").alias("n"),
    )


def interactions(df: DataFrame, cols: Sequence[str], bins: int = INTERACTION_BINS) -> DataFrame:
    """(x, y, x_start, y_start, cnt): two-dimensional histogram of every numeric pair."""
    df = normalize_missing(df)
    columns = [(p, f.name, as_double(f)) for p, f in numeric_fields(df, cols)]
    edges = _equal_edges(df, columns, bins)
    columns = [c for c in columns if c[0] in edges]
    pairs = list(combinations(range(len(columns)), 2))
    schema = "x string, y string, x_start double, y_start double, cnt bigint"
    if not pairs:
        return small_table(df.sparkSession, [], schema)
    binned = df.select(*[bin_number(c, *edges[p]).alias(f"b{i}") for i, (p, _, c) in enumerate(columns)])
    cells = [
        F.struct(F.lit(n).alias("pair"), F.col(f"b{i}").alias("bx"), F.col(f"b{j}").alias("by"))
        for n, (i, j) in enumerate(pairs)
    ]
    counts = (
        binned.select(F.inline(F.array(*cells)))
        .filter("bx is not null and by is not null")
        .groupBy("pair", "bx", "by")
        .agg(F.count("*").alias("cnt"))
    )

    def per(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pair") + 1)

    def start(side: int, number: str) -> Column:
        ends = [edges[columns[pair[side]][0]] for pair in pairs]
        return per([e[0] for e in ends]) + F.col(number) * per([e[1] for e in ends])

    return counts.select(
        per([columns[i][1] for i, _ in pairs]).alias("x"),
        per([columns[j][1] for _, j in pairs]).alias("y"),
        start(0, "bx").alias("x_start"),
        start(1, "by").alias("y_start"),
        "cnt",
    )


def nullity_correlation(df: DataFrame) -> DataFrame:
    """(x, y, corr) of the missing flags of columns with some but not all values missing.

    Flags need only counts: rows, missing per column, missing in both. Rows fold to one per combination of
    missing columns, in one scan; pairs are counted on that table.
    """
    df = normalize_missing(df)
    spark = df.sparkSession
    names = [f.name for _, f in fields_of(df)]
    flags = [F.when(col(c).isNull(), F.lit(i)) for i, c in enumerate(names)]
    patterns = df.groupBy(F.array_compact(F.array(*flags)).alias("missing")).agg(F.count("*").alias("cnt"))
    # one row per pair of columns; -1 stands for any row
    pairs = (
        patterns.withColumn("missing", F.concat(F.array(F.lit(-1)), "missing"))
        .select("missing", "cnt", F.explode("missing").alias("x"))
        .select("x", "cnt", F.explode("missing").alias("y"))
        .filter("x <= y")
        .groupBy("x", "y")
        .agg(F.sum("cnt").alias("cnt"))
    )
    both = {(r.x, r.y): r.cnt for r in pairs.collect()}
    n = both.get((-1, -1), 0)
    missing = {i: both[i, i] for i in range(len(names)) if 0 < both.get((i, i), 0) < n}
    rows = []
    for i, a in missing.items():
        for j, b in missing.items():
            covered = n * both.get((min(i, j), max(i, j)), 0) - a * b
            spread = math.sqrt(a * (n - a)) * math.sqrt(b * (n - b))
            rows.append((names[i], names[j], covered / spread))
    return small_table(spark, rows, "x string, y string, corr double")


def nullity_patterns(df: DataFrame) -> DataFrame:
    """(missing_columns, n_missing, cnt): rows per combination of missing columns."""
    df = normalize_missing(df)
    flags = [F.when(col(c).isNull(), F.lit(c)) for c in df.columns]
    pattern = F.concat_ws(",", *flags)
    missing = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    return df.groupBy(pattern.alias("missing_columns"), missing.alias("n_missing")).agg(F.count("*").alias("cnt"))


def samples(df: DataFrame, order_by: Sequence[str], k: int = 10) -> DataFrame:
    """First and last k rows by the given columns, tagged head and tail."""
    head = sample_rows(df, k, order_by).withColumn("part", F.lit("head"))
    return head.unionByName(sample_rows(df, k, order_by, tail=True).withColumn("part", F.lit("tail")))


def duplicate_groups(df: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent repeated rows with their count.

    Only rows whose digest repeats are shuffled whole (see `duplicates`). Ties go by the columns in their
    order, long texts by digest; maps are left out of that order, as they have none.
    """
    df = normalize_missing(df)
    order = [
        (compact_key(F.col(f"v{i}")) if is_string(f.dataType) else F.col(f"v{i}"))
        for i, f in enumerate(df.schema.fields) if "map<" not in f.dataType.simpleString()
    ]
    top = repeated_groups(df).orderBy(F.col("cnt").desc(), *order).limit(k)
    return top.toDF(*df.columns, "n_duplicates")


# --- alerts -----------------------------------------------------------------

# fixed values: default thresholds
THRESHOLDS = {
    "cardinality": 50,
    "missing": 0.05,
    "zeros": 0.1,
    "infinite": 0.0,
    "skewness": 20.0,
    "imbalance": 0.5,
    "correlation": 0.9,
}


def imbalance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, imbalance): 0 for evenly used values, towards 1 for one dominant value."""
    sums = value_frequencies(df, cols).groupBy("column").agg(
        F.sum("cnt").alias("n"), F.count("*").alias("k"), F.sum(F.col("cnt") * F.ln("cnt")).alias("s")
    )
    entropy = F.ln("n") - F.col("s") / F.col("n")
    return sums.filter("k > 1").select("column", (1 - entropy / F.ln("k")).alias("imbalance"))


def alerts(df: DataFrame, thresholds: dict | None = None, types: DataFrame | None = None,
           copies: DataFrame | None = None) -> DataFrame:
    """(column, alert, value) from rules over the profile tables.

    `types` and `copies` at hand save their passes.
    """
    limit = THRESHOLDS | (thresholds or {})
    df = normalize_missing(df)
    spark = df.sparkSession
    types = (variable_types(df) if types is None else types).collect()  # one row per column
    rows: list[tuple] = []
    for r in types:
        if r.n_unique == 1:
            rows.append((r.column, "constant", 1.0))
        if r.n_rows > 1 and r.n_unique == r.n_rows:
            rows.append((r.column, "unique", float(r.n_unique)))
        if r.type in ("categorical", "text", "url") and r.n_unique > limit["cardinality"]:
            rows.append((r.column, "high_cardinality", float(r.n_unique)))
        share = r.missing / max(r.n_rows, 1)
        if share > limit["missing"]:
            rows.append((r.column, "missing", share))
    numeric_cols = [r.column for r in types if r.type == "numeric"]
    stats = MOMENTS | {
        "zeros": lambda c: F.count_if(c == 0),
        "infinite": lambda c: F.count_if(F.abs(c) == float("inf")),
        "skewness": F.skewness,
    }
    fields = numeric_fields(df, numeric_cols)
    columns = [(p, f.name, as_double(f)) for p, f in fields]
    moments = {r.column: r for r in per_column(df, columns, stats, fields=20).collect()} if columns else {}
    for r in moments.values():
        if r.n and r.zeros / r.n > limit["zeros"]:
            rows.append((r.column, "zeros", r.zeros / r.n))
        if r.n and r.infinite / r.n > limit["infinite"]:
            rows.append((r.column, "infinite", r.infinite / r.n))
        skew = _sample_skewness(r.skewness, r.n, r.variance)
        if skew is not None and abs(skew) > limit["skewness"]:
            rows.append((r.column, "skewed", skew))
    categories = [r.column for r in types if r.type in ("categorical", "boolean")]
    for r in imbalance(df, categories).collect() if categories else []:
        if r.imbalance > limit["imbalance"]:
            rows.append((r.column, "imbalance", r.imbalance))
    if len(numeric_cols) > 1:
        pairs = list(combinations(sorted(numeric_cols), 2))
        for (x, y), (corr, _) in pair_correlations(df, pairs, moments).items():
            if corr is not None and abs(corr) > limit["correlation"]:
                rows.append((f"{x},{y}", "high_correlation", corr))
    repeated = (duplicate_rows(df) if copies is None else copies).first().duplicate_rows
    if repeated:
        rows.append((None, "duplicates", float(repeated)))
    return small_table(spark, rows, "column string, alert string, value double")


def deep_profile(df: DataFrame, order_by: Sequence[str] | None = None,
                 pair_cols: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All tables of the deep profile that apply to the columns of a table.

    Rank correlations and interactions grow with the pairs of numeric columns;
    `pair_cols` names the columns to pair on a wide table, by default all.
    """
    df = normalize_missing(df)
    spark = df.sparkSession
    # one row per column and one number, read once for all tables that need them
    listed = variable_types(df).orderBy("position").collect()
    types = small_table(spark, [tuple(r) for r in listed], TYPE_SCHEMA)
    copies = small_table(spark, [tuple(duplicate_rows(df).first())], "duplicate_rows bigint")
    kinds = {r.column: r.type for r in listed}

    def of(*wanted: str) -> list[str]:
        return [c for c in df.columns if kinds[c] in wanted]

    tables = {
        "overview": overview(df, types, copies),
        "variable_types": types,
        "nullity_correlation": nullity_correlation(df),
        "nullity_patterns": nullity_patterns(df),
        "duplicate_groups": duplicate_groups(df),
        "alerts": alerts(df, types=types, copies=copies),
    }
    if order_by:
        tables["samples"] = samples(df, order_by)
    numbers, texts, categories = of("numeric"), of("text", "categorical", "url"), of("categorical", "boolean")
    if numbers:
        tables |= {
            "numeric": numeric_profile(df, numbers),
            "histogram": histogram(df, numbers),
            "extreme_values": extreme_values(df, numbers),
            "correlation": correlation_matrix(df, numbers, undefined=None),
        }
    paired = numbers if pair_cols is None else [c for c in numbers if c in pair_cols]
    if len(paired) > 1:
        tables |= {"spearman": spearman(df, paired), "interactions": interactions(df, paired)}
    if categories or texts:
        tables["common_values"] = common_values(df, list(dict.fromkeys(categories + texts)))
    if len(categories) > 1:
        tables["cramers_v"] = cramers_v(df, categories)
    if texts:
        tables |= {
            "text_length": text_length(df, texts),
            "word_counts": word_counts(df, texts),
            "char_counts": char_counts(df, texts),
        }
    dates = of("datetime")
    if dates:
        tables |= {"datetime_range": datetime_range(df, dates), "datetime_histogram": datetime_histogram(df, dates)}
    if of("url"):
        tables["url_parts"] = url_parts(df, of("url"))
    return tables

