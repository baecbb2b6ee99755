"""Value frequencies: the shared basis of distinct counts, top values and dominance.

Columns of one type family are unpivoted together and counted by (column, value)
in a single shuffle. Spark pre-aggregates on the map side, so a value that fills a
third of the table still reaches the reducer as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import (
    FLOATING,
    INTEGRAL,
    KEY_BYTES,
    col,
    compact_key,
    fields_of,
    is_string,
    name_at,
    normalize_missing,
)
from insight_spark.functions.datetimes import DATETIME_FORMATS, format_hits
from insight_spark.functions.tables import small_table


def value_family(dt: T.DataType) -> T.DataType:
    if isinstance(dt, INTEGRAL):
        return T.LongType()
    if isinstance(dt, FLOATING):
        return T.DoubleType()
    if isinstance(dt, T.BooleanType) or is_string(dt):
        return T.StringType()
    if isinstance(dt, (T.VariantType, T.AnsiIntervalType, T.CalendarIntervalType)):
        return T.StringType()
    return dt


def typed_values(df: DataFrame, cols: Sequence[str] | None = None, compact: bool = False) -> list[DataFrame]:
    """One frame (position, value) per type family, missing values included."""
    families: dict[str, tuple[T.DataType, list]] = {}
    for position, field in fields_of(df, cols):
        family = value_family(field.dataType)
        families.setdefault(family.json(), (family, []))[1].append((position, field))
    frames = []
    for family, members in families.values():

        def value(field: T.StructField, family: T.DataType = family) -> Column:
            c = col(field.name)
            if field.dataType != family:
                c = c.cast(family)
            return compact_key(c) if compact and is_string(field.dataType) else c

        wide = df.select(*[value(f).alias(str(p)) for p, f in members])
        if len(members) == 1:
            position = members[0][0]
            long = wide.select(F.lit(position).alias("position"), col(str(position)).alias("value"))
        else:
            names = [str(p) for p, _ in members]
            long = wide.unpivot([], [col(n) for n in names], "position", "value")
            long = long.select(F.col("position").cast("int").alias("position"), "value")
        frames.append(long)
    return frames


def _counted(values: DataFrame) -> DataFrame:
    return values.groupBy("position", "value").agg(F.count("*").alias("cnt"))


def typed_frequencies(df: DataFrame, cols: Sequence[str] | None = None, compact: bool = False) -> list[DataFrame]:
    """One frame (position, value, cnt) per type family, values keep their type."""
    return [_counted(v.filter(F.col("value").isNotNull())) for v in typed_values(df, cols, compact)]


def _as_text(frames: list[DataFrame]) -> DataFrame:
    out = None
    for freq in frames:
        part = freq.select("position", F.col("value").cast("string").alias("value"), "cnt")
        out = part if out is None else out.unionByName(part)
    return out


def value_frequencies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, position, value, cnt) of every non-missing value, values as text."""
    df = normalize_missing(df)
    if not fields_of(df, cols):
        return small_table(df.sparkSession, [], "column string, position int, value string, cnt bigint")
    freq = _as_text(typed_frequencies(df, cols))
    return freq.select(name_at(F.col("position"), df.columns).alias("column"), "position", "value", "cnt")


def best_values(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """(position, value, cnt, rank): `top_values` without the totals of the columns."""
    df = normalize_missing(df)
    freq = _as_text(typed_frequencies(df, cols, compact=True))
    order = Window.partitionBy("position").orderBy(F.col("cnt").desc(), F.col("value"))
    best = freq.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return _with_texts(df, [(p, f) for p, f in fields_of(df, cols) if is_string(f.dataType)], best)


TOP_SCHEMA = (
    "column string, position int, n_rows bigint, non_null bigint, n_unique bigint, "
    "value string, cnt bigint, rank int"
)


def top_values(df: DataFrame, cols: Sequence[str], k: int) -> DataFrame:
    """The k most frequent values per column, with the column's totals.

    (column, position, n_rows, non_null, n_unique, value, cnt, rank); a column without
    values keeps one row. Ties go by value, among long texts by digest: long texts are
    counted by digest and only the ones listed are looked up, so whole texts are never
    shuffled. Totals and ranks read the same shuffled frequency table, and only the
    best k rows per task reach the final ranking.
    """
    df = normalize_missing(df)
    wanted = fields_of(df, cols)
    if not wanted:
        return small_table(df.sparkSession, [], TOP_SCHEMA)
    freq = _as_text([_counted(v) for v in typed_values(df, cols, compact=True)])
    # Both readers of `freq` take all its rows and columns, and a union instead of a
    # join pushes no filter below it, so Spark shuffles the frequency table once.
    order = Window.partitionBy("position").orderBy(
        F.col("value").isNull(), F.col("cnt").desc(), F.col("value")
    )
    best = freq.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    totals = _zeros(df, [p for p, _ in wanted]).unionByName(
        freq.groupBy("position").agg(*_totals()), allowMissingColumns=True
    )
    both = totals.unionByName(best, allowMissingColumns=True)
    column = Window.partitionBy("position")  # at most k + 2 rows each
    ranked = F.when(F.col("value").isNotNull(), F.col("rank"))
    both = both.select(
        "position",
        *[F.coalesce(F.max(c).over(column), F.lit(0)).alias(c) for c in ("n_rows", "non_null", "n_unique")],
        "value",
        "cnt",
        ranked.alias("rank"),
        F.count("value").over(column).alias("listed"),
        F.row_number().over(column.orderBy(F.col("value").isNull(), "rank")).alias("line"),
    )
    kept = F.col("rank").isNotNull() | ((F.col("listed") == 0) & (F.col("line") == 1))
    top = both.filter(kept).select(
        "position", "n_rows", "non_null", "n_unique", "value",
        F.when(F.col("rank").isNotNull(), F.col("cnt")).alias("cnt"), "rank",
    )
    top = _with_texts(df, [(p, f) for p, f in wanted if is_string(f.dataType)], top)
    return top.select(name_at(F.col("position"), df.columns).alias("column"), *top.columns)


def _with_texts(df: DataFrame, texts: list[tuple[int, T.StructField]], top: DataFrame) -> DataFrame:
    """Put the text back in place of each listed digest.

    The digests are at most a few rows per column, so they are broadcast to one more
    scan of the text columns; without any digest Spark drops that scan at run time.
    """
    if not texts:
        return top
    is_digest = F.octet_length("value") > KEY_BYTES
    digests = top.filter(is_digest).select("position", F.col("value").alias("key"))
    raw = None
    for p, f in texts:
        part = df.select(F.lit(p).alias("position"), col(f.name).alias("text"))
        raw = part if raw is None else raw.unionByName(part)
    long = raw.filter(F.octet_length("text") > KEY_BYTES).withColumn("key", compact_key(F.col("text")))
    found = long.join(F.broadcast(digests), ["position", "key"]).groupBy("position", "key").agg(
        F.first("text").alias("text")
    )
    found = found.select("position", F.col("key").alias("value"), "text")
    joined = top.join(found, ["position", "value"], "left")
    return joined.select(
        *[F.coalesce("text", "value").alias(c) if c == "value" else F.col(c) for c in top.columns]
    )


def _totals() -> list[Column]:
    filled = F.col("value").isNotNull()
    return [
        F.sum("cnt").alias("n_rows"),
        F.sum(F.when(filled, F.col("cnt")).otherwise(F.lit(0))).alias("non_null"),
        F.count("value").alias("n_unique"),
    ]


def _zeros(df: DataFrame, positions: list[int]) -> DataFrame:
    """One row per column, so that the columns of an empty table are listed too."""
    return small_table(df.sparkSession, [(p,) for p in positions], "position int")


def _with_zeros(df: DataFrame, positions: list[int], counts: DataFrame) -> DataFrame:
    """Counts per column, 0 for the columns of an empty table."""
    both = _zeros(df, positions).unionByName(counts, allowMissingColumns=True)
    return both.groupBy("position").agg(
        *[
            F.max(c).alias(c) if c == "date_hits" else F.coalesce(F.max(c), F.lit(0)).alias(c)
            for c in counts.columns
            if c != "position"
        ]
    )


def column_counts(df: DataFrame, cols: Sequence[str] | None = None, dates: bool = False) -> DataFrame:
    """(position, n_rows, non_null, n_unique, date_hits) per column, in one pass.

    Missing values are counted as one more value, so rows, non-missing and distinct
    values all come out of the same frequency table. `date_hits` counts, per datetime
    format, the values of a string column that parse; it is evaluated once per
    distinct value.
    """
    wanted = fields_of(df, cols)
    strings = [p for p, f in wanted if is_string(f.dataType)]
    no_hits = F.lit(None).cast("array<bigint>")
    out = None
    for values in typed_values(df, cols, compact=True):
        hits = no_hits
        if dates and is_string(values.schema["value"].dataType):
            hits = F.array(*format_hits(F.col("value"), F.col("cnt")))
        counts = _counted(values).groupBy("position").agg(*_totals(), hits.alias("date_hits"))
        out = counts if out is None else out.unionByName(counts)
    merged = _with_zeros(df, [p for p, _ in wanted], out)
    if not dates:
        return merged.drop("date_hits")
    none = F.array(*[F.lit(0).cast("bigint")] * len(DATETIME_FORMATS))
    found = F.when(F.col("position").isin(strings), F.coalesce("date_hits", none))
    return merged.withColumn("date_hits", found)


def n_unique(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, n_unique): exact, or a sketch estimate (about 1 % off) on request."""
    df = normalize_missing(df)
    if approx:
        return _n_unique_estimate(df, cols)
    counts = column_counts(df, cols)
    return counts.select(name_at(F.col("position"), df.columns).alias("column"), "n_unique")


SKETCH_SIZE = 14
SKETCH_GROUPS = 64


def _n_unique_estimate(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    """One pass without moving values: a sketch per task, merged in two steps."""
    fields = [f for _, f in fields_of(df, cols)]
    wanted = [f.name for f in fields]

    def hashed(field: T.StructField) -> Column:
        # maps have no hash
        c = col(field.name).cast("string") if "map<" in field.dataType.simpleString() else col(field.name)
        return F.when(c.isNotNull(), F.xxhash64(c))

    hashes = df.select(
        F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"),
        *[hashed(f).alias(f"h{i}") for i, f in enumerate(fields)],
    )
    some = hashes.groupBy("g").agg(
        *[F.hll_sketch_agg(f"h{i}", F.lit(SKETCH_SIZE)).alias(f"s{i}") for i in range(len(wanted))]
    )
    one = some.agg(
        *[F.hll_sketch_estimate(F.hll_union_agg(f"s{i}")).alias(f"e{i}") for i in range(len(wanted))]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"e{i}").alias("n_unique")) for i, c in enumerate(wanted)]
    return one.select(F.inline(F.array(*rows)))
