"""Column helpers: quoting, missing values, grouping keys, text formats.

Everything here is a plain Spark expression, so it stays inside whole-stage
code generation wherever it is used.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An aggregate with more buffer fields than spark.sql.codegen.maxFields (100)
# leaves whole-stage code generation, so wide aggregates are cut below that.
AGG_FIELDS = 90

# Strings above this many bytes are grouped by digest when only equality counts.
KEY_BYTES = 64

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
NATIVE_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name; dots and backticks in names are safe."""
    return F.col(quoted(name))


def chunks(items: Sequence, size: int) -> list[Sequence]:
    size = max(1, size)
    return [items[i : i + size] for i in range(0, len(items), size)]


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, NATIVE_DATETIME)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def fields_of(df: DataFrame, cols: Iterable[str] | None = None) -> list[tuple[int, T.StructField]]:
    """(schema position, field) of the wanted columns that exist, in the order asked for."""
    by_name = {f.name: (i, f) for i, f in enumerate(df.schema.fields)}
    names = by_name if cols is None else cols
    return [by_name[c] for c in names if c in by_name]


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN means missing, exactly like NULL; infinities stay values."""
    if not any(isinstance(f.dataType, FLOATING) for f in df.schema.fields):
        return df
    return df.select(
        *[
            F.nanvl(col(f.name), F.lit(None).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, FLOATING)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def as_double(field: T.StructField) -> Column:
    c = col(field.name)
    if isinstance(field.dataType, T.BooleanType):
        c = c.cast("int")
    return c.cast("double")


def finite(c: Column) -> Column:
    """The value, or NULL when it is infinite."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def compact_key(c: Column) -> Column:
    """Equality key of a string: itself, or a SHA-256 digest when it is long.

    The digest form is one byte longer than any string kept as it is, so the two
    forms never meet. Long texts then cost 65 bytes in a shuffle.
    """
    return F.when(F.octet_length(c) > KEY_BYTES, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c)


def name_at(position: Column, names: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position + 1)


def per_column(df: DataFrame, cols: Sequence[tuple[int, str, Column]], stats: dict, fields: int) -> DataFrame:
    """One row per column with the given statistics.

    `cols` holds (position, name, expression); `stats` maps a statistic to an
    aggregate of the expression; `fields` is the buffer width of one column's
    aggregates. Batches read disjoint columns, so a columnar table is read once.
    """
    out = None
    for batch in chunks(list(cols), AGG_FIELDS // fields):
        one = df.agg(*[agg(c).alias(f"{s}_{p}") for p, _, c in batch for s, agg in stats.items()])
        rows = [
            F.struct(
                F.lit(p).alias("position"),
                F.lit(n).alias("column"),
                *[F.col(f"{s}_{p}").alias(s) for s in stats],
            )
            for p, n, _ in batch
        ]
        part = one.select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out


def significant(c: Column, digits: int = 4) -> Column:
    """Text with at most `digits` significant digits and no padding zeros.

    Ties round to the even digit; the formatter alone would round them up.
    """
    x = c.cast("double")
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    even = F.bround(F.try_divide(x, unit)) * unit
    text = F.format_string(f"%.{digits}g", F.coalesce(even, x))
    text = F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2")
    text = F.regexp_replace(text, r"\.(e|$)", "$1")
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x.isNotNull(), text)
    )


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def safe_name(name: Column) -> Column:
    """File-name form of a dataset name."""
    return F.regexp_replace(name, "[ /]", "_")
