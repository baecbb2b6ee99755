"""Repeated rows in two phases: digests of all rows, then whole rows only where a digest repeats.

The first phase shuffles 128 bits and a count for each row, folded in the task, however wide rows are. Digests seen
twice set bits of a bitmap of fixed size, which goes to all tasks. The second phase counts the rows that
hit it by their whole content, so a collision of digests, or of bits, brings a row too many into the count but
never joins two different rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import col, normalize_missing

#: 64-bit words of the bitmap: 16 million bits, at most as many rows as words are broadcast.
FILTER_WORDS = 1 << 18

#: Rows of so many bytes of plain fields are as cheap to group as their digest.
NARROW_BYTES = 16
WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8,
    T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _narrow(df: DataFrame) -> bool:
    widths = [WIDTHS.get(type(f.dataType)) for f in df.schema.fields]
    return None not in widths and sum(widths) <= NARROW_BYTES


def _needs_order(dt: T.DataType) -> bool:
    text = dt.simpleString()
    return "map<" in text or "variant" in text


def hashable(c: Column, dt: T.DataType) -> Column:
    """An expression that is equal for equal values and can be hashed: maps as sorted entries, variants as text."""
    if not _needs_order(dt):
        return c
    if isinstance(dt, T.VariantType):
        return c.cast("string")
    if isinstance(dt, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(
            hashable(e["key"], dt.keyType).alias("k"), hashable(e["value"], dt.valueType).alias("v")))
        return F.array_sort(entries)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda e: hashable(e, dt.elementType))
    fields = F.struct(*[hashable(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(dt.fields)])
    return F.when(c.isNotNull(), fields)


def row_digest(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes (d1, d2) of a row; a missing value is told from its absence."""
    values = [hashable(col(f.name), f.dataType) for f in df.schema.fields]
    missing = F.array(*[v.isNull() for v in values]) if values else F.lit(0)
    return [F.xxhash64(F.lit(salt), missing, *values).alias(f"d{salt}") for salt in (1, 2)]


def _slot() -> Column:
    return F.expr(f"pmod(d1 ^ shiftleft(d2, 7), {FILTER_WORDS * 64})")


def repeated_groups(df: DataFrame) -> DataFrame:
    """(v0, v1, ..., cnt): the rows of df that occur more than once, with their columns by position.

    Missing equals missing; a map equals another with the same entries.
    """
    df = normalize_missing(df)
    names = [f"v{i}" for i in range(len(df.columns))]
    whole = df.select(*[
        (c.cast("string") if isinstance(f.dataType, T.VariantType) else c).alias(n)
        for n, f in zip(names, df.schema.fields) for c in (col(f.name),)
    ])
    if not _narrow(df):
        digests = df.select(*row_digest(df)).groupBy("d1", "d2").agg(F.count("*").alias("cnt")).filter("cnt > 1")
        bits = digests.select(_slot().alias("slot"))
        words = bits.groupBy(F.shiftright("slot", 6).alias("word")).agg(
            F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT))) AS bits"))
        keyed = whole.select(*names, *row_digest(whole)).withColumn("slot", _slot())
        keyed = keyed.withColumn("word", F.shiftright("slot", 6))
        hit = F.expr("getbit(bits, CAST(slot & 63 AS INT)) = 1")
        whole = keyed.join(F.broadcast(words), "word").filter(hit)  # FILTER_WORDS rows at most
    return whole.groupBy(*names).agg(F.count("*").alias("cnt")).filter("cnt > 1")
