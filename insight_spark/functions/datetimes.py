"""Lenient datetime parsing of strings.

A string column is read with ONE format: the first of a fixed list that parses
more than 70 % of its values. A cheap pattern guards each format, so free text
never reaches the parser.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import is_datetime

PARSE_SHARE = 0.7

# fixed values: pattern guard and parse format, tried in this order; None = ISO 8601
DATETIME_FORMATS = (
    (r"^\d{4}(-\d{1,2}(-\d{1,2}([ T]\d.*)?)?)?$", None),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)


#: A time with its distance from UTC at the end.
OFFSET = r"\d[T ]\d{1,2}(:\d{1,2}(:\d{1,2}([.]\d+)?)?)? ?(Z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)$"


def parse_string(c: Column, format_no: int) -> Column:
    """The wall-clock time a text says; one with an offset from UTC is an instant, read in the session's time zone."""
    pattern, fmt = DATETIME_FORMATS[format_no]
    text = F.trim(c)
    if fmt is None:
        # the cast knows +05:30 but not +0530, and wants seconds before an offset
        whole = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
        whole = F.regexp_replace(whole, r"([T ]\d{1,2}:\d{1,2})( ?(Z|UTC|GMT|[+-]\d.*))$", "$1:00$2")
        instant = whole.try_cast("timestamp").cast("timestamp_ntz")
        parsed = F.when(text.rlike(OFFSET), instant).otherwise(text.try_cast("timestamp_ntz"))
    else:
        parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    return F.when(text.rlike(pattern), parsed)


def format_hits(c: Column, weight: Column) -> list[Column]:
    """Per format, the aggregated number of values it parses."""
    return [
        F.sum(F.when(parse_string(c, i).isNotNull(), weight).otherwise(F.lit(0)))
        for i in range(len(DATETIME_FORMATS))
    ]


def best_format(hits: Column, non_null: Column) -> Column:
    """Number of the first format above the share, or NULL."""
    choice = None
    for i in range(len(DATETIME_FORMATS)):
        good = F.element_at(hits, i + 1) > non_null * PARSE_SHARE
        choice = F.when(good, F.lit(i)) if choice is None else choice.when(good, F.lit(i))
    return choice


def aggregated_format(c: Column) -> Column:
    """`best_format` of a column of texts, as one aggregate of fixed width."""
    choice = F.when(F.lit(False), F.lit(None))
    for i in range(len(DATETIME_FORMATS)):
        choice = choice.when(F.count(parse_string(c, i)) > F.count(c) * PARSE_SHARE, F.lit(i))
    return choice


def choose_format(hits: Sequence[int], non_null: int) -> int | None:
    """The format a column is read with: the one `best_format` names; below the share, where only a caller who
    names the column gets here, the one with most hits."""
    above = (i for i, n in enumerate(hits) if n > non_null * PARSE_SHARE)
    most = max(hits, default=0)
    return next(above, hits.index(most) if most else None)


def as_timestamp(c: Column, dtype: T.DataType, format_no: int | None) -> Column:
    """Timestamp of a datetime column or of a string column with a known format."""
    if is_datetime(dtype):
        return c
    if format_no is None:
        return F.lit(None).cast("timestamp_ntz")
    return parse_string(c, int(format_no))
