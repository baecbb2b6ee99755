"""Records of CSV files with line breaks inside quotes, without giving a whole file to one task.

Files are read as lines, split among tasks as any text. Whether a line starts inside a quoted field depends on all
lines before it, but a block of lines is only a function of two states: how it ends if it starts outside
of quotes, and how if inside. These functions, one row per block, are put in order for each file; then every
block is cut into records on its own, and the pieces of records that cross blocks are joined, at most two per block.
Only a quote at the start of a field opens one, so that other quotes do not count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insight_spark.sources.scratch import scratch_dir

#: A quoted field that ends on its line, and one that does not, once doubled quotes are gone.
CLOSED, OPEN = '(^|,)"[^"]*"', '(^|,)"'

_BLOCKS = "file string, block long, ends_out boolean, ends_in boolean, through boolean"
_PIECES = "file string, owner long, block long, seq long, whole boolean, value binary"


def ends_open(line: Column) -> Column:
    """Whether a line that starts outside of quotes ends inside them."""
    return F.regexp_replace(F.replace(line, F.lit('""'), F.lit("")), CLOSED, "$1").rlike(OPEN)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value) of every line as bytes; the rows of a block, one split of a file, are in order."""
    text = spark.read.text(path, lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"))


def _step(value: bytes, inside: bool) -> bool:
    """Whether quotes are open after a line."""
    import re

    if b'"' not in value:
        return inside
    # inside a field the line goes on as after an opening quote
    text = (b'"' + value if inside else value).replace(b'""', b"")
    text = re.sub(rb'(^|,)"[^"]*"', rb"\1", text)
    return re.search(rb'(^|,)"', text) is not None


def block_ends(read: DataFrame) -> DataFrame:
    """(file, block, ends_out, ends_in, through): quotes open at the end of a block that starts outside or inside of
    them, and whether one that starts inside never leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held: dict[tuple, list[bool]] = {}
        for b in batches:
            for file, block, value in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value"))):
                s = held.setdefault((file, block), [False, True, True])
                s[0], s[1] = _step(value, s[0]), _step(value, s[1])
                s[2] = s[2] and s[1]
        if held:
            columns = zip(*((*k, *v) for k, v in held.items()))
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], ["file", "block", "ends_out", "ends_in", "through"])

    return read.mapInArrow(run, _BLOCKS)


def block_starts(ends: DataFrame) -> DataFrame:
    """(file, block, inside, owner): whether a block starts inside quotes, and the block where that record begins."""
    at = F.array_sort(F.collect_list(F.struct("block", "ends_out", "ends_in", "through")))
    first = F.expr("named_struct('block', -1L, 'inside', false, 'owner', -1L, 'open', false, 'begun', -1L)")

    def then(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        inside = last["open"]
        stays = inside & b["through"]
        return F.concat(done, F.array(F.struct(
            b["block"].alias("block"), inside.alias("inside"), last["begun"].alias("owner"),
            F.when(inside, b["ends_in"]).otherwise(b["ends_out"]).alias("open"),
            F.when(stays, last["begun"]).otherwise(b["block"]).alias("begun"))))

    states = ends.groupBy("file").agg(F.aggregate(at, F.array(first), then).alias("states"))
    rows = states.select("file", F.inline("states"))
    return rows.filter("block >= 0").select("file", "block", "inside", "owner")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(header, value): the records of CSV files as bytes, line breaks inside; `header` marks the first of a file.

    Records end with LF or CRLF; blank lines between them are left out. A quote that never closes takes the rest of
    its file. Each line moves once, to the task of its block, after the row that tells how the block starts.
    """
    read = lines(spark, path)
    at = f"{scratch_dir(spark)}/blocks"
    block_starts(block_ends(read)).write.parquet(at)
    starts = spark.read.parquet(at)
    told = starts.select("file", "block", F.lit(-1).cast("long").alias("n"), "inside", "owner", F.lit(b"").alias("value"))
    given = read.select(
        "file", "block", F.monotonically_increasing_id().alias("n"), F.lit(False).alias("inside"),
        F.lit(-1).cast("long").alias("owner"), "value")
    both = told.unionByName(given).repartition(max(1, starts.count()), "file", "block")
    pieces = both.sortWithinPartitions("file", "block", "n").mapInArrow(_cut, _PIECES)

    first = (F.col("block") == 0) & (F.col("seq") == 0)
    whole = pieces.filter("whole").select(first.alias("header"), "value")
    parts = F.array_sort(F.collect_list(F.struct("block", "value")))  # in the order of the file
    joined = pieces.filter("NOT whole").groupBy("file", "owner").agg(F.bool_or(first).alias("header"), parts.alias("parts"))
    text = F.aggregate("parts", F.lit(b""), lambda done, x: F.concat(done, F.lit(b"\n"), x["value"]))
    crossing = joined.select("header", F.substring(text, 2, 2**31 - 1).alias("value"))
    return whole.unionByName(crossing)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of sorted blocks: whole ones, and pieces of the record that enters a block and of the one that leaves it."""
    import pyarrow as pa

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    out: list[tuple] = []
    held: list[bytes] = []
    file, block, owner, seq, inside, entered = "", -1, -1, 0, False, False

    def end(closed: bool) -> None:
        """The held lines are a record, or its piece where it entered the block or goes on after it."""
        nonlocal seq
        value = b"\n".join(held)
        held.clear()
        if entered or not closed:
            out.append((file, owner if entered else block, block, seq, False, value))
        elif value.strip():
            out.append((file, block, block, seq, True, value))
        else:
            return
        seq += 1

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["file", "owner", "block", "seq", "whole", "value"])
        out.clear()
        return made

    for b in batches:
        for f, at, n, starts_inside, begun, value in zip(*(c.to_pylist() for c in b.columns)):
            if n < 0:  # the row that tells how the next block starts
                if held:
                    end(False)
                file, block, owner, seq, inside, entered = f, at, begun, 0, starts_inside, starts_inside
                continue
            if block == 0 and seq == 0 and not held:
                value = value.removeprefix(b"\xef\xbb\xbf")
            held.append(value)
            inside = _step(value, inside)
            if not inside:
                end(True)
                entered = False
        if out:
            yield batch()
    if held:
        end(False)
    if out:
        yield batch()
