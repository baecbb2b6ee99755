"""Exact quantiles of many columns, in their own types, in a fixed number of passes.

A sketch of each column (mergeable, a few thousand numbers a task) gives a bracket of values for each wanted rank. Where
a bracket may still hold many rows, further passes cut it to about 1/256 by a sketch of what lies inside. The last pass counts the
distinct values inside the brackets and the rows between them, folded in the task, so that running sums give the
exact value at each rank: two passes, three from 10^8 rows on, four from 10^10, however many columns and ranks there
are. Values are compared, counted and interpolated as they are: integers and decimals never become doubles but
in the sketches, which see them as distances from the smallest value. A rank that a sketch has missed is looked for
again in a wider bracket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal, localcontext
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight_spark.functions.columns import INTEGRAL, as_double, col, finite, per_column
from insight_spark.functions.tables import small_table

#: Accuracy of the first sketches, rows of a bracket that need no cut, and parts of a bracket in a cut.
ACCURACY, PICK_ROWS, BINS = 2000, 1 << 18, 1024
#: Integers beyond this, and decimals of more digits, are measured from the smallest value of their column.
EXACT_DOUBLE, EXACT_DIGITS = 2**53, 15

Number = float | int | Decimal


def typed_number(field: T.StructField) -> Column:
    """A numeric column in a type that keeps its values: long, decimal or double."""
    if isinstance(field.dataType, T.DecimalType):
        return col(field.name)
    if isinstance(field.dataType, INTEGRAL):
        return col(field.name).cast("bigint")
    return as_double(field)


@dataclass(frozen=True)
class _Numbers:
    """A column of numbers: expression, type, rows with a finite value, infinite rows below, smallest, largest."""

    expr: Column
    kind: T.DataType
    n: int
    below: int
    low: Number
    high: Number

    @property
    def floating(self) -> bool:
        return isinstance(self.kind, T.DoubleType)

    @property
    def wide(self) -> bool:
        """Doubles tell too few of its values apart."""
        if self.floating:
            return False
        return isinstance(self.kind, T.DecimalType) and self.kind.precision > EXACT_DIGITS or max(abs(self.low), abs(self.high)) > EXACT_DOUBLE

    @property
    def measured(self) -> Column:
        """What sketches see: the value, or its distance from the smallest."""
        if not self.wide:
            return self.expr.cast("double")
        return (self.expr.cast("decimal(38,{})".format(getattr(self.kind, "scale", 0))) - F.lit(Decimal(self.low))).cast("double")

    def value(self, x: float, up: bool) -> Number:
        """The value of the column's type at a measured x or next to it, on the given side, kept within its range."""
        if self.floating:
            return x
        with localcontext() as c:
            c.prec = 100
            unit = Decimal(1).scaleb(-getattr(self.kind, "scale", 0))
            at = Decimal(math.nextafter(x, math.inf if up else -math.inf)) + (self.low if self.wide else 0)
            whole = (at / unit).to_integral_value("ROUND_CEILING" if up else "ROUND_FLOOR") * unit
            found = min(max(whole, Decimal(self.low)), Decimal(self.high))
        return int(found) if isinstance(self.kind, T.LongType) else found.quantize(unit)


@dataclass(frozen=True)
class _Bracket:
    """Values from low to high of one column that hold the wanted ranks."""

    position: int
    low: Number
    high: Number
    ranks: frozenset[int]


def _positions(n: int, p: float) -> tuple[int, int, Fraction]:
    at = (n - 1) * Fraction(str(p))
    return math.floor(at), math.ceil(at), at - math.floor(at)


def _merged(brackets: list[_Bracket]) -> list[_Bracket]:
    """Brackets of each column in order; those that meet become one."""
    out: list[_Bracket] = []
    for b in sorted(brackets, key=lambda b: (b.position, b.low, b.high)):
        if out and out[-1].position == b.position and b.low <= out[-1].high:
            a = out.pop()
            b = _Bracket(a.position, a.low, max(a.high, b.high), a.ranks | b.ranks)
        out.append(b)
    return out


def _sketched(df: DataFrame, numbers: dict[int, _Numbers], ranks: dict[int, set[int]], margin: float) -> list[_Bracket]:
    """A bracket for every rank, from one sketch a column."""
    asked: dict[int, list[tuple[int, float, float]]] = {}
    for p, wanted in ranks.items():
        x = numbers[p]
        asked[p] = [(r, max(0.0, (r - x.below) / x.n - margin), min(1.0, (r - x.below + 1) / x.n + margin)) for r in sorted(wanted)]
    sketches = [F.percentile_approx(finite(numbers[p].measured), [s for a in own for s in a[1:]], ACCURACY).alias(f"q{p}")
                for p, own in asked.items()]
    found = df.agg(*sketches).first()
    out = []
    for p, own in asked.items():
        x, ends = numbers[p], found[f"q{p}"]
        for k, (r, first, last) in enumerate(own):
            low = x.low if first == 0.0 else x.value(ends[2 * k], up=False)
            out.append(_Bracket(p, low, x.high if last == 1.0 else x.value(ends[2 * k + 1], up=True), frozenset([r])))
    return _merged(out)


def _cut(df: DataFrame, numbers: dict[int, _Numbers], brackets: list[_Bracket]) -> list[_Bracket]:
    """Narrower brackets: a sketch of what lies in each one, and the rows below and inside it."""
    shares = [i / BINS for i in range(BINS + 1)]
    aggs = []
    for i, b in enumerate(brackets):
        x = numbers[b.position]
        inside = _within(x, b)
        aggs += [F.count_if(finite_of(x) < _lit(x, b.low)).alias(f"b{i}"), F.count_if(inside).alias(f"n{i}"),
                 F.percentile_approx(F.when(inside, x.measured), shares, 4 * BINS).alias(f"q{i}")]
    found = df.agg(*aggs).first()
    out = []
    for i, b in enumerate(brackets):
        x, below, n, ends = numbers[b.position], numbers[b.position].below + found[f"b{i}"], found[f"n{i}"], found[f"q{i}"]
        for r in b.ranks:
            at = r - below
            if not 0 <= at < n:
                out.append(_Bracket(b.position, b.low, b.high, frozenset([r])))  # the last pass finds it missing
                continue
            first, last = max(0, math.floor(at / n * BINS) - 1), min(BINS, math.ceil((at + 1) / n * BINS) + 1)
            low = b.low if first == 0 else max(b.low, x.value(ends[first], up=False))
            high = b.high if last == BINS else min(b.high, x.value(ends[last], up=True))
            out.append(_Bracket(b.position, low, high, frozenset([r])))
    return _merged(out)


def finite_of(x: _Numbers) -> Column:
    return finite(x.expr) if x.floating else x.expr


def _lit(x: _Numbers, value: Number) -> Column:
    return F.lit(value).cast(x.kind)


def _within(x: _Numbers, b: _Bracket) -> Column:
    return finite_of(x).between(_lit(x, b.low), _lit(x, b.high))


def _counted(df: DataFrame, numbers: dict[int, _Numbers], brackets: list[_Bracket]) -> dict[tuple[int, int], Number]:
    """Values at the ranks, from counts of the distinct values in the brackets and of the rows between them.

    Columns of one type share a table (position, slot, value); a slot is a gap between brackets or a bracket.
    """
    by_kind: dict[str, list[int]] = {}
    for p in dict.fromkeys(b.position for b in brackets):
        by_kind.setdefault(numbers[p].kind.simpleString(), []).append(p)
    picked = None
    for own in by_kind.values():
        starts = [(p, numbers[p].below) for p in own]
        wanted, slots = [], []
        for p in own:
            x, v = numbers[p], F.col(f"v{p}")
            slot = F.lit(0)
            for i, b in enumerate(b for b in brackets if b.position == p):
                slot = slot + (v >= _lit(x, b.low)).cast("int") + (v > _lit(x, b.high)).cast("int")
                wanted += [(p, 2 * i + 1, r) for r in b.ranks]
            slots.append(slot.alias(f"s{p}"))
        values = df.select(*[finite_of(numbers[p]).alias(f"v{p}") for p in own])
        values = values.select("*", *slots)  # NULL for a missing value, odd inside a bracket
        cells = [F.struct(F.lit(p).alias("position"), F.col(f"s{p}").alias("slot"),
                          F.when(F.col(f"s{p}") % 2 == 1, F.col(f"v{p}")).alias("value")) for p in own]
        counts = values.select(F.inline(F.array(*cells))).filter("slot IS NOT NULL").groupBy("position", "slot", "value").agg(
            F.count("*").alias("cnt"))
        # as many rows a column as its brackets hold distinct values
        to = F.sum("cnt").over(Window.partitionBy("position").orderBy("slot", "value"))
        spark = df.sparkSession
        ends = counts.withColumn("stop", to).join(F.broadcast(small_table(spark, starts, "position int, below bigint")), "position")
        ends = ends.withColumns({"stop": F.col("stop") + F.col("below")}).withColumn("start", F.col("stop") - F.col("cnt"))
        asked = F.broadcast(small_table(spark, wanted, "position int, slot int, rank bigint"))
        found = ends.join(asked, ["position", "slot"]).filter("rank >= start AND rank < stop")
        found = found.select("position", "rank", F.col("value").cast("string").alias("value"))
        picked = found if picked is None else picked.union(found)
    read = {T.LongType: int, T.DoubleType: float, T.DecimalType: Decimal}
    return {(r.position, r["rank"]): read[type(numbers[r.position].kind)](r.value) for r in picked.collect()}


def order_statistics(df: DataFrame, numbers: dict[int, _Numbers], ranks: dict[int, set[int]]) -> dict[tuple[int, int], Number]:
    """{(position, rank): the value at that 0-based rank} of finite and infinite values together."""
    found: dict[tuple[int, int], Number] = {}
    left: dict[int, set[int]] = {}
    for p, wanted in ranks.items():
        x = numbers[p]
        for r in wanted:
            if r < x.below:
                found[p, r] = -math.inf
            elif r >= x.below + x.n:
                found[p, r] = math.inf
            elif x.low == x.high:
                found[p, r] = x.low
            else:
                left.setdefault(p, set()).add(r)
    margin = 3 / ACCURACY
    while left:
        brackets = _sketched(df, numbers, left, margin)
        rows = max(2 * margin * numbers[b.position].n * len(b.ranks) for b in brackets)
        while rows > PICK_ROWS:
            brackets = _cut(df, numbers, brackets)
            rows *= 4 / BINS  # the part of a rank, its neighbours and the sketch's error
        found |= _counted(df, numbers, brackets)
        left = {p: rest for p, own in left.items() if (rest := {r for r in own if (p, r) not in found})}
        margin *= 16
    return found


def _interpolated(a: Number, b: Number, part: Fraction) -> Number:
    if part == 0 or a == b:
        return a
    if isinstance(a, float) or isinstance(b, float):
        return a + (b - a) * float(part)
    with localcontext() as c:
        c.prec = 100
        return Decimal(a) + (Decimal(b) - Decimal(a)) * part.numerator / part.denominator


def exact_quantiles(df: DataFrame, cols: Sequence[tuple], probs: Sequence[float],
                    basics: dict[int, dict] | None = None) -> dict[int, list[Number | None]]:
    """Quantiles with linear interpolation, per column position: floats of a double column, int or Decimal of others.

    `cols` holds position, expression and type (long, decimal or double, which may be left out); `basics` may carry
    the result of `range_basics` when it is already known.
    """
    if not cols:
        return {}
    cols = [(*c, T.DoubleType()) if len(c) == 2 else c for c in cols]
    basics = range_basics(df, [(p, c) for p, c, _ in cols]) if basics is None else basics
    numbers = _numbers(df, [c for c in cols if basics[c[0]]["finite"]], basics)
    total = {p: basics[p]["finite"] + basics[p]["neg_inf"] + basics[p]["pos_inf"] for p, _, _ in cols}
    for p, c, kind in cols:
        if p not in numbers and total[p]:  # only infinite values
            numbers[p] = _Numbers(c, kind, 0, basics[p]["neg_inf"], 0.0, 0.0)
    ranks: dict[int, set[int]] = {}
    for p, n in total.items():
        for q in probs if n else ():
            ranks.setdefault(p, set()).update(_positions(n, q)[:2])
    found = order_statistics(df, numbers, ranks)
    out: dict[int, list[Number | None]] = {}
    for p, n in total.items():
        places = [_positions(n, q) for q in probs] if n else []
        out[p] = [_interpolated(found[p, low], found[p, high], part) for low, high, part in places] or [None] * len(probs)
    return out


def typed_columns(fields: Sequence[tuple[int, T.StructField]]) -> list[tuple[int, Column, T.DataType]]:
    """(position, expression, type) of numeric fields, as `exact_quantiles` takes them."""
    kinds = {T.DecimalType: lambda f: f.dataType} | dict.fromkeys(INTEGRAL, lambda f: T.LongType())
    return [(p, typed_number(f), kinds.get(type(f.dataType), lambda f: T.DoubleType())(f)) for p, f in fields]


def _numbers(df: DataFrame, cols: Sequence[tuple[int, Column, T.DataType]], basics: dict[int, dict]) -> dict[int, _Numbers]:
    """Columns with their ends in their own type; those that doubles cannot hold are read once more for these."""
    ends: dict[int, tuple[Number, Number]] = {}
    unsure = []
    for p, c, kind in cols:
        low, high = basics[p]["low"], basics[p]["high"]
        if isinstance(kind, T.DoubleType):
            ends[p] = low, high
        elif isinstance(kind, T.LongType) and max(abs(low), abs(high)) < EXACT_DOUBLE:
            ends[p] = int(low), int(high)
        else:
            unsure.append((p, c))
    if unsure:
        found = df.agg(*[a.alias(f"{n}{p}") for p, c in unsure for n, a in (("a", F.min(c)), ("b", F.max(c)))]).first()
        ends |= {p: (found[f"a{p}"], found[f"b{p}"]) for p, _ in unsure}
    return {p: _Numbers(c, kind, basics[p]["finite"], basics[p]["neg_inf"], *ends[p]) for p, c, kind in cols}


RANGE_STATS = {
    "finite": lambda c: F.count(finite(c)),
    "neg_inf": lambda c: F.count_if(c == float("-inf")),
    "pos_inf": lambda c: F.count_if(c == float("inf")),
    "low": lambda c: F.min(finite(c)),
    "high": lambda c: F.max(finite(c)),
}


def range_basics(df: DataFrame, cols: Sequence[tuple[int, Column]]) -> dict[int, dict]:
    """Finite and infinite rows, smallest and largest finite value as doubles, per position; one pass."""
    rows = per_column(df, [(p, str(p), c.cast("double")) for p, c in cols], RANGE_STATS, fields=5).collect()
    return {r.position: r.asDict() for r in rows}
