"""Conversation repair: the cheapest edits that give a conversation lawful roles, as Knuth's lightest derivation.

A lawful conversation reads `(s?(ua)+)?` over the initials of its roles. Items of the deduction system are
spans: (rows read, state of the grammar before, state after), with weight (cost, audit); audit holds the
initials of the edits in order. Axioms are the empty spans; rules lengthen a span by one edit (Keep, Rerole,
Delete, Insert) or join two neighbouring spans. Both are superior functions: a conclusion is never lighter
than a premise, and two audits of one span at equal cost differ before either ends (each row has one letter
and every further letter is an Insert, which costs). So an agenda popped by weight finalises an item at its
lightest derivation, ties going to the audit that is least in ASCII, and stops at the goal item.

Conversations are read in blocks of rows, so one of any length is spread over tasks: rows are dealt by ranges of
(conv_id, turn, digest) without their texts, each block's spans are derived where it lies, and a conversation's
blocks are joined pairwise. Only the repaired text is written row after row, as a stream.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, tasks

#: Rows of one block.
BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States: nothing read, after s, after u, after a. The initials a state may be followed by, and where they lead.
STATES = range(4)
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)

Weight = tuple[int, str]


def lightest(
    axioms: Iterable[tuple[Weight, Hashable]],
    conclude: Callable[[Weight, Hashable, dict], Iterable[tuple[Weight, Hashable]]],
    goals: set,
) -> dict[Hashable, Weight]:
    """Lightest derivations by an agenda: items finalise in order of weight, until all goals have.

    `conclude` gets an item that has just become final, its weight and the chart of final items, and gives
    the conclusions of all rules whose last open premise it is.
    """
    agenda = [(w, item) for w, item in axioms]
    heapq.heapify(agenda)
    chart: dict[Hashable, Weight] = {}
    left = set(goals)
    while agenda:
        weight, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = weight
        left.discard(item)
        if not left:
            break
        for conclusion in conclude(weight, item, chart):
            if conclusion[1] not in chart:
                heapq.heappush(agenda, conclusion)
    return chart


def block_spans(rows: list[tuple[str, str]], starts: Iterable[int] = STATES) -> dict[tuple[int, int], Weight]:
    """(state before, state after) -> lightest weight over rows (initial, fault: 'b', 'd', 't' or '')."""
    n, out = len(rows), {}

    def conclude(weight: Weight, item: tuple[int, int], _: dict) -> Iterator[tuple[Weight, tuple[int, int]]]:
        (cost, audit), (i, state) = weight, item
        for role, after in STEPS[state].items():
            if role != "s":
                yield (cost + INSERT, audit + "I"), (i, after)
        if i == n:
            return
        initial, fault = rows[i]
        yield (cost + DELETE, audit + "D"), (i + 1, state)
        if fault in ("b", "d"):
            return
        kept = cost + TRUNCATED * (fault == "t")
        if initial in STEPS[state]:
            yield (kept + KEEP, audit + "K"), (i + 1, STEPS[state][initial])
        for role, after in STEPS[state].items():
            if role != "s":
                yield (kept + REROLE, audit + "R"), (i + 1, after)

    for s in starts:
        reach = {t for t in STATES if t == s or t in (2, 3) or (s == 0 and t == 1 and any(r == "s" for r, _ in rows))}
        chart = lightest([((0, ""), (0, s))], conclude, {(n, t) for t in reach})
        out |= {(s, t): chart[n, t] for t in STATES if (n, t) in chart}
    return out


def join_spans(blocks: list[dict[tuple[int, int], Weight]]) -> Weight:
    """The lightest weight of the whole conversation: neighbouring spans are joined pairwise up to the goal."""
    widths = [len(blocks)]
    while widths[-1] > 1:
        widths.append((widths[-1] + 1) // 2)
    top = len(widths) - 1
    goal = (top + 1, 0, 0, 0)

    def conclude(weight: Weight, item: tuple, chart: dict) -> Iterator[tuple[Weight, tuple]]:
        level, k, s, t = item
        if level == top:
            if s == 0 and t in FINAL:
                yield weight, goal
        elif k ^ 1 == widths[level]:  # the last one of an odd number goes up alone
            yield weight, (level + 1, k // 2, s, t)
        else:
            for m in STATES:
                other = (level, k + 1, t, m) if k % 2 == 0 else (level, k - 1, m, s)
                if other in chart:
                    (c1, a1), (c2, a2) = (weight, chart[other]) if k % 2 == 0 else (chart[other], weight)
                    yield (c1 + c2, a1 + a2), (level + 1, k // 2, *((s, m) if k % 2 == 0 else (m, t)))

    axioms = [(w, (0, k, s, t)) for k, spans in enumerate(blocks) for (s, t), w in spans.items()]
    return lightest(axioms, conclude, {goal})[goal]


def replay(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows that an audit of lightest edits makes of rows."""
    left, state = iter(rows), 0
    for letter in audit:
        if letter == "D":
            next(left)
            continue
        role, text = ("", "") if letter == "I" else next(left)
        if letter != "K":
            role = "assistant" if state == 2 else "user"
        state = STEPS[state][role[:1]]
        yield role, text


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) of turns after the damage that crc32 of `conv_id:turn` deals.

    Modulo 20: 0 drops the row (it stays here, flagged), 1 empties its text, 2 removes its `[.!?]`, 3 repeats
    it, 4 sets its role to user. A null role or text counts as one space, also in the checksum.
    """
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        part("role").alias("role"), part("text").alias("text"), kind.alias("kind"),
    )
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("nth"),
    ).drop("nth")


def _digest() -> Column:
    """16 bytes that tell (role, text) pairs apart."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def _null_safe(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


_SPANS = ("conv_id long, turn long, digest binary, n long, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string, low long, high long, turns long, last_turn long, spans string")


class _Block:
    """Rows of one conversation, at most BLOCK, as they come."""

    def __init__(self, conv: int | None, turn: int | None, digest: bytes) -> None:
        self.key, self.rows, self.counts = (conv, turn, digest), [], dict.fromkeys("bdt", 0)
        self.illegal, self.turns, self.low, self.high = 0, 0, None, None
        self.first = self.last = self.last_turn = self.last_row = None

    def add(self, turn: int | None, digest: bytes, initial: str, fault: str) -> None:
        if self.rows:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        if turn is not None:
            self.turns += turn != self.last_turn
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last, self.last_turn = initial, turn
        if fault:
            self.counts[fault] += 1
        self.rows.append((initial, fault))

    def row(self) -> tuple:
        spans = block_spans(self.rows) if self.rows else {}
        said = ";".join(f"{s}{t}{cost},{audit}" for (s, t), (cost, audit) in spans.items())
        return (*self.key, len(self.rows), *self.counts.values(), self.illegal, self.first, self.last, self.low,
                self.high, self.turns, self.last_turn, said)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about `most` characters."""
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for row in rows:
        out.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def _faults(rows: DataFrame) -> DataFrame:
    """Rows without texts: conv_id, turn, digest, dropped, initial, fault (repeats of one turn are found later)."""
    seen = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    narrow = rows.select(
        "conv_id", "turn", _digest().alias("digest"), "dropped",
        F.substring("role", 1, 1).alias("initial"),
        F.when(seen == "", "b").when(seen.isin(".", "!", "?"), "").otherwise("t").alias("fault"),
    )
    # the turn where a (role, text) is first seen, null turns first; folded in tasks before the shuffle
    place = F.struct(F.col("turn").isNotNull().alias("later"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = (
        narrow.filter("NOT dropped AND fault <> 'b'").groupBy("conv_id", "digest")
        .agg(F.min(place).alias("at"), F.max(place).alias("until")).filter("at <> until")
        .select(F.col("conv_id").alias("conv"), F.col("digest").alias("seen"), "at")
    )
    repeated = narrow.join(firsts, _null_safe("conv_id", "conv") & (F.col("digest") == F.col("seen")), "left")
    again = F.coalesce(place > F.col("at"), F.lit(False)) & (F.col("fault") != "b")
    return repeated.select("conv_id", "turn", "digest", "dropped", "initial",
                           F.when(again, "d").otherwise(F.col("fault")).alias("fault"))


def _spans(faults: DataFrame, block: int) -> DataFrame:
    """The blocks of conversations with their spans and counts."""
    schema = _arrow(_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            at = before = None
            for b in batches:
                for conv, turn, digest, dropped, initial, fault in zip(*(c.to_pylist() for c in b.columns)):
                    if at is None or at.key[0] != conv or len(at.rows) >= block:
                        if at:
                            yield at.row()
                        at = _Block(conv, turn, digest)
                    if not dropped:
                        same = (conv, turn, digest)  # equal rows of a turn lie side by side
                        at.add(turn, digest, initial, "d" if same == before and fault != "b" else fault)
                        before = same
            if at:
                yield at.row()

        yield from _batches(blocks(), schema)

    keys = ("conv_id", "turn", "digest")
    dealt = faults.repartitionByRange(tasks(faults.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, _SPANS)


_AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audits(spans: DataFrame) -> DataFrame:
    """One row per conversation: counts, cost and audit of the lightest derivation over all its blocks."""
    schema = _arrow(_AUDITS)

    def parse(said: str) -> dict[tuple[int, int], Weight]:
        out = {}
        for x in said.split(";"):
            cost, audit = x[2:].split(",")
            out[int(x[0]), int(x[1])] = (int(cost), audit)
        return out

    def close(conv: int | None, blocks: list[tuple]) -> tuple:
        n, blank, duplicate, truncated, illegal, turns, low, high = 0, 0, 0, 0, 0, 0, None, None
        last = last_turn = None
        weights = []
        for size, b, d, t, i, first, end, lo, hi, count, end_turn, first_turn, said in blocks:
            if not size:
                continue
            illegal += i + (last is not None and last + first not in ("su", "ua", "au"))
            turns += count - (last_turn is not None and lo == last_turn)
            blank, duplicate, truncated, n = blank + b, duplicate + d, truncated + t, n + size
            low = lo if low is None else low
            high = hi if hi is not None else high
            last, last_turn = end, end_turn
            weights.append(parse(said))
        cost, audit = join_spans(weights) if weights else (0, "")
        return conv, high - low + 1 - turns if turns else 0, blank, duplicate, truncated, illegal, cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            conv, blocks = None, []
            for b in batches:
                for key, *rest in zip(*(c.to_pylist() for c in b.columns)):
                    if blocks and key != conv:
                        yield close(conv, blocks)
                        blocks = []
                    conv = key
                    blocks.append(rest)
            if blocks:
                yield close(conv, blocks)

        yield from _batches(each(), schema)

    order = ("conv_id", "turn", "digest")
    dealt = spans.repartition(tasks(spans.sparkSession), "conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high",
                        "turns", "last_turn", F.col("turn").alias("first_turn"), "spans").mapInArrow(run, _AUDITS)


def audits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of turns after damage (`damaged`): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit.

    Every conv_id of the input stays, also one that lost all its rows (zeros, empty audit); rows of null conv_id
    are one conversation. Rows go by turn, nulls first; equal turns by a digest of role and text, so results
    do not depend on the order of the input. Repeated rows are duplicates. An empty table gives no rows.
    """
    return _audits(_spans(_faults(turns), block))


_REPAIRED = "conv_id long, nth long, role string, text string"


def repair(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations, rows (conv_id, nth from 0, role, text), of turns after damage and their audits.

    Partitions hold whole conversations in order; a conversation of any length is streamed.
    """

    schema = _arrow(_REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(((c, i, role, text) for c, i, role, text in _replayed(batches)), schema)

    return _by_conversation(turns, found).mapInArrow(run, _REPAIRED)


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the digest of a conversation's repaired `role:text` rows, joined by newlines."""
    ddl = "conv_id long, repaired_sha256 string"
    schema = _arrow(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            conv = digest = None
            for c, nth, role, text in _replayed(batches, whole=True):
                if nth < 0:
                    if digest:
                        yield conv, digest.hexdigest()
                    conv, digest = c, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if nth else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            if digest:
                yield conv, digest.hexdigest()

        yield from _batches(each(), schema)

    return _by_conversation(turns, found).mapInArrow(run, ddl)


def _by_conversation(turns: DataFrame, found: DataFrame) -> DataFrame:
    """A row with the audit, then the rows of the conversation in order."""
    rows = turns.filter("NOT dropped").select(
        "conv_id", F.lit(1).alias("kind"), "turn", _digest().alias("digest"), "role", "text")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                         F.lit(b"").alias("digest"), F.lit("").alias("role"), F.col("audit").alias("text"))
    dealt = heads.union(rows).repartition(tasks(turns.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "kind", "turn", "digest").select("conv_id", "kind", "role", "text")


def _replayed(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[tuple]:
    """(conv_id, nth, role, text) of every repaired row; with `whole` a row (conv_id, -1, '', '') heads each."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    head = next(rows, None)
    while head is not None:
        conv, _, _, audit = head
        head = None

        def own() -> Iterator[tuple[str, str]]:
            nonlocal head
            for row in rows:
                if row[1] == 0:
                    head = row
                    return
                yield row[2], row[3]

        if whole:
            yield conv, -1, "", ""
        mine = own()
        for i, (role, text) in enumerate(replay(mine, audit)):
            yield conv, i, role, text
        for _ in mine:  # rows that no edit is left for: none, but it also finds the next head
            pass


def repaired_digests(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damages conversations and repairs them: the columns of `audits` and repaired_sha256 per conversation."""
    turns = damaged(conversations)
    found = stored(audits(turns, block), "audits")
    return found.join(digests(turns, found).withColumnRenamed("conv_id", "conv"), _null_safe("conv_id", "conv")).drop("conv")
