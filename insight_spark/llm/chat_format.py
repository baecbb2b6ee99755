"""Chat formatting by prefix-target expansion: one training example for every assistant turn.

An example is the formatted text of all turns up to and including one assistant turn; only that reply is under the
loss mask. Turns after the last assistant turn, or a conversation without any, give one more example without
a mask, so that the longest example of a conversation always holds all its turns.

Template (fixed here): every turn is `<|turn|>role<|says|>text<|end|>`. Inside roles and texts `\\` is written
`\\\\`, `<` is `\\l` and `[` is `\\b`, so no control string that opens with `<` or `[` can occur in them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks

OPEN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
ASSISTANT = "assistant"
#: Characters of formatted text in one Arrow batch that a task sends out, about.
BATCH_CHARS = 1 << 22

_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {v: k for k, v in _ESCAPES.items()}
_ESCAPED = re.compile(r"\\[\\lb]")
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SAYS) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[0]], text) if "\\" in text else text


def format_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{SAYS}{escape(text)}{END}"


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _expand(turns: Iterator[tuple[int | None, str, str]]) -> Iterator[tuple]:
    """Examples of rows (conv_id, role, text) that come conversation by conversation, in order of turns."""
    conv, context, count, example, open_end = object(), [], 0, 0, False

    def rest() -> Iterator[tuple]:
        if open_end:
            yield conv, example, count, "".join(context), None, None

    for conv_id, role, text in turns:
        if conv_id != conv:
            yield from rest()
            conv, context, count, example = conv_id, [], 0, 0
        context.append(format_turn(role, text))
        count += 1
        open_end = role != ASSISTANT
        if not open_end:
            context = ["".join(context)]
            end = len(context[0]) - len(END)
            yield conv, example, count, context[0], end - len(escape(text)), end
            example += 1
    yield from rest()


_SCHEMA = "conv_id long, example int, n_turns int, text string, loss_start int, loss_end int"
_ARROW = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int32()), ("text", pa.string()),
                    ("loss_start", pa.int32()), ("loss_end", pa.int32())])


def examples(turns: DataFrame) -> DataFrame:
    """Training examples of conversations (conv_id, turn, role, text): conv_id, example (from 0), n_turns, text,
    loss_start and loss_end (code points of the escaped reply in text; null where nothing is trainable).

    Rows are dealt by conversation and sorted in Spark; a task holds one conversation's formatted text. Null
    roles and texts count as empty; equal turn numbers go by role and text, repeated rows are turns of their
    own, null turn numbers come first; rows of null conv_id are one conversation. The examples of a
    conversation stay together and in order.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int | None, str, str]]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        out, size = [], 0
        for x in _expand(each()):
            out.append(x)
            size += len(x[3])
            if size >= BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    dealt = rows.repartition(tasks(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, _SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from `examples` as they come: conv_id, n_turns, turns_sha256 (role, line end, text,
    line end of each turn), loss_chars, loss_sha256 (the text under the masks, unescaped), formatted_chars.

    Only the longest example's turns and each example's masked text are parsed; digests are fed piece by piece.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, loss, loss_chars, chars, out = object(), None, hashlib.sha256(), 0, 0, []

        def close() -> None:
            if last is not None:
                turns, said = parse_turns(last), hashlib.sha256()
                for role, text in turns:
                    said.update(f"{role}\n{text}\n".encode())
                out.append((conv, len(turns), said.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            columns = zip(*out) if out else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for b in batches:
            for conv_id, text, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end"))):
                if conv_id != conv:
                    close()
                    conv, loss, loss_chars, chars = conv_id, hashlib.sha256(), 0, 0
                last = text
                chars += len(text)
                if start is not None:
                    reply = unescape(text[start:end])
                    loss.update(reply.encode())
                    loss_chars += len(reply)
            if out:
                yield flush()
                out = []
        close()
        yield flush()

    return formatted.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
