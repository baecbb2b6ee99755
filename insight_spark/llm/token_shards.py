"""Training-order materialisation: token sequences at keyed random places in fixed-stride binary shards.

Documents are cut into sequences of `length` tokens (the last one of a document is padded). The n sequences are
numbered by place of their rows in the input; a keyed Feistel permutation with cycle-walking sends number i to slot
p(i) < n. Slot s is record s % per_shard of shard s // per_shard, so training order is the files' order and
reading can resume at any slot with one seek.

A record is: doc_id (int64; the least int64 for null), piece (int32), tokens used (int32), then `length` unsigned
16-bit tokens, all little-endian. A manifest is not needed: place follows from the slot.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, scratch, slices, stored, worker_cache

LENGTH, PER_SHARD, END_ID, KEY, ROUNDS = 512, 32_768, 50_256, 20_240_607, 4
_GAPS = re.compile(r"\s\s|\s$")
_NO_ID = -(1 << 63)
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser of salted values."""
    x = x ^ np.uint64(salt & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of the numbers 0 to n - 1: a Feistel network on the next even number of bits, walked until below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & low
        for r in range(rounds):
            left, right = right, left ^ (_mix(right, key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & low)
        x[todo] = (left << np.uint64(half)) | right
        todo = todo[x[todo] >= np.uint64(n)]
    return x.astype(np.int64)


class _Encoder:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.exact = tiktoken.Encoding("exact", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # without runs of white space its lookahead finds nothing, and the pattern without it is faster
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return (self.exact if _GAPS.search(text) else self.plain).encode_ordinary(text)


def _encoder(path: str, pattern: str) -> _Encoder:
    return worker_cache(f"tiktoken {path} {pattern}", lambda: _Encoder(path, pattern))


def write(docs: DataFrame, path: str, pattern: str, folder: str | None = None, length: int = LENGTH,
          per_shard: int = PER_SHARD, end_id: int = END_ID, key: int = KEY) -> DataFrame:
    """Writes the shards and returns, per sequence, slot, shard, offset (bytes), doc_id, piece, n_tokens, record_crc32.

    docs must be rows read from files, as the first pass counts the sequences of every scan task and the second
    numbers them: if the rows of a task have changed in between, the job fails. Every document, empty and null
    texts included, ends in `end_id`, so it has a sequence. Each shard is one task's, written under a
    temporary name and then moved, so a repeated task leaves the same file. Token ids must be below 65536.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch(spark)}/shards-{uuid.uuid4().hex}"
    rows = doc_texts(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, n = _encoder(path, pattern), 0
        for b in batches:
            n += sum(len(encoder.encode(t)) // length + 1 for t in b.column("text").to_pylist())
        yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": pa.array([n], pa.int64())})

    counts = dict(rows.select("text").mapInArrow(count, "task int, n long").collect())  # one row per task
    starts, total = {}, 0
    for task in sorted(counts):
        starts[task], total = total, total + counts[task]
    shards = max(1, -(-total // per_shard))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = _encoder(path, pattern), TaskContext.get().partitionId()
        at = start = starts.get(task, 0)
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for lo, hi in slices(texts):
                doc, piece, tokens = [], [], []
                for d, t in zip(ids[lo:hi], texts[lo:hi]):
                    x = np.array([*encoder.encode(t), end_id], "<u2").tobytes()
                    cut = [x[i : i + 2 * length] for i in range(0, len(x), 2 * length)]
                    doc += [d] * len(cut)
                    piece += range(len(cut))
                    tokens += cut
                slot = permute(np.arange(at, at + len(doc)), total, key)
                at += len(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array((slot // per_shard).astype(np.int32)), pa.array(doc, pa.int64()),
                     pa.array(piece, pa.int32()), pa.array(tokens, pa.binary())],
                    ["slot", "shard", "doc_id", "piece", "tokens"])
        if at - start != counts.get(task, 0):
            raise RuntimeError(f"task {task} has {at - start} sequences, not {counts.get(task, 0)}")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        names = ["slot", "shard", "offset", "doc_id", "piece", "n_tokens", "record_crc32"]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        stride, shard, out, temporary = 16 + 2 * length, None, None, ""

        def finish() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/{shard:08d}.bin")

        for b in batches:
            done = []
            for slot, at, doc, piece, tokens in zip(*(b.column(c).to_pylist() for c in ("slot", "shard", "doc_id", "piece", "tokens"))):
                if at != shard:
                    finish()
                    store.create_dir(root, recursive=True)
                    shard, temporary = at, f"{root}/.{at:08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                head = np.array([_NO_ID if doc is None else doc], "<i8").tobytes() + np.array([piece, len(tokens) // 2], "<i4").tobytes()
                record = (head + tokens).ljust(stride, b"\0")
                out.write(record)
                done.append((slot, at, (slot - at * per_shard) * stride, doc, piece, len(tokens) // 2, zlib.crc32(record)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)
        finish()

    numbered = rows.mapInArrow(number, "slot long, shard int, doc_id long, piece int, tokens binary")
    dealt = numbered.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    result = dealt.mapInArrow(
        save, "slot long, shard int, offset long, doc_id long, piece int, n_tokens int, record_crc32 long")
    return stored(result, "slots")  # the shards are written when this returns


def read(spark: SparkSession, folder: str, first: int, last: int, length: int = LENGTH, per_shard: int = PER_SHARD,
         tasks: int = 8) -> DataFrame:
    """The sequences of slots first to last - 1 (existing ones), in order within each of `tasks` parts:
    slot, doc_id, piece, tokens (array<int>). Each part seeks once per shard and then reads on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        stride = 16 + 2 * length
        for b in batches:
            slots = np.sort(b.column("id").to_numpy())
            for shard in np.unique(slots // per_shard):
                own = slots[slots // per_shard == shard]
                with store.open_input_file(f"{root}/{shard:08d}.bin") as f:
                    f.seek(int(own[0] - shard * per_shard) * stride)
                    raw = f.read(len(own) * stride)
                records = np.frombuffer(raw, np.dtype([("doc", "<i8"), ("piece", "<i4"), ("n", "<i4"), ("t", "<u2", (length,))]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[: len(records)]), pa.array([None if d == _NO_ID else d for d in records["doc"].tolist()], pa.int64()),
                     pa.array(records["piece"]), pa.array([t[:n].astype(np.int32) for t, n in zip(records["t"], records["n"])], pa.list_(pa.int32()))],
                    ["slot", "doc_id", "piece", "tokens"])

    return spark.range(first, last, 1, tasks).mapInArrow(run, "slot long, doc_id long, piece int, tokens array<int>")
