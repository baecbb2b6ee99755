"""Packing tokenised documents into fixed-length sequences by bounded-space online best-fit."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, slices, stored, worker_cache

CAPACITY = 4096
END_ID = 1
#: Open bins of one packer, and the tokens that one packer (task) gets on average.
OPEN_BINS, GROUP_TOKENS = 512, 1 << 26
#: Characters of plain texts: printable ASCII, line ends, tabs, Latin letters with one-letter lower case.
PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ÿ]*")
#: What the pre-tokenizer keeps apart from words (fixed values of the public vocabulary).
MARKS = re.compile("'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


class WordTokenizer:
    """Ids of whole texts by a byte-pair tokenizers file that lower-cases, drops white space and ends words with </w>.

    The same merges run faster in the tiktoken library: a space stands for </w>, and first joins the
    byte before it. Plain texts take that way; texts with other characters, or with the text
    of an added token, take the tokenizers file itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.added = tuple(t["content"] for t in spec["added_tokens"])
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}

        def spelled(token: str) -> bytes:
            word = token.removesuffix("</w>")
            return bytes(byte_of[c] for c in word) + b" " * (word != token)

        def merged(merge: list[str] | str) -> str:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            return left + right

        ranks, ids = {}, []
        single = [letters[b] for b in range(256)]
        for token in [*single, *(c + "</w>" for c in single), *map(merged, merges)]:
            if ranks.setdefault(spelled(token), len(ids)) == len(ids):
                ids.append(vocabulary[token])
        self.ids = np.array(ids, "<u4")
        self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for t in texts:
            if PLAIN.fullmatch(t) and not any(x in t for x in self.added):
                words = " ".join(MARKS.sub(r" \g<0> ", t.lower()).split())
                yield self.ids[self.fast.encode_ordinary(words + " ")].tobytes()
            else:
                yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, others from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Rows (doc_id, text_key, piece, start, length, ids_crc32): each document's ids and the end id, cut
    every `capacity` tokens. A null or empty text is one piece of the end id alone."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_cache(f"words {path}", lambda: WordTokenizer(path))
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, keys = b.column("doc_id").to_pylist(), b.column("text_key").to_pylist()
            for lo, hi in slices(texts):
                rows = [
                    (doc, key, k, k * capacity, len(cut) // 4, zlib.crc32(cut))
                    for doc, key, x in zip(ids[lo:hi], keys[lo:hi], tokenizer.encode(texts[lo:hi]))
                    for k, cut in enumerate(_cut(x + end, 4 * capacity))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    ["doc_id", "text_key", "piece", "start", "length", "ids_crc32"],
                )

    rows = doc_texts(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(
        run, "doc_id long, text_key long, piece long, start long, length long, ids_crc32 long"
    )


def _cut(ids: bytes, width: int) -> list[bytes]:
    return [ids[i : i + width] for i in range(0, len(ids), width)]


class BestFit:
    """Online best fit with a bounded number of open bins.

    Open bins are stacked by free space; bit f of an integer says whether a bin with f free places
    is open, so the tightest fit is the lowest set bit from the item's length on. A bin without free
    space closes at once; when too many are open, the fullest closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins, self.n_open, self.n_bins = capacity, open_bins, 0, 0
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def _pop(self, space: int) -> int:
        stack = self.free[space]
        bin_id = stack.pop()
        if not stack:
            self.bits &= ~(1 << space)
        self.n_open -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of the next item."""
        fit = self.bits >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            bin_id = self._pop(space)
        else:
            bin_id, space = self.n_bins, self.capacity
            self.n_bins += 1
        left = space - length
        if left:
            if self.n_open == self.open_bins:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            self.free[left].append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_id, self.capacity - space


def pack(items: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds sequence_id and offset (gapless from 0) to items (doc_id, text_key, piece, length: 1 to capacity, ...).

    Items are dealt by a hash of all their columns to as many packers as their tokens ask for
    (`group_tokens` each); a packer is one task that sees its items in hash order, one Arrow batch at
    a time, and keeps `open_bins` open bins and nothing else. Every item gets a place, repeated rows
    each their own; an item of null doc_id is packed as any other.
    """
    total = items.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    packers = max(1, -(-int(total) // group_tokens))
    names = items.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, task = BestFit(capacity, open_bins), TaskContext.get().partitionId()
        for b in batches:
            places = [packer.place(n) for n in b.column("length").to_pylist()]
            ids = pa.array([(task << 32) + bin_id for bin_id, _ in places], pa.int64())
            offsets = pa.array([at for _, at in places], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), ids, offsets],
                                             [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{n} {t}" for n, t in items.dtypes)
    order = F.xxhash64(*names)
    dealt = items.withColumn("_order", order).repartition(packers, "_order").sortWithinPartitions("_order", *names)
    return dealt.select(*names).mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
                   group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset; tokens are counted once, into a stored table."""
    cut = stored(pieces(docs, path, capacity), "pieces")
    return pack(cut, capacity, open_bins, group_tokens).drop("text_key")


def sequences(docs: DataFrame, packed: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences with their ids: rows (sequence_id, ids: array<int>), made from docs with distinct doc_ids.

    Ids are made again from the texts where they lie, so the only text that moves is that of the pieces.
    """
    end = int(end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_cache(f"words {path}", lambda: WordTokenizer(path))
        for b in batches:
            texts, docs_ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            for lo, hi in slices(texts):
                rows = [
                    (doc, k, cut)
                    for doc, x in zip(docs_ids[lo:hi], tokenizer.encode(texts[lo:hi]))
                    for k, cut in enumerate(_cut(x + end.to_bytes(4, "little"), 4 * capacity))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([np.frombuffer(r[2], "<i4") for r in rows], pa.list_(pa.int32()))],
                    ["doc_id", "piece", "ids"])

    cut = doc_texts(docs).mapInArrow(run, "doc_id long, piece long, ids array<int>")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(cut, ["doc_id", "piece"])
    # a sequence holds at most `capacity` pieces
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids")
    )
