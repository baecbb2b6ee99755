"""Byte-level BPE: encoding in length-bucketed numpy matrices, and decoding.

A text is cut by the vocabulary's pattern. Distinct cuts of a batch are encoded together: cuts of similar
length are rows of one padded matrix of byte ids; in every round each row merges its leftmost
pair of minimum rank, ranks come from a hash table of pairs, and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_texts, slices, worker_cache

NONE = np.int32(2**31 - 1)
#: Cells of a matrix at most, bytes of a cut that still goes into one, and cuts a worker remembers.
CELLS, WIDEST, CACHE = 1 << 21, 256, 500_000


class PairTable:
    """Open-addressing hash table from pairs of ids to the rank (and id) of their merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, slot = self._key(left, right), None
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]  # one new pair for each free slot; the others look further
            self.keys[slot[placed]], self.ranks[slot[placed]] = keys[placed], rank[placed]
            todo = todo[~np.isin(todo, placed)]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no merge or one of the ids is below zero."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = self._key(left.reshape(-1)[todo], right.reshape(-1)[todo])
        slot, flat = self._slot(keys), out.reshape(-1)
        while len(todo):
            at = self.keys[slot]
            hit = at == keys
            flat[todo[hit]] = self.ranks[slot[hit]]
            on = ~hit & (at != -1)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class BytePairs:
    """A rank file (base64 token and rank per line) with its split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
                  if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(splits, np.int64).reshape(-1, 3).T)
        self.kept: dict[str, bytes] = {}

    def encode_cuts(self, cuts: list[bytes]) -> list[np.ndarray]:
        """Ids of each cut."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(cuts)
        buckets: dict[int, list[int]] = {}
        for i, c in enumerate(cuts):
            whole = self.ranks.get(c)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(c) > WIDEST:
                out[i] = self._merge_long(c)
            elif c:
                buckets.setdefault(1 << (len(c) - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._merge_rows([cuts[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge_rows(self, cuts: list[bytes], width: int) -> list[np.ndarray]:
        ids = np.full((len(cuts), width + 1), -1, np.int32)  # one more column is always padding
        sizes = np.array([len(c) for c in cuts])
        inside = np.arange(width + 1)[None] < sizes[:, None]
        ids[inside] = self.bytes[np.frombuffer(b"".join(cuts), np.uint8)]
        ranks, row = self.pairs.find(ids[:, :-1], ids[:, 1:]), np.arange(len(cuts))
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(cuts)
        columns = np.arange(width + 1)[None]
        while len(row):
            at = ranks.argmin(1)  # the leftmost of minimum rank
            best = ranks[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for r, x, n in zip(row[done], ids[done], sizes[done]):
                    out[r] = x[:n].copy()
                ids, ranks, row, sizes, at, best = (x[~done] for x in (ids, ranks, row, sizes, at, best))
                if not len(row):
                    break
            k = np.arange(len(row))
            ids[k, at] = best
            # close the gap behind each merge
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > at[:, None]), width), 1)
            ids[:, width] = -1
            ranks = np.take_along_axis(ranks, np.minimum(columns[:, :-1] + (columns[:, :-1] > at[:, None]), width - 1), 1)
            ranks[:, width - 1] = NONE
            ranks[k, at] = self.pairs.find(ids[k, at], ids[k, at + 1])
            before = np.maximum(at - 1, 0)
            ranks[k[at > 0], before[at > 0]] = self.pairs.find(ids[k, before], ids[k, at])[at > 0]
            sizes = sizes - 1
            if len(row) and (widest := int(sizes.max())) < width // 2:  # halve the matrix
                width = max(1, widest)
                ids, ranks, columns = ids[:, : width + 1].copy(), ranks[:, :width].copy(), columns[:, : width + 1]
                ids[:, width] = -1
        return out

    def _merge_long(self, cut: bytes) -> np.ndarray:
        """The same merges for a cut too long for a matrix: a heap of pairs by rank and place."""
        ids = self.bytes[np.frombuffer(cut, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        known: dict[tuple[int, int], int] = {}

        def rank(i: int, j: int) -> int:
            pair = (ids[i], ids[j])
            if pair not in known:
                known[pair] = int(self.pairs.find(np.array(pair[:1]), np.array(pair[1:]))[0])
            return known[pair]

        heap = [(r, i, i + 1) for i in range(n - 1) if (r := rank(i, i + 1)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if not (alive[i] and alive[j]) or after[i] != j or rank(i, j) != r:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    before[y] = x
                    if (new := rank(x, y)) != NONE:
                        heapq.heappush(heap, (new, x, y))
        return np.array([x for x, a in zip(ids, alive) if a], np.int32)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cuts = [self.pattern.findall(t) for t in texts]
        new = list(set().union(*cuts).difference(self.kept))
        if len(self.kept) + len(new) > CACHE:
            self.kept.clear()
            new = list(set().union(*cuts))
        new_ids = self.encode_cuts([c.encode() for c in new])
        self.kept.update((c, i.astype("<u4").tobytes()) for c, i in zip(new, new_ids))
        for c in cuts:
            yield b"".join(map(self.kept.__getitem__, c))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of little-endian unsigned 32-bit ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str) -> BytePairs:
    return worker_cache(f"byte pairs {path} {pattern}", lambda: BytePairs(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, ids: binary, little-endian unsigned 32-bit) of every whole text, null as empty, where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = coder(path, pattern)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts):
                ids = pa.array(pairs.encode(texts[lo:hi]), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], ids], ["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows (doc_id, bytes) of encoded rows (doc_id, ids); bytes, as ids may end inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = coder(path, pattern)
        for b in batches:
            out = pa.array((pairs.decode(x) for x in b.column("ids").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), out], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, made by encoding and decoding in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = coder(path, pattern)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in slices(texts):
                out = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(pairs.decode(i)).hexdigest())
                       for i in pairs.encode(texts[lo:hi])]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], *columns],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
