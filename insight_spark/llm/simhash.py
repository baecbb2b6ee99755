"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, doc_texts, grid, stored, tasks

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Average number of fingerprints below a node where the trie is cut into cells, and most of one side of a cell.
CELL, CELL_BOUND = 4096, 65536


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if over half of the shingles' hashes have it. No words: 0."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    counts, n, starts = np.zeros(64, np.int64), len(words) - shingle + 1, [words[i:] for i in range(shingle)]
    hashes = np.fromiter((digest(s, SEED) for s in map(join, zip(*starts))), np.uint64, n)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, text_key, fp): the fingerprint as a signed long, and a hash of the text that tells
    rows of one doc_id apart. One row per input row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"]
            )

    rows = doc_texts(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _parity(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) & 1


def _masks(depth: int, bits: int) -> list[int]:
    """Differences of node labels at a depth that stay within the error budget, except none."""
    from itertools import combinations

    return [sum(1 << i for i in c) for k in range(1, bits + 1) for c in combinations(range(depth), k)]


def _cells(fps: np.ndarray, depth: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """(cells, fingerprints, side): a cell pairs one node's fingerprints ('a') with its own and other nodes' ('b').

    Of two nodes with different labels the one whose lowest differing bit equals the parity of the
    other bits takes the pair, which spreads pairs evenly.
    """
    label = (fps >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(fps), np.int64)
    yield label, fps, "a"
    yield label, fps, "b"
    for mask in _masks(depth, bits):
        low = mask & -mask
        takes = ((label & low) != 0) == (_parity(label & ~mask) == 1)
        yield label[~takes] ^ mask, fps[~takes], "b"


def trie_links(a: np.ndarray, b: np.ndarray, bits: int = MAX_BITS, leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into sorted, distinct uint64 a and b) that differ in at most `bits` bits.

    Walks both binary tries together from the top bit: a frontier of node pairs is split at each
    bit, differing children add one to the pair's error, and pairs over the budget go. Pairs with
    at most `leaf` combinations are compared directly.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(a), 4096):  # bounds the frontier
        node = np.array([[start], [min(start + 4096, len(a))], [0], [len(b)], [0]], np.int64)
        if not len(b):
            break
        for bit in range(63, -2, -1):
            small = (node[1] - node[0]) * (node[3] - node[2]) <= (leaf if bit >= 0 else np.iinfo(np.int64).max)
            if small.any():
                found.append(_compare(a, b, node[:, small], bits))
                node = node[:, ~small]
            if not node.shape[1]:
                break
            half, above = np.uint64(1 << bit), ~np.uint64((1 << (bit + 1)) - 1)
            am = np.clip(np.searchsorted(a, (a[node[0]] & above) | half), node[0], node[1])
            bm = np.clip(np.searchsorted(b, (b[node[2]] & above) | half), node[2], node[3])
            lo, hi, blo, bhi, diff = node
            node = np.concatenate(
                [np.stack(x) for x in ((lo, am, blo, bm, diff), (am, hi, bm, bhi, diff),
                                       (lo, am, bm, bhi, diff + 1), (am, hi, blo, bm, diff + 1))], axis=1)
            node = node[:, (node[0] < node[1]) & (node[2] < node[3]) & (node[4] <= bits)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _compare(a: np.ndarray, b: np.ndarray, node: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    sizes = (node[1] - node[0]) * (node[3] - node[2])
    for part in np.array_split(np.arange(node.shape[1]), max(1, int(sizes.sum() >> 20))):
        lo, _, blo, bhi, _ = node[:, part]
        n, width = sizes[part], bhi - blo
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        w = np.repeat(width, n)
        x, y = np.repeat(lo, n) + k // w, np.repeat(blo, n) + k % w
        near = np.bitwise_count(a[x] ^ b[y]) <= bits
        out.append((x[near], y[near]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) of the components of links (x, y): as many as a spanning forest has."""
    nodes, ids = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = ids[: len(x)], ids[len(x) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def links(fps: DataFrame, bits: int = MAX_BITS, cell: int = CELL, bound: int = CELL_BOUND) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp: long) that span every component of the links at
    `bits` or fewer differing bits; within a cell only a spanning forest of its links is written.

    The trie is cut at a depth that leaves about `cell` fingerprints below a node. A cell joins a
    node with itself and the nodes whose labels differ in at most `bits` bits; full cells are split.
    """
    fps = stored(fps.select("fp").distinct(), "fps")
    depth = max(0, (max(1, fps.count()) // cell).bit_length())

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cells, values, side in _cells(pdf["fp"].to_numpy().view(np.uint64), depth, bits):
                order = np.argsort(cells, kind="stable")
                keys, first = np.unique(cells[order], return_index=True)
                parts = np.split(values[order], first[1:]) if len(keys) else []
                yield pd.DataFrame({"cell": keys, "side": side, "n": [len(p) for p in parts],
                                    "fps": [p.tobytes() for p in parts]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (np.unique(np.frombuffer(b"".join(pdf.loc[pdf["side"] == s, "fps"]), np.uint64)) for s in "ab")
        x, y = trie_links(a, b, bits)
        x, y = a[x], b[y]
        x, y = _forest(x[x != y], y[x != y]) if len(x) else (x, y)
        return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    chunks = stored(fps.mapInPandas(emit, "cell long, side string, n long, fps binary"), "cells")
    dealt = grid(chunks, bound, "fps").repartition(tasks(fps.sparkSession), "cell", "i", "j")
    return dealt.groupBy("cell", "i", "j").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, text_key, fp, component (a fingerprint that names it), component_id
    (its smallest doc_id).

    Fingerprints link at `bits` or fewer differing bits and components are their transitive
    closure. Equal fingerprints are one node, so a group of copies of any size costs one row in
    the join. Texts without words share fingerprint 0. Null text counts as empty; a null doc_id is
    never a smallest one (a component of null ids only has a null component_id); repeated rows stay.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    # the smallest doc_id of each fingerprint, folded in tasks before the shuffle
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    comp = stored(components(links(firsts, bits)), "components")
    joined = firsts.join(comp, firsts["fp"] == comp["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = joined.join(smallest, "component").select("fp", "component", "component_id")
    return rows.join(ids, "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays,
    whole and with all its columns. Of rows with equal doc_id and text one stays; a null doc_id comes last.
    """
    near = near_duplicates(docs, shingle, bits)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("k")
    kept = near.groupBy("component").agg(first).select(
        F.col("k.no_id").alias("__llm_no_id"), F.coalesce("k.doc_id", F.lit(0)).alias("__llm_id"),
        F.col("k.text_key").alias("__llm_key"),
    )
    keys = ["__llm_no_id", "__llm_id", "__llm_key"]
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.withColumns({
        "__llm_no_id": doc_id.isNull(), "__llm_id": F.coalesce(doc_id, F.lit(0)),
        "__llm_key": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
    })
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return keyed.join(kept, keys).withColumn("__llm_nth", nth).filter("__llm_nth = 1").select(*docs.columns)


def hex16(fp: Column) -> Column:
    """The 16 lowercase hex digits of a signed long column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
