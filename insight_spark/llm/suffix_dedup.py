"""Removal of long repeats: suffix arrays of document batches in a family of indexes that merge geometrically.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id.

Where to look: a window of LENGTH bytes is named by the least hash of the 24-byte strings in it (its anchor), so equal
windows have equal anchors; neighbouring windows mostly share one and form a run. Each batch of documents sends its
distinct anchors, and hears which of them also stand in other documents. Only the runs of those move as
text, once per distinct string of a batch, to the task that has their anchor.

A string that an earlier doc_id says as it stands goes whole. Where strings of one anchor differ, windows are compared:
batches come in ascending ranges of doc_id. Each gets a suffix array (its windows' starts in the order of the
LENGTH bytes that follow, which is as deep as a match must be), is scanned against the levels of the index, which hold
what earlier batches said, and becomes a level itself; levels of equal rank merge, so b batches leave at most
log2(b) + 1 levels. Windows found in a level, or in the batch under a smaller doc_id, go.

Hot strings: a batch sends an anchor and a string once, however many of its documents say them. An anchor that stands in
many batches with changing surroundings is split window by window, dealt by the hash of the whole window.
Documents move once: all three steps read one exchange by batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tasks

LENGTH, ANCHOR = 50, 24
#: Ranges of doc_id in which batches enter the index; bytes of text of one batch, and of one part of the anchors.
RANGES, BATCH_BYTES, PART_BYTES = 16, 1 << 23, 1 << 24
#: Bytes of text hashed at once, and the share of batches from which on an anchor is split by windows (with a least number).
PIECE, HOT_SHARE, HOT_LEAST = 1 << 16, 0.25, 64
#: A null doc_id counts as larger than all others.
LAST = np.iinfo(np.int64).max


@dataclass
class Runs:
    """Neighbouring windows with one anchor: document, first window, number of windows, anchor."""

    doc: np.ndarray
    at: np.ndarray
    n: np.ndarray
    anchor: np.ndarray


def _anchors(data: np.ndarray, length: int) -> np.ndarray:
    """The anchor of the window at every position of data but the last length - 1."""
    n, raw = len(data) - 8, data.tobytes()
    eight = np.empty(n + 1, np.uint64)
    for r in range(8):
        part = eight[r::8]
        part[:] = np.frombuffer(raw, "<u8", len(part), r)
    h = eight[:-16] * np.uint64(0x9E3779B97F4A7C15)
    for word, factor in ((eight[8:-8], 0xBF58476D1CE4E5B9), (eight[16:], 0x94D049BB133111EB)):
        h ^= h >> np.uint64(29)
        h += word
        h *= np.uint64(factor)
    h ^= h >> np.uint64(32)
    width, size = length - ANCHOR + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :])


def runs_of(texts: list[bytes], length: int = LENGTH) -> Runs:
    """The runs of all texts; texts shorter than `length` bytes have none. A long text is cut between windows."""
    found, part, size = [], [], 0

    def close() -> None:
        data = np.frombuffer(b"".join(texts[i][a : a + PIECE + length - 1] for i, a in part), np.uint8)
        lengths = np.array([min(PIECE + length - 1, len(texts[i]) - a) for i, a in part])
        docs, shifts = np.array(part).T
        least, ends = _anchors(data, length), np.cumsum(lengths)
        piece = np.repeat(np.arange(len(part)), lengths)[: len(least)]
        whole = np.arange(len(least)) + length <= ends[piece]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(new)
        sizes = np.add.reduceat(whole, first)
        first, sizes = first[whole[first]], sizes[whole[first]]
        own = piece[first]
        found.append((docs[own], first - (ends - lengths)[own] + shifts[own], sizes, least[first]))

    for i, text in enumerate(texts):
        for a in range(0, len(text) - length + 1, PIECE):
            part.append((i, a))
            size += min(PIECE, len(text) - a)
            if size >= PIECE:
                close()
                part, size = [], 0
    if part:
        close()
    if not found:
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found)))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one type and length, one after another, compressed."""
    import zstandard

    return zstandard.compress(np.concatenate(columns).tobytes()) if columns else b""


def _unpack(blobs: list[bytes], kind: type, columns: int = 1) -> list[np.ndarray]:
    """For each blob its columns as rows of an array."""
    import zstandard

    return [np.frombuffer(zstandard.decompress(b), kind).reshape(columns, -1) for b in blobs]


def _ordered(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    """doc_ids and texts of a batch, in an order that does not depend on how its rows came."""
    rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return [r[0] for r in rows], [r[1] for r in rows]


def _numbers(ids: list[int | None]) -> np.ndarray:
    return np.array([LAST if i is None else i for i in ids], np.int64)


_ANCHORS = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("anchors", pa.binary()), ("several", pa.binary())])
_SHARED = pa.schema([("batch", pa.int64()), ("part", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())])
_STRINGS = pa.schema([("part", pa.int64()), ("batch", pa.int64()), ("range", pa.int32()), ("text", pa.binary()),
                      ("sizes", pa.binary()), ("owners", pa.binary()), ("places", pa.binary())])
_SPANS = pa.schema([("batch", pa.int64()), ("spans", pa.binary())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()),
                     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])
_RESULT_DDL = "doc_id long, n_bytes long, spans array<struct<start: bigint, stop: bigint>>, kept binary"


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _by_part(values: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values by part, the parts there are, where each begins)."""
    values = np.unique(values)
    part = (values % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return values[order], *np.unique(part[order], return_index=True)


def _batch_anchors(table: pa.Table, parts: int, length: int) -> pa.Table:
    """The distinct anchors of a batch, by part, and whether several of its documents have them."""
    ids, texts = _ordered(table)
    batch, runs, numbers = table["batch"][0].as_py(), runs_of(texts, length), _numbers(ids)
    if not len(runs.anchor):
        return _table([], _ANCHORS)
    order = np.argsort(runs.anchor, kind="stable")  # runs come by doc_id
    anchors, docs = runs.anchor[order], numbers[runs.doc[order]]
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    last = np.append(first[1:], len(anchors)) - 1
    several = anchors[first][docs[first] != docs[last]]
    anchors, keys, cut = _by_part(anchors, parts)
    out = [(int(k), batch, own.tobytes(), np.isin(own, several).tobytes())
           for k, own in zip(keys, np.split(anchors, cut[1:]))]
    return _table(out, _ANCHORS)


def _shared_anchors(table: pa.Table, hot: int) -> pa.Table:
    """For each batch which of its anchors of one part more than one document has, and which `hot` batches or more do."""
    anchors = [np.frombuffer(x, np.uint64) for x in table["anchors"].to_pylist()]
    several = np.concatenate([np.frombuffer(x, bool) for x in table["several"].to_pylist()])
    _, ids, count = np.unique(np.concatenate(anchors), return_inverse=True, return_counts=True)
    shared, many = (count > 1)[ids] | (np.bincount(ids, several) > 0)[ids], (count >= hot)[ids]
    cut = np.cumsum([len(x) for x in anchors])[:-1]
    out = [(batch, part, np.packbits(s).tobytes(), np.packbits(h).tobytes()) for batch, part, s, h in zip(
        table["batch"].to_pylist(), table["part"].to_pylist(), np.split(shared, cut), np.split(many, cut)) if s.any()]
    return _table(out, _SHARED)


def _batch_strings(table: pa.Table, answers: pa.Table, parts: int, length: int) -> pa.Table:
    """The distinct strings of a batch's shared runs with their smallest doc_id and their places under it.

    What stands in a document of the batch with a larger doc_id goes at once; its spans travel as a part of their own.
    """
    if not len(table) or not len(answers):
        return _table([], _STRINGS)
    import xxhash

    ids, texts = _ordered(table)
    batch, at_range, numbers = table["batch"][0].as_py(), table["range"][0].as_py(), _numbers(ids).tolist()
    runs = runs_of(texts, length)
    anchors, keys, cut = _by_part(runs.anchor, parts)
    own = dict(zip(keys.tolist(), np.split(anchors, cut[1:])))
    known, hot = [], []
    for row in answers.to_pylist():
        mine = own[row["part"]]
        shared, many = (np.unpackbits(np.frombuffer(row[c], np.uint8), count=len(mine)).astype(bool) for c in ("shared", "hot"))
        known.append(mine[shared])
        hot.append(many[shared])
    known, hot = np.concatenate(known), np.concatenate(hot)
    order = np.argsort(known)
    known, hot = known[order], hot[order]
    found = np.minimum(np.searchsorted(known, runs.anchor), len(known) - 1)
    take = np.flatnonzero(known[found] == runs.anchor)
    rows = zip(*(x[take].tolist() for x in (runs.doc, runs.at, runs.n)), (runs.anchor[take] % np.uint64(parts)).tolist(),
               hot[found[take]].tolist())
    index: dict[bytes, int] = {}
    owners: list[int] = []
    part_of: list[int] = []
    places: list[int] = []
    gone: list[int] = []
    more = length - 1
    for doc, at, n, part, split in rows:
        text, number = texts[doc], numbers[doc]
        for a, size in ((a, 1) for a in range(at, at + n)) if split else ((at, n),):
            said = text[a : a + size + more]
            k = index.setdefault(said, len(owners))
            if k == len(owners):
                owners.append(number)
                part_of.append(xxhash.xxh64_intdigest(said) % parts if split else part)
            if owners[k] == number:  # documents come by doc_id, so the first one's is the smallest
                places += (k, doc, a)
            else:
                gone += (doc, a, a + size + more)
    strings, part, owner = list(index), np.array(part_of), np.array(owners, np.int64)
    place = np.array(places, np.int64).reshape(-1, 3).T
    place_part, out = part[place[0]], []
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        said, held = [strings[i] for i in mine], place[:, place_part == p]
        out.append((int(p), batch, at_range, _pack(np.frombuffer(b"".join(said), np.uint8)),
                    _pack(np.array([len(x) for x in said], np.uint32)), _pack(owner[mine]),
                    _pack(np.searchsorted(mine, held[0]).astype(np.uint32), *held[1:].astype(np.uint32))))
    if gone:
        spans = np.array(gone, np.uint32).reshape(-1, 3).T
        out.append((-1 - batch % parts, batch, at_range, b"", b"", b"", _pack(*spans)))
    return _table(out, _STRINGS)


def suffix_array(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(starts in the order of the `length` bytes that follow each, those bytes as sorted keys)."""
    keys = np.lib.stride_tricks.sliding_window_view(data, length)[starts].view(f"S{length}").ravel()
    order = np.argsort(keys, kind="stable")
    return starts[order], keys[order]


class Levels:
    """Sorted sets of keys; two of equal rank merge into one of the next rank."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray]] = []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted keys some level holds."""
        found = np.zeros(len(keys), bool)
        for _, level in self.levels:
            at = np.searchsorted(level, keys)
            found |= level[np.minimum(at, len(level) - 1)] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        """A new level of sorted distinct keys that no other level holds."""
        rank = 0
        if not len(keys):
            return
        while self.levels and self.levels[-1][0] == rank:
            other = self.levels.pop()[1]
            keys = np.insert(other, np.searchsorted(other, keys), keys)
            rank += 1
        self.levels.append((rank, keys))


def _spans_of_hits(hits: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(string, start, stop) of the bytes under neighbouring hits; hits are by window, strings one after another."""
    string = np.repeat(np.arange(len(sizes)), sizes - length + 1)
    within = np.arange(len(hits)) - np.repeat(np.cumsum(sizes - length + 1) - (sizes - length + 1), sizes - length + 1)
    at = np.flatnonzero(hits)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (string[at[1:]] != string[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return string[at[first]], within[at[first]], within[at[last]] + length


def _repeats(strings: list[bytes], owners: np.ndarray, ranges: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(string, start, stop) of what strings of `owners` repeat from smaller doc_ids; ranges enter the index in order.

    Each batch of one range gets a suffix array, is scanned against the levels and becomes a level.
    """
    levels, found = Levels(), []
    for r in np.unique(ranges):
        batch = np.flatnonzero(ranges == r)
        data = np.frombuffer(b"".join(strings[i] for i in batch), np.uint8)
        sizes = np.array([len(strings[i]) for i in batch])
        windows = sizes - length + 1
        starts = np.arange(windows.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(windows) - windows), windows)
        order, keys = suffix_array(data, starts, length)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        known, group = levels.scan(keys[first]), np.cumsum(new) - 1
        owner = np.repeat(owners[batch], sizes)[order]
        hits = np.zeros(len(data), bool)
        hits[order] = known[group] | (owner > np.minimum.reduceat(owner, first)[group])
        levels.add(keys[first[~known]])
        string, start, stop = _spans_of_hits(hits[starts], sizes, length)
        found.append((batch[string], start, stop))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def _matches(table: pa.Table, length: int) -> pa.Table:
    """Spans (doc, start, stop) of each batch from the strings of one part.

    A string goes whole where a smaller doc_id says the same one. Where an anchor has but one string nothing else
    can match; the strings of other anchors are looked up window by window.
    """
    batches, out = table["batch"].to_pylist(), []
    if table["part"][0].as_py() < 0:
        return _table(list(zip(batches, table["places"].to_pylist())), _SPANS)
    index: dict[bytes, int] = {}
    which, owners = [], np.concatenate([x[0] for x in _unpack(table["owners"].to_pylist(), np.int64)])
    texts, sizes = _unpack(table["text"].to_pylist(), np.uint8), _unpack(table["sizes"].to_pylist(), np.uint32)
    for text, size in zip(texts, sizes):
        text, ends = text[0].tobytes(), np.cumsum(size[0], dtype=np.int64)
        which += [index.setdefault(text[a:b], len(index)) for a, b in zip((ends - size[0]).tolist(), ends.tolist())]
    strings, which = list(index), np.array(which)
    ranges = np.repeat(table["range"].to_numpy(), [x.shape[1] for x in sizes])
    least, entered = np.full(len(strings), LAST), np.full(len(strings), np.iinfo(np.int32).max)
    np.minimum.at(least, which, owners)
    np.minimum.at(entered, which, ranges)
    heads = np.frombuffer(b"".join(x[:length] for x in strings), np.uint8)
    anchors = np.concatenate([_anchors(heads[i : i + PIECE * length], length)[::length] for i in range(0, len(heads), PIECE * length)])
    _, ids, count = np.unique(anchors, return_inverse=True, return_counts=True)
    contested = np.flatnonzero(count[ids] > 1)
    string, start, stop = _repeats([strings[i] for i in contested], least[contested], entered[contested], length)
    # spans of string i by i, and the whole of string i by len(strings) + i
    n, lengths = len(strings), np.array([len(x) for x in strings])
    by = np.concatenate([contested[string], n + np.arange(n)])
    start, stop = np.concatenate([start, np.zeros(n, np.int64)]), np.concatenate([stop, lengths])
    order = np.argsort(by, kind="stable")
    start, stop, edges = start[order], stop[order], np.searchsorted(by[order], np.arange(2 * n + 1))
    key, base = which + n * (owners > least[which]), 0
    for batch, size, places in zip(batches, sizes, _unpack(table["places"].to_pylist(), np.uint32, 3)):
        own = key[base + places[0]]
        many = edges[own + 1] - edges[own]
        take = np.repeat(edges[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        doc, shift = np.repeat(places[1], many), np.repeat(places[2], many)
        if len(take):
            out.append((batch, _pack(*(x.astype(np.uint32) for x in (doc, shift + start[take], shift + stop[take])))))
        base += size.shape[1]
    return _table(out, _SPANS)


def _apply(table: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a batch without the spans found in them."""
    if not len(table):
        return _table([], _RESULT)
    ids, texts = _ordered(table)
    spans = np.concatenate([np.empty((3, 0), np.int64), *_unpack(found["spans"].to_pylist(), np.uint32, 3)], axis=1).T
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    edges = np.searchsorted(spans[:, 0], np.arange(len(ids) + 1))
    out = []
    for i, (doc, text) in enumerate(zip(ids, texts)):
        merged: list[list[int]] = []
        for _, start, stop in spans[edges[i] : edges[i + 1]].tolist():
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([start, stop])
        cuts = [0, *(x for span in merged for x in span), len(text)]
        kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
        out.append((doc, len(text), [{"start": a, "stop": b} for a, b in merged], kept))
    return _table(out, _RESULT)


def _dealt(docs: DataFrame, ranges: int, batch_bytes: int) -> tuple[DataFrame, int, int]:
    """Rows (doc_id, text as bytes, range, batch), the number of batches and the bytes of text.

    Ranges follow doc_id, null last; a range has as many batches as its bytes fill, dealt by the hash of the
    row, so rows of one doc_id are spread as well. The driver sees a few numbers for each range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    shares = [(i + 1) / ranges for i in range(ranges - 1)]
    bounds = sorted(set(rows.select(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []))
    above = F.lit(0)
    for b in bounds:
        above = above + (F.col("doc_id") > b).cast("int")
    rows = rows.withColumn("range", F.coalesce(above, F.lit(len(bounds) + 1)))
    sizes = dict(rows.groupBy("range").agg(F.sum(F.length("text"))).collect())
    total = sum(sizes.values())
    # enough batches for all tasks, of no more than batch_bytes on average
    wanted = max(total // batch_bytes, 2 * tasks(docs.sparkSession))
    counts = [max(1, -(-sizes.get(r, 0) * wanted // max(1, total))) for r in range(len(bounds) + 2)]
    nth = F.pmod(F.xxhash64("doc_id", "text"), F.element_at(F.array(*map(F.lit, counts)), F.col("range") + 1))
    return rows.withColumn("batch", F.col("range") * F.lit(1 << 40) + nth), sum(counts), total


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, ranges: int = RANGES, batch_bytes: int = BATCH_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (of the text as UTF-8), spans (start, stop; the longest runs of bytes
    that go, in order, not touching), kept (the bytes left).

    Bytes go that are covered by a string of `length` bytes which also starts in a document with a smaller doc_id;
    all texts are judged as they came. Null texts are empty. Rows of one doc_id take nothing from each
    other; null doc_ids count as one that is larger than all others. Repeated rows stay and get equal
    results. Texts below `length` bytes keep all. `length` is at least 25. An empty table gives no rows.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    rows, batches, total = _dealt(docs, ranges, batch_bytes)
    parts = int(max(total // part_bytes, tasks(docs.sparkSession)))
    hot = int(max(HOT_LEAST, HOT_SHARE * batches))
    texts = rows.groupBy("batch")
    anchors = texts.applyInArrow(lambda t: _batch_anchors(t, parts, length), _ddl(_ANCHORS))
    shared = anchors.groupBy("part").applyInArrow(lambda t: _shared_anchors(t, hot), _ddl(_SHARED))
    strings = texts.cogroup(shared.groupBy("batch")).applyInArrow(
        lambda t, s: _batch_strings(t, s, parts, length), _ddl(_STRINGS))
    spans = strings.groupBy("part").applyInArrow(lambda t: _matches(t, length), _ddl(_SPANS))
    return texts.cogroup(spans.groupBy("batch")).applyInArrow(_apply, _RESULT_DDL)
