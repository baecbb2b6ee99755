"""Collocations: each language's best-scoring phrases by best-first branch and bound over growing prefixes.

A phrase of 2 to 4 words that occurs at least 30 times is a candidate; its score is the lowest of
floor(2000000 * a / (l + r)) over its cuts in two. For every extension e of a prefix p, f(e) <= f(p), and the cut
after the first word has r >= f(e). So score(e) <= floor(2000000 * f(p) / (f(first word) + f(p))), the bound
of p, which never grows as p does. The frontier holds the prefixes not yet extended. A round opens all
prefixes of a language whose bound reaches a level, best bounds first, counts their extensions, and
settles which candidates at or above the level survive; the level falls until 2000 survivors of the language
stand at or above it, so that nothing below the frontier can reach them, ties included.

A candidate falls to any longer candidate with four fifths of its occurrences. Then the phrase one word longer in
between has as many, so looking at extensions by one word, on the right (they are opened with the
candidate, whose score its bound covers) and on the left (counted as probes), is enough.

Counting: words are counted by language and text, then pairs of words that both reach 30, folded in the task by
blocks of text. What is left of the texts for longer phrases are runs in which every pair of neighbours reaches 30;
equal runs are one row with a count, and all rounds read only those. Tasks know sets of words and
prefixes by bitmaps of a fixed size: a false hit counts a phrase that is filtered later, never loses one.
Words are 64-bit hashes; two words of a language with one hash are looked for, and change the seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tasks

LEAST, MOST_WORDS, TOP, SCALE = 30, 4, 2000, 2_000_000
#: Bits of the bitmaps that tell tasks which words and prefixes count: 2 MB each, whatever the size of the corpus.
FILTER_BITS = 1 << 24
#: Bytes of text that a task tokenises at once.
BLOCK = 1 << 22

_CLASSES = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c in b" \t" else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _blocks(blob: bytes, most: int) -> Iterator[bytes]:
    """Parts of about `most` bytes, cut at ends of pieces."""
    at = 0
    while at < len(blob):
        end = len(blob) if len(blob) - at <= most else blob.rfind(b"\n", at, at + most) + 1
        if end <= at:
            end = blob.find(b"\n", at + most) + 1 or len(blob)
        yield blob[at:end]
        at = end


def tokenize(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, their codes in order, whether the next word is in the same piece) of classed bytes."""
    b = np.frombuffer(block, np.uint8)
    inside = (b != 32) & (b != 10)
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [], np.empty(0, np.int64), np.empty(0, bool)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])])
    coded = words.dictionary_encode()
    piece = np.cumsum(b == 10, dtype=np.int32)[starts]
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.append(piece[1:] == piece[:-1], False)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, block of classed bytes) of the texts of a batch."""
    langs = batch.column("lang").dictionary_encode()
    codes, texts = langs.indices.to_numpy(zero_copy_only=False), batch.column("text")
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        blob = b"\n".join(texts.take(pa.array(np.flatnonzero(codes == i))).to_pylist()).translate(_CLASSES)
        for block in _blocks(blob, BLOCK):
            yield lang, block


def _sent(columns: list, names: list[str], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Columns as batches of few rows, so that neither side of the pipe holds many at once."""
    batch = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _hashes(words: list[bytes], seed: int) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words)).view(np.int64)


def _slots(lang: str | np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """The bit of the filter that stands for (lang, words)."""
    import xxhash

    first = np.uint64(xxhash.xxh64_intdigest(lang)) if isinstance(lang, str) else lang
    h = np.zeros(len(keys[0]), np.uint64) + first
    for k in keys:
        h = (h ^ k.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return (h % np.uint64(FILTER_BITS)).astype(np.int64)


class Filter:
    """A set of (lang, words) as a bitmap of FILTER_BITS bits, which tasks get by broadcast."""

    def __init__(self, rows: DataFrame, keys: list[str]) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for b in batches:
                langs = b.column(0).dictionary_encode()
                named = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)
                slots = np.unique(_slots(named[langs.indices.to_numpy()],
                                         [c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]))
                yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.int64(1) << (slots & 63))], ["at", "bits"])

        parts = rows.select("lang", *keys).mapInArrow(run, "at long, bits long")
        found = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
        bits = np.zeros(FILTER_BITS >> 6, np.int64)
        bits[found["at"].to_numpy()] = found["bits"].to_numpy()
        self.bits: Broadcast = rows.sparkSession.sparkContext.broadcast(bits)

    def has(self, lang: str, *keys: np.ndarray) -> np.ndarray:
        slots = _slots(lang, [np.ascontiguousarray(k) for k in keys])
        return (self.bits.value[slots >> 6] >> (slots & 63)) & 1 == 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def _word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """lang, w1 (hash), word, a: every word of every language with its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, block in _by_lang(b):
                words, codes, _ = tokenize(block)
                n = np.bincount(codes, minlength=len(words))
                yield from _sent(
                    [pa.repeat(lang, len(words)), pa.array(_hashes(words, seed)), pa.array(words, pa.binary()), pa.array(n)],
                    ["lang", "w1", "word", "a"])

    rows = texts.mapInArrow(run, "lang string, w1 long, word binary, a long")
    return rows.groupBy("lang", "w1", "word").agg(F.sum("a").alias("a"))


def _pair_counts(texts: DataFrame, words: Filter, seed: int) -> DataFrame:
    """lang, w1, w2, a of neighbouring words that both reach LEAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, block in _by_lang(b):
                distinct, codes, joined = tokenize(block)
                if not len(codes):
                    continue
                h = _hashes(distinct, seed)
                often = words.has(lang, h)[codes]
                at = np.flatnonzero(joined[:-1] & often[:-1] & often[1:])
                key, n = np.unique(codes[at] * len(distinct) + codes[at + 1], return_counts=True)
                yield from _sent(
                    [pa.repeat(lang, len(key)), pa.array(h[key // len(distinct)]), pa.array(h[key % len(distinct)]), pa.array(n)],
                    ["lang", "w1", "w2", "a"])

    rows = texts.mapInArrow(run, "lang string, w1 long, w2 long, a long")
    return rows.groupBy("lang", "w1", "w2").agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)


def _runs(texts: DataFrame, pairs: Filter, seed: int) -> DataFrame:
    """lang, words, n: the longest stretches of three and more words in which all pairs of neighbours reach LEAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, block in _by_lang(b):
                distinct, codes, joined = tokenize(block)
                if not len(codes):
                    continue
                h = _hashes(distinct, seed)[codes]
                go_on = joined.copy()
                at = np.flatnonzero(joined)
                go_on[at] = pairs.has(lang, h[at], h[at + 1])
                edge = np.diff(np.concatenate([[0], go_on.view(np.int8), [0]]))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
                starts, ends = starts[ends - starts >= 3], ends[ends - starts >= 3]
                inside = np.zeros(len(h) + 1, np.int8)
                inside[starts] += 1
                inside[ends] -= 1
                offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
                values = pa.array(h[np.cumsum(inside[:-1]) == 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(starts)), pa.ListArray.from_arrays(pa.array(offsets), values)], ["lang", "words"])

    rows = texts.mapInArrow(run, "lang string, words array<bigint>")
    return rows.groupBy("lang", "words").agg(F.count("*").alias("n"))


def _windows(batch: pa.RecordBatch, size: int) -> Iterator[tuple[str, list[np.ndarray], np.ndarray]]:
    """(lang, columns of words, counts) of all phrases of `size` words in a batch of runs."""
    langs = batch.column("lang").dictionary_encode()
    codes, lists, n = langs.indices.to_numpy(), batch.column("words"), batch.column("n").to_numpy()
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), np.diff(offsets))
    values = values[offsets[0] : offsets[-1]]
    whole = np.flatnonzero(owner[size - 1 :] == owner[: len(owner) - size + 1]) if len(owner) >= size else np.empty(0, np.int64)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        at = whole[codes[owner[whole]] == i]
        yield lang, [values[at + k] for k in range(size)], n[owner[at]]


def _phrase_counts(runs: DataFrame, size: int, prefixes: Filter, suffixes: Filter) -> DataFrame:
    """lang, w1 to w`size`, a >= LEAST, of phrases with an opened prefix or a probed suffix."""
    keys = [f"w{k + 1}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, n in _windows(b, size):
                take = prefixes.has(lang, *words[:-1]) | suffixes.has(lang, *words[1:])
                words, n = [w[take] for w in words], n[take]
                order = np.lexsort(words)
                words, n = [w[order] for w in words], n[order]
                new = np.ones(len(n), bool)
                new[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0)
                first = np.flatnonzero(new)
                sums = np.add.reduceat(n, first) if len(first) else n
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(first)), *(pa.array(w[first]) for w in words), pa.array(sums)], ["lang", *keys, "a"])

    rows = runs.mapInArrow(run, f"lang string, {', '.join(f'{k} long' for k in keys)}, a long")
    return rows.groupBy("lang", *keys).agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)


def _ratio(a: str, *total: str) -> Column:
    """floor(SCALE * a / sum of total), exactly: products and sums are decimals of 38 digits."""
    parts = " + ".join(f"CAST({c} AS DECIMAL(19, 0))" for c in total)
    return F.expr(f"(CAST({a} AS DECIMAL(19, 0)) * {SCALE}) DIV ({parts})")


def _scored(rows: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """With score, l and r of the lowest-scoring cut (ties: the shortest first part), and the bound of extensions."""
    each = [F.struct(_ratio("a", x, y).alias("score"), F.lit(k).alias("k"),
                     F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts)]
    low = F.least(*each) if len(each) > 1 else each[0]
    return rows.withColumn("low", low).withColumns({
        "score": F.col("low.score"), "l": F.col("low.l"), "r": F.col("low.r"),
        "bound": _ratio("a", "f1", "a"),
    }).drop("low")


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(old).alias(new) for old, new in names.items()))


def _score_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    first = _renamed(words, {"lang": "lang", "w1": "w1", "a": "f1"})
    second = _renamed(words, {"lang": "lang", "w1": "w2", "a": "f2"})
    return _scored(pairs.join(first, ["lang", "w1"]).join(second, ["lang", "w2"]), [("f1", "f2")])


def _score_threes(threes: DataFrame, pairs: DataFrame) -> DataFrame:
    head = _renamed(pairs, {"lang": "lang", "w1": "w1", "w2": "w2", "a": "f12", "f1": "f1"})
    tail = _renamed(pairs, {"lang": "lang", "w1": "w2", "w2": "w3", "a": "f23", "f2": "f3"})
    joined = threes.join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    return _scored(joined, [("f1", "f23"), ("f12", "f3")])


def _score_fours(fours: DataFrame, threes: DataFrame) -> DataFrame:
    head = _renamed(threes, {"lang": "lang", "w1": "w1", "w2": "w2", "w3": "w3", "a": "f123", "f1": "f1", "f12": "f12"})
    tail = _renamed(threes, {"lang": "lang", "w1": "w2", "w2": "w3", "w3": "w4", "a": "f234", "f23": "f34", "f3": "f4"})
    joined = fours.join(head, ["lang", "w1", "w2", "w3"]).join(tail, ["lang", "w2", "w3", "w4"])
    return _scored(joined, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")])


def _surviving(rows: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """Rows without those that a phrase of one more word holds at four fifths of their occurrences."""
    keys = [f"w{k + 1}" for k in range(size)]
    right = longer.select("lang", *keys, F.col("a").alias("more"))
    left = longer.select("lang", *(F.col(f"w{k + 2}").alias(f"w{k + 1}") for k in range(size)), F.col("a").alias("more"))
    most = right.union(left).groupBy("lang", *keys).agg(F.max("more").alias("more"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = F.col("more").isNull() | (wide("more") * 100 < wide("a") * 80)
    return rows.join(most, ["lang", *keys], "left").filter(kept).drop("more")


def _levels(pairs: DataFrame, wanted: int) -> DataFrame:
    """lang, level: a score that about `wanted` pairs of the language reach, 0 where it has no more than that."""
    step = F.expr("score DIV 1000")
    steps = pairs.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))  # at most 1001 rows a language
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    reached = steps.withColumn("above", above).groupBy("lang").agg(
        F.max(F.when(F.col("above") >= wanted, F.col("step"))).alias("step"))
    return reached.select("lang", F.coalesce(F.col("step") * 1000, F.lit(0)).cast("long").alias("level"))


def _top(rows: DataFrame, keys: list[str], top: int, order: list[Column]) -> DataFrame:
    """The first `top` rows of each language with their ties; a language is cut in as many parts as there are tasks first."""
    part = F.pmod(F.xxhash64(*keys), F.lit(tasks(rows.sparkSession)))
    rank = F.rank().over(Window.partitionBy("lang", "part").orderBy(*order))
    rows = rows.withColumn("part", part).withColumn("nth", rank).filter(F.col("nth") <= top)
    return rows.withColumn("nth", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("nth") <= top)


def _open(rows: DataFrame, what: str, levels: DataFrame) -> DataFrame:
    """Rows whose `what` (bound or score) has come into reach in this round."""
    at = rows.join(levels, "lang")
    return at.filter((F.col(what) >= F.col("level")) & (F.col("before").isNull() | (F.col(what) < F.col("before"))))


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first `top` phrases by score and a descending,
    phrase ascending in UTF-8 byte order.

    Null texts count as empty, a null lang as `und`. Repeated rows count as often as they stand; ties are told apart
    by the phrase, so the result is the same for any order of rows. A language without candidates gives
    no rows, and neither does an empty table. Other columns of docs do not matter.
    """
    texts = _texts(docs)
    for seed in count(42):
        words = stored(_word_counts(texts, seed), "words")
        if words.groupBy("lang", "w1").count().filter("count > 1").isEmpty():
            break
    sizes = words.groupBy("lang").agg(F.sum("a").alias("n"))
    often = stored(words.filter(F.col("a") >= LEAST), "often")
    pairs = _pair_counts(texts, Filter(often, ["w1"]), seed)
    pairs = stored(_score_pairs(pairs, often), "pairs")
    runs = stored(_runs(texts, Filter(pairs, ["w1", "w2"]), seed), "runs")

    two, three, four = ["w1", "w2"], ["w1", "w2", "w3"], ["w1", "w2", "w3", "w4"]
    threes = fours = scored = levels = None
    wanted = 2 * top
    while True:
        before = (levels.select("lang", F.col("level").alias("before")) if levels is not None
                  else pairs.select("lang", F.lit(None).cast("long").alias("before")).distinct())
        levels = _levels(pairs, wanted).join(before, "lang")
        if scored is not None:  # a settled language keeps its level
            levels = levels.join(settled, "lang", "left").withColumn(
                "level", F.when(F.col("settled"), F.col("before")).otherwise(F.least("level", "before"))).drop("settled")
        levels = stored(levels, "levels")

        more = _phrase_counts(runs, 3, Filter(_open(pairs, "bound", levels), two), Filter(_open(pairs, "score", levels), two))
        threes = _united(threes, stored(_score_threes(more, pairs), "threes"), three)
        opened = _open(threes, "bound", levels)
        # phrases of four words also need the counts of their last three
        inner = _renamed(opened, {"lang": "lang", "w2": "w1", "w3": "w2"})
        none = Filter(pairs.limit(0), two)
        tails = _phrase_counts(runs, 3, Filter(inner, two), none)
        threes = _united(threes, stored(_score_threes(tails, pairs), "tails"), three)
        opened, probed = _open(threes, "bound", levels), _open(threes, "score", levels)
        more = stored(_phrase_counts(runs, 4, Filter(opened, three), Filter(probed, three)), "fours")
        fours = _united(fours, more, four)
        scored = _score_fours(fours, threes)

        reach = levels.select("lang", "level")
        at_level = lambda df: df.join(reach, "lang").filter(F.col("score") >= F.col("level"))
        kept = [_surviving(at_level(pairs), threes, 2).withColumns({"w3": _none(), "w4": _none()}),
                _surviving(at_level(threes), fours, 3).withColumn("w4", _none()), at_level(scored)]
        columns = ["lang", *four, "a", "l", "r", "score"]
        kept = stored(kept[0].select(columns).union(kept[1].select(columns)).union(kept[2].select(columns)), "kept")
        found = kept.groupBy("lang").agg(F.count("*").alias("found"))
        settled = reach.join(found, "lang", "left").select(
            "lang", (F.coalesce("found", F.lit(0)) >= top).alias("enough"), (F.col("level") == 0).alias("all"))
        settled = stored(settled.select("lang", (F.col("enough") | F.col("all")).alias("settled")), "settled")
        if settled.filter("NOT settled").isEmpty():
            return _ranked(kept, four, often, sizes, top)
        wanted *= 4


def _none() -> Column:
    return F.lit(None).cast("long")


def _united(old: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of earlier rounds and new ones; a phrase counted twice has the same count both times."""
    return new if old is None else stored(old.union(new.select(old.columns)).dropDuplicates(["lang", *keys]), "united")


def _ranked(kept: DataFrame, keys: list[str], words: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    order = [F.desc("score"), F.desc("a")]
    best = stored(_top(kept, keys, top, order), "best")
    facts = ["lang", *keys, "a", "l", "r", "score"]
    named = best.select(*facts, F.posexplode(F.array(*keys)).alias("at", "w")).filter("w IS NOT NULL")
    spelt = words.select("lang", F.col("w1").alias("w"), F.col("word").cast("string").alias("word"))
    said = F.array_sort(F.collect_list(F.struct("at", "word")))
    phrase = F.array_join(F.transform(said, lambda x: x["word"]), " ").alias("phrase")
    rows = named.join(spelt, ["lang", "w"]).groupBy(*facts).agg(phrase)
    # at most `top` rows of a language and their ties are left here
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    rows = rows.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).join(sizes, "lang")
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
