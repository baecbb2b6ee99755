"""Document fingerprints by closed syncmers of words, in DataFrame functions only.

A k-mer is k successive words, its inner substrings are the s-word runs inside it. A k-mer is an anchor if its
first or its last inner run has the smallest hash of them all. Whether a k-mer is an anchor depends on
its own words alone, so the same passage has the same anchors in every document and at every place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

K, S = 5, 2
#: Rows that one range of ids holds on average when documents are set beside their neighbours.
RANGE_ROWS = 1000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), use), 0)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors of a text in order: array of (pos: word index from 0, hash: 32 bits of the k-mer's hash).

    Words are runs of anything but ASCII white space. A text of fewer than k words is one k-mer of all its words;
    one without words has no anchors. Where no k-mer qualifies, the one of smallest hash is the anchor.
    """
    inner = k - s + 1

    def hash32(x: Column) -> Column:
        return F.shiftrightunsigned(x, 32)

    def closed(runs: Column, i: Column) -> Column:
        window = [F.get(runs, i + j) for j in range(inner)]
        least = F.least(*window)
        return (window[0] == least) | (window[-1] == least)

    def of_words(words: Column) -> Column:
        n = F.size(words)
        whole = F.when(n == 0, F.array().cast("array<struct<pos:int,hash:bigint>>")).otherwise(
            F.array(F.struct(F.lit(0).alias("pos"), hash32(F.xxhash64(words)).alias("hash"))))
        kmer = lambda i: F.struct(i.alias("pos"), hash32(F.xxhash64(F.slice(words, i + 1, k))).alias("hash"))

        def of_runs(runs: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), n - k), lambda i: closed(runs, i))
            every = F.transform(F.sequence(F.lit(0), n - k), kmer)
            smallest = F.array_min(F.transform(every, lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"))))
            return F.when(F.size(at) > 0, F.transform(at, kmer)).otherwise(
                F.array(F.struct(smallest["pos"].alias("pos"), smallest["hash"].alias("hash"))))

        hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
        runs = _let(hashes(words), lambda h: F.transform(
            F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)])))
        return F.when(n < k, whole).otherwise(_let(runs, of_runs))

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return _let(words, of_words)


def fingerprint(hashes: Column) -> Column:
    """The anchors' hashes in text order, 8 lowercase hex digits each."""
    return F.lower(F.array_join(F.transform(hashes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of anchor hashes, 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def matches(a: Column, b: Column) -> Column:
    """Positional matching of two anchor arrays: (pos in a, pos in b) of every anchor of a that b has too, by b's first."""
    where = F.map_from_entries(F.array_distinct(F.transform(
        b, lambda x: F.struct(x["hash"], F.array_position(b["hash"], x["hash"])))))
    hits = F.filter(a, lambda x: F.array_contains(b["hash"], x["hash"]))
    return _let(where, lambda m: F.transform(hits, lambda x: F.struct(
        x["pos"].alias("pos_a"), F.get(b, F.element_at(m, x["hash"]).cast("int") - 1)["pos"].alias("pos_b"))))


def _ranges(rows: DataFrame, range_rows: int, cells: int = 4096) -> Column:
    """The range of a doc_id: ids in order are cut into ranges of about `range_rows` rows; a null id is in range -1.

    One count over equally wide cells of ids finds how many equally wide ranges each cell needs.
    """
    low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return F.lit(-1).cast("long")
    width = max(1.0, (float(high) - float(low) + 1) / cells)
    at = (F.col("doc_id").cast("double") - F.lit(float(low))) / F.lit(width)
    counts = dict(rows.dropna(subset=["doc_id"]).groupBy(F.floor(at).alias("cell")).agg(F.count("*")).collect())
    first, parts, seen = [], [], 0
    for cell in range(int((float(high) - float(low)) / width) + 1):
        before, seen = seen // range_rows, seen + counts.get(cell, 0)
        first.append(before)
        parts.append(max(1, seen // range_rows - before))
    cell = F.floor(at).cast("int")
    inside = F.floor((at - F.floor(at)) * F.get(F.lit(parts), cell))
    return F.coalesce((F.get(F.lit(first), cell) + inside).cast("long"), F.lit(-1).cast("long"))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, WindowSpec]:
    """Rows (range, real, doc_id, text) and the window in which the row before each real row is its next
    document by descending doc_id.

    A range of ids also gets the largest row below it, not real, so a window sees its range only and
    texts move once. Null ids come last, rows of one id go by text; the next of the last row is the first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", _ranges(rows.select("doc_id"), range_rows))
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("top"))  # one row for some thousand documents
    order = Window.orderBy("range")
    below = tops.select(
        F.coalesce(F.lag("range").over(order), F.last("range").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("from"),
        F.col("range").alias("to"),
    ).join(tops.withColumnRenamed("range", "from"), "from")
    # the bound of the broadcast: a range of 24 bytes for every `range_rows` documents
    halo = (
        rows.join(F.broadcast(below), (F.col("range") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy("to", "doc_id").agg(F.max("text").alias("text"))
        .select(F.col("to").alias("range"), F.lit(False).alias("real"), "doc_id", "text")
    )
    both = rows.select("range", F.lit(True).alias("real"), "doc_id", "text").unionByName(halo)
    return both, Window.partitionBy("range").orderBy("real", "doc_id", "text")


def edited_and_next(docs: DataFrame, k: int = K, s: int = S, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each document beside an edited version and its next document (descending doc_id; after the last the first).

    doc_id, n_chars (code points), edited_sha256 of the text whose last floor(n_chars/3) code points are replaced by
    the first as many (or all) of the next document, fingerprint and edited_fingerprint, near_edited and
    near_next: likeness to the edited text's and the next document's fingerprint. One row per row of docs;
    a null text counts as empty, and empty texts are alike.
    """
    rows, window = with_next(docs, range_rows)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next", F.lit(1), third))
    # the last word of one text may be cut, so anchors of the edited text are made anew
    made = rows.withColumn("next", F.coalesce(F.lag("text").over(window), F.lit(""))).select(
        "range", "real", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"),
    )
    made = made.select(
        "range", "real", "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "text", anchors(F.col("text"), k, s)["hash"].alias("own"), anchors(F.col("edited"), k, s)["hash"].alias("other"),
    )
    made = made.withColumn("below", F.lag("own").over(window)).filter("real")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("below")).alias("near_next"),
    )
