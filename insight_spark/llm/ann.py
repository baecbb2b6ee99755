"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives each vector a long string of symbols: each symbol names the axis, and its direction, that is closest to
the vector in one random rotation, and the string ends in a finely cut random projection. A tree is the sorted array
of its strings. A query descends each tree to where its string stands and is compared exactly with a window of strings
around that place. It then ascends all trees together, from the longest prefixes to shorter ones, takes every
string that shares the prefix, and ends where a vector as near as its last neighbour so far is hardly missed any more
(`Forest.ascents`). Where neighbours are hardly nearer than other vectors, or a cloud shares all its symbols, that is a
large share of the table or of the cloud.

Sorted arrays are cut into cells by as many first symbols as it takes for cells to hold at most CELL strings on
average (none, and a cell is a tree, up to that many vectors); overfull cells (many near copies) are split by `grid` and searched part by part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import grid, stored, tasks, worker_cache

TREES, SYMBOLS, SEED = 128, 3, 11
#: Strings in a cell on average at most, in a cell's part, and vectors in a block of exact comparisons.
CELL, CELL_BOUND, BLOCK = 1 << 20, 1 << 21, 4096
NEIGHBOURS = 10
#: Chance that the ascent may miss a vector as near as a query's last neighbour; pairs from which the odds of equal
#: symbols are estimated, by degree; ids that a task hands over at once.
MISS, PAIRS, PIECE = 0.02, 4096, 1 << 20


@dataclass(frozen=True)
class Forest:
    """`width` strings on either side of a query's place are looked at first in each tree."""

    dim: int
    trees: int
    symbols: int
    prefix: int  # symbols that name a cell
    width: int
    seed: int

    @staticmethod
    def of_size(n: int, dim: int, trees: int = TREES, symbols: int = SYMBOLS, seed: int = SEED, effort: float = 0.25) -> Forest:
        """The width grows with the root of n, so that first neighbours are near enough to end the ascent early."""
        width = max(16, int(np.ceil(effort * np.sqrt(n))))
        per_symbol, prefix = 2 * dim, 0
        while n / per_symbol**prefix > CELL and prefix < symbols:
            prefix += 1
        return Forest(dim, trees, symbols, prefix, width, seed)

    def codes(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: its cell within the tree, and its string as an unsigned integer."""
        turns, direction = worker_cache(f"turns {self.seed} {self.dim} {self.symbols} {tree}", lambda: self._turns(tree))
        cell, code = np.zeros(len(x), np.int64), np.zeros(len(x), np.uint64)
        unit = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
        for s, turn in enumerate(turns):
            turned = unit @ turn
            axis = np.maximum(turned, -turned).argmax(1)
            symbol = 2 * axis + (np.take_along_axis(turned, axis[:, None], 1)[:, 0] > 0)
            if s < self.prefix:
                cell = cell * 2 * self.dim + symbol
            code = code * np.uint64(2 * self.dim) + symbol.astype(np.uint64)
        tail = np.uint64(self.tail)
        place = (unit @ direction).astype(np.float64)
        code = code * tail + np.minimum(((place + 1) / 2 * float(tail)).astype(np.uint64), tail - np.uint64(1))
        return cell, code

    def _turns(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """A random rotation for each symbol, and a random direction."""
        rng = np.random.default_rng((self.seed, tree))
        turns = [np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0].astype(np.float32) for _ in range(self.symbols)]
        direction = rng.normal(size=self.dim)
        return np.stack(turns), (direction / np.linalg.norm(direction)).astype(np.float32)

    @property
    def tail(self) -> int:
        """Steps of the projection that ends a string: what 62 bits leave."""
        return max(2, 1 << max(1, 62 - int(np.ceil(self.symbols * np.log2(2 * self.dim)))))

    def prefixes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that two arrays of strings have in common from the left, and one more if the projections are equal."""
        common, weight = np.zeros(np.broadcast(a, b).shape, np.int32), np.uint64(self.tail)
        common += (a == b).astype(np.int32)
        for _ in range(self.symbols):
            common += a // weight == b // weight
            weight = np.uint64(int(weight) * 2 * self.dim)
        return common

    def ranges(self, strings: np.ndarray, query: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query the places (from, to) of the sorted strings that share its first `level` symbols."""
        weight = np.array([self.tail * (2 * self.dim) ** (self.symbols - s) for s in range(self.symbols + 1)], np.uint64)[level]
        low = query - query % weight
        return np.searchsorted(strings, low), np.searchsorted(strings, low + (weight - np.uint64(1)), side="right")

    def ascents(self, miss: float = MISS) -> list[tuple[int, int]]:
        """For each angle of 0 to 180 degrees (level, trees): how far a query whose last neighbour stands at it ascends.

        All trees go up to level + 1 together and the first `trees` of them to `level`. A tree's rotations are random, so
        two vectors share a symbol with a chance that depends on their angle only, independently by symbol and tree.
        The ascent ends where all trees together miss such a neighbour with a chance of at most `miss`; level 0 is the whole table.
        """
        rng = np.random.default_rng(self.seed)
        x, z = rng.normal(size=(2, PAIRS, self.dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        z -= (x * z).sum(1)[:, None] * x
        z /= np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]

        def symbol(v: np.ndarray) -> np.ndarray:
            axis = np.abs(v).argmax(1)
            return 2 * axis + (np.take_along_axis(v, axis[:, None], 1)[:, 0] > 0)

        own, out, chance = symbol(x), [], 1.0
        for angle in np.radians(np.arange(181)):
            chance = min(chance, float((own == symbol(np.cos(angle) * x + np.sin(angle) * z)).mean()))
            missed = [np.log1p(-min(chance**s, 1 - 1e-12)) for s in range(1, self.symbols + 1)] + [0.0]
            level = next((s for s in range(self.symbols, 0, -1) if self.trees * missed[s - 1] <= np.log(miss)), 0)
            if level:
                here, deeper = missed[level - 1], missed[level]
                out.append((level, max(1, int(np.ceil((np.log(miss) - self.trees * deeper) / (here - deeper))))))
            else:
                out.append((0, 1))
        return out


def usable(vector: Column) -> Column:
    """Vectors with no null or non-finite component and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS, trees: int = TREES,
           effort: float = 0.25, seed: int = SEED) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of vectors (vec_id, embedding): for every query row its nearest other rows.

    Score is the Euclidean distance in double precision; ties go to the smaller vec_id. Vectors that are null,
    zero or have null or non-finite components, and rows without vec_id, take no part; a repeated vec_id counts
    once, with its smallest vector. Vectors of another length than most (ties: the longest) take no part.
    A query with fewer others than `neighbours` gets all of them. Equal vectors are one entry of the
    forest, with their smallest ids, so copies cost nothing and come in order of ids.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q"))
        .filter(F.col("vec_id").isNotNull()).filter(usable(F.col("v")))
        .groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    )
    rows = stored(rows, "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["d"], sizes["count"]
    forest = Forest.of_size(n, dim, trees, seed=seed, effort=effort)

    # copies: of each vector its smallest ids, enough for any query; split first by a salt
    rows = rows.filter(F.size("v") == dim).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    nth = F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= neighbours + 1)
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = few.withColumn("nth", nth).filter(F.col("nth") <= neighbours + 1)
    first = F.min("vec_id").over(Window.partitionBy("v"))
    few = stored(few.select("vec_id", first.alias("cls"), "v"), "copies")
    classes = few.filter("vec_id = cls").select("cls", "v")
    asked = stored(
        rows.filter("q").select("vec_id", "v").join(classes, "v").select(F.col("vec_id").alias("query_id"), "cls"), "queries")
    entries = classes.join(asked.select("cls").distinct().withColumn("q", F.lit(True)), "cls", "left")

    trees_of = _trees(entries.select("cls", "v", F.coalesce("q", F.lit(False)).alias("q")), forest)
    most = neighbours + 1
    first_near = stored(_nearest(_windows(trees_of, forest), classes, most), "near")

    # how far each query ascends: by the widest angle among its nearest so far, to the whole table if they are too few
    angle = F.least(F.ceil(F.degrees(F.acos(F.col("cosine")))).cast("int"), F.lit(180))
    widest = first_near.groupBy("cls").agg(F.count("*").alias("n"), F.max(angle).alias("angle"))
    levels, upto = zip(*forest.ascents())
    known = (F.col("n") == most) & F.col("angle").isNotNull()
    ways = asked.select("cls").distinct().join(widest, "cls", "left").select(
        "cls", F.when(known, F.get(F.lit(list(levels)), F.col("angle"))).otherwise(0).alias("level"),
        F.when(known, F.get(F.lit(list(upto)), F.col("angle"))).otherwise(1).alias("upto"))
    second_near = _nearest(_ascend(trees_of, ways.join(classes, "cls"), forest), classes, most)
    both = first_near.unionByName(second_near).groupBy("cls", "near").agg(F.min("score").alias("score"))
    order = Window.partitionBy("cls").orderBy("score", "near")
    near = both.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")

    # from classes back to rows: the copies of each near class, and for each query of a class the class itself
    members = few.select(F.col("cls").alias("near"), "vec_id")
    pairs = near.join(members, "near").join(asked, "cls").filter("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _trees(entries: DataFrame, forest: Forest) -> DataFrame:
    """Chunks (cell, side, n, codes, ids) of the strings of all entries (side b) and of the queries (side a) in every tree."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, ids, asked = _matrix(pdf["v"]), pdf["cls"].to_numpy(np.int64), pdf["q"].to_numpy(bool)
            if not len(x):
                continue
            cells = (2 * forest.dim) ** forest.prefix
            for tree in range(forest.trees):
                cell, code = forest.codes(x, tree)
                out = []
                for side, part in (("a", asked), ("b", np.ones(len(x), bool))):
                    order = np.argsort(cell[part], kind="stable")
                    keys, at = np.unique(cell[part][order], return_index=True)
                    for key, c, i in zip(keys, np.split(code[part][order], at[1:]), np.split(ids[part][order], at[1:])):
                        out.append((tree * cells + int(key), side, len(c), c.tobytes(), i.tobytes()))
                yield pd.DataFrame(out, columns=["cell", "side", "n", "codes", "ids"])

    parts = tasks(entries.sparkSession)
    return stored(entries.repartition(parts).mapInPandas(emit, "cell long, side string, n long, codes binary, ids binary"), "trees")


def _windows(chunks: DataFrame, forest: Forest) -> DataFrame:
    """Rows (cls, block, ids) for every query class: its first candidates, the windows around its places in all trees."""

    def joined(pdf: pd.DataFrame, side: str) -> tuple[np.ndarray, np.ndarray]:
        part = pdf[pdf["side"] == side]
        code, ids = np.frombuffer(b"".join(part["codes"]), np.uint64), np.frombuffer(b"".join(part["ids"]), np.int64)
        order = np.lexsort((ids, code))
        return code[order], ids[order]

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        (query, asked), (code, ids) = joined(pdf, "a"), joined(pdf, "b")
        at = np.searchsorted(code, query)
        wide = min(2 * forest.width, len(code))
        low, out = np.clip(at - forest.width, 0, len(code) - wide), []
        for k in range(0, len(query), 512):
            window = low[k : k + 512, None] + np.arange(wide)
            out += [(cls, i.tobytes()) for cls, i in zip(asked[k : k + 512], ids[window])]
        return pd.DataFrame(out, columns=["cls", "ids"])

    parts = tasks(chunks.sparkSession)
    dealt = grid(chunks, CELL_BOUND, "codes", "ids").repartition(parts, "cell", "i", "j")
    hits = dealt.groupBy("cell", "i", "j").applyInPandas(descend, "cls long, ids binary")
    return hits.repartition(parts, "cls").groupBy("cls").applyInPandas(_gather, "cls long, block long, ids binary")


def _by_block(cls: int, ids: np.ndarray) -> pd.DataFrame:
    """Sorted ids by block of exact comparison, as places in it."""
    keys, at = np.unique(ids // BLOCK, return_index=True)
    return pd.DataFrame({"cls": cls, "block": keys, "ids": [(p % BLOCK).astype(np.uint16).tobytes() for p in np.split(ids, at[1:])]})


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    return _by_block(int(pdf["cls"].iloc[0]), np.unique(np.frombuffer(b"".join(pdf["ids"]), np.int64)))


def _ascend(chunks: DataFrame, queries: DataFrame, forest: Forest) -> DataFrame:
    """Rows (cls, block, ids): every string that shares the first symbols of a query (cls, v, level, upto), as many
    as its ascent leaves in each tree. A task holds a cell's strings, or a part of them, and its queries pass by."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = (2 * forest.dim) ** forest.prefix
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = _matrix(pdf["v"]), pdf["cls"].to_numpy(np.int64)
            top, upto = pdf["level"].to_numpy(np.int64), pdf["upto"].to_numpy(np.int64)
            for tree in range(forest.trees):
                cell, code = forest.codes(x, tree)
                level = np.where(tree < upto, top, np.where(top == 0, forest.symbols, top) + 1)
                out = []
                for s in range(forest.symbols + 1):
                    # a prefix shorter than a cell's name is shared by several cells
                    many = (2 * forest.dim) ** max(0, forest.prefix - s)
                    shared = cell // many
                    for key in np.unique(shared[level == s]):
                        part = (level == s) & (shared == key)
                        row = (int(part.sum()), code[part].tobytes(), ids[part].tobytes(), level[part].astype(np.int8).tobytes())
                        out += [(tree * cells + int(key) * many + k, "a", *row) for k in range(many)]
                yield pd.DataFrame(out, columns=["cell", "side", "n", "codes", "ids", "levels"])

    def reach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, code, ids = None, [], None, None
        out, size = [], 0
        for pdf in batches:
            for cell, i, j, side, codes, some, levels in pdf.itertuples(index=False):
                if (cell, i, j) != key:
                    key, held, code, ids = (cell, i, j), [], None, None
                if side == "b":
                    held.append((np.frombuffer(codes, np.uint64), np.frombuffer(some, np.int64)))
                    continue
                if code is None:
                    code, ids = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.uint64, np.int64), zip(*held) if held else ((), ())))
                    order = np.argsort(code)
                    code, ids, held = code[order], ids[order], []
                low, high = forest.ranges(code, np.frombuffer(codes, np.uint64), np.frombuffer(levels, np.int8).astype(np.int64))
                for cls, a, b in zip(np.frombuffer(some, np.int64), low, high):
                    if b > a:
                        out.append((int(cls), ids[a:b].tobytes()))
                        size += b - a
                    if size > PIECE:
                        yield pd.DataFrame(out, columns=["cls", "ids"])
                        out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["cls", "ids"])

    parts = tasks(chunks.sparkSession)
    asked = queries.select("cls", "v", "level", "upto").repartition(parts).mapInPandas(
        emit, "cell long, side string, n long, codes binary, ids binary, levels binary")
    strings = chunks.filter("side = 'b'").withColumn("levels", F.lit(None).cast("binary"))
    dealt = grid(stored(asked, "ascents").unionByName(strings), CELL_BOUND, "codes", "ids", "levels")
    dealt = dealt.select("cell", "i", "j", "side", "codes", "ids", "levels").repartition(parts, "cell", "i", "j")
    hits = dealt.sortWithinPartitions("cell", "i", "j", F.desc("side")).mapInPandas(reach, "cls long, ids binary")
    return hits.repartition(parts, "cls").groupBy("cls").applyInPandas(_gather, "cls long, block long, ids binary")


def _nearest(found: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """Rows (cls, near, score, cosine): of each query class the `most` nearest candidate classes, itself among them.

    A block of vectors and then the queries that have candidates in it pass through a task together; only the block is held.
    """
    parts = tasks(found.sparkSession)
    queries = found.join(classes, "cls").select(
        "block", F.lit(1).alias("kind"), "cls", "v", "ids")
    blocks = classes.select(
        F.floor(F.col("cls") / BLOCK).alias("block"), F.lit(0).alias("kind"), "cls", "v", F.lit(None).cast("binary").alias("ids"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, ids, x = None, [], []
        for pdf in batches:
            out = []
            for b, kind, cls, v, wanted in pdf.itertuples(index=False):
                if kind == 0:
                    if b != block:
                        block, ids, x = b, [], []
                    ids.append(cls)
                    x.append(np.asarray(v, np.float64))
                    continue
                if isinstance(ids, list):
                    ids, x = np.array(ids), np.stack(x)
                some, v = np.searchsorted(ids, b * BLOCK + np.frombuffer(wanted, np.uint16).astype(np.int64)), np.asarray(v, np.float64)
                score = np.sqrt(((x[some] - v) ** 2).sum(1))
                best = np.lexsort((ids[some], score))[:most]
                close = x[some[best]]
                cosine = close @ v / (np.linalg.norm(close, axis=1) * np.linalg.norm(v))
                out += [(cls, int(ids[some[k]]), float(score[k]), float(c)) for k, c in zip(best, np.clip(cosine, -1, 1))]
            yield pd.DataFrame(out, columns=["cls", "near", "score", "cosine"]).astype(
                {"cls": "int64", "near": "int64", "score": "float64", "cosine": "float64"})

    both = blocks.union(queries).repartition(parts, "block").sortWithinPartitions("block", "kind", "cls")
    scored = both.mapInPandas(compare, "cls long, near long, score double, cosine double")
    order = Window.partitionBy("cls").orderBy("score", "near")
    return scored.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")
