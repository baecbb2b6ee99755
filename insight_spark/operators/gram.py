"""Sums behind the correlations of many pairs: Gram products of blocks of columns, in one scan.

Every task keeps, for each pair of blocks of columns, one array of sums over the rows complete in both columns:
counts, sums, squares and products are matrix products of the block's values and of its masks of present
values. A task sends one row for each pair of blocks at its end. Two rounds of streaming merges (by 64 salts, then
by pair of blocks) leave one array a pair, so neither the driver nor one task sees more than that at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Columns of one block, and rows of a batch multiplied at once.
BLOCK, ROWS = 64, 8192
SALTS = 64

#: The layers of an array of sums: added up, then smallest, then largest.
ADDED = ("n", "xy", "sx", "sy", "sxx", "syy", "infinite")
LEAST, MOST = ("lox", "loy"), ("hix", "hiy")

_ROWS = "block int, salt int, sums binary"


def block_pairs(columns: Sequence[int], pairs: Sequence[tuple[int, int]], block: int = BLOCK) -> list[tuple[int, int]]:
    """The pairs of blocks that hold the wanted pairs of columns."""
    at = {c: i // block for i, c in enumerate(columns)}
    return sorted({(at[x], at[y]) for x, y in pairs})


def gram_sums(df: DataFrame, exprs: dict[int, Column], pairs: Sequence[tuple[int, int]],
              frames: dict[int, tuple[float, float]], block: int = BLOCK) -> dict[tuple[int, int], dict]:
    """{(x, y): sums over the rows where both columns have a value}.

    `exprs` are double columns with NULL for missing; `frames` holds a centre and a scale of each, which keep
    the sums numerically safe and leave correlations as they are. `infinite` counts rows with an infinite
    value on either side; those enter no sum but n. `lox` to `hiy` are the extremes of the scaled values.
    """
    columns = sorted({c for pair in pairs for c in pair})
    blocks = block_pairs(columns, pairs, block)
    groups = [list(range(i, min(i + block, len(columns)))) for i in range(0, len(columns), block)]
    centre, scale = (np.array([frames[c][k] for c in columns]) for k in (0, 1))
    # what runs in tasks is defined inside, so that executors need no copy of this package
    rows, salts, n_added, n_least = ROWS, SALTS, len(ADDED), len(LEAST)
    layers = n_added + n_least + len(MOST)

    def fresh(a: int, b: int) -> np.ndarray:
        import numpy as np

        out = np.zeros((layers, len(groups[a]), len(groups[b])))
        out[n_added : n_added + n_least] = np.inf
        out[n_added + n_least :] = -np.inf
        return out

    def merge(old: np.ndarray, new: np.ndarray) -> None:
        import numpy as np

        old[:n_added] += new[:n_added]
        np.minimum(old[n_added : n_added + n_least], new[n_added : n_added + n_least], out=old[n_added : n_added + n_least])
        np.maximum(old[n_added + n_least :], new[n_added + n_least :], out=old[n_added + n_least :])

    def extremes(values: np.ndarray, present: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest of each value column over the rows where each column of `other` is present."""
        import numpy as np

        low, high = np.where(present, values, np.inf), np.where(present, values, -np.inf)
        lows, highs = (np.repeat(x[:, None], other.shape[1], 1) for x in (low.min(0), high.max(0)))
        for j in np.flatnonzero(~other.all(0)):
            some = other[:, j]
            lows[:, j] = low[some].min(0, initial=np.inf)
            highs[:, j] = high[some].max(0, initial=-np.inf)
        return lows, highs

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        sums = {}
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                present, infinite = ~np.isnan(x), np.isinf(x)
                x = np.where(present & ~infinite, (x - centre) / scale, 0.0)
                mask, far = present.astype(float), infinite.astype(float)
                for k, (a, b) in enumerate(blocks):
                    ga, gb = groups[a], groups[b]
                    xa, xb, ma, mb = x[:, ga], x[:, gb], mask[:, ga], mask[:, gb]
                    lox, hix = extremes(xa, present[:, ga], present[:, gb])
                    loy, hiy = extremes(xb, present[:, gb], present[:, ga])
                    new = np.stack([
                        ma.T @ mb, xa.T @ xb, xa.T @ mb, ma.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb),
                        far[:, ga].T @ mb + ma.T @ far[:, gb], lox, loy.T, hix, hiy.T,
                    ])
                    merge(sums.setdefault(k, fresh(a, b)), new)
        salt = TaskContext.get().partitionId() % salts
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([salt] * len(sums), pa.int32()),
                 pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "salt", "sums"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        held, salt_of = {}, 0
        for batch in batches:
            for k, salt, payload in zip(*(c.to_pylist() for c in batch.columns)):
                merge(held.setdefault(k, fresh(*blocks[k])), np.frombuffer(payload).reshape(fresh(*blocks[k]).shape))
                salt_of = salt
        for k, s in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([salt_of], pa.int32()), pa.array([s.tobytes()], pa.binary())],
                ["block", "salt", "sums"])

    wide = df.select(*[exprs[c].alias(f"c{c}") for c in columns])
    parts = wide.mapInArrow(count, _ROWS)
    salted = parts.repartition("block", "salt").mapInArrow(fold, _ROWS)
    merged = salted.repartition("block").mapInArrow(fold, _ROWS).select("block", "sums")
    index = {c: i for i, c in enumerate(columns)}
    arrays = {}
    for row in merged.collect():  # one array of sums for each pair of blocks
        a, b = blocks[row.block]
        arrays[a, b] = np.frombuffer(row.sums).reshape(layers, len(groups[a]), len(groups[b]))
    found = {}
    for x, y in pairs:
        sums = arrays.get((index[x] // block, index[y] // block))
        if sums is not None:
            cell = sums[:, index[x] % block, index[y] % block]
            one = dict(zip(ADDED + LEAST + MOST, cell.tolist()))
            if one["n"]:
                found[x, y] = one | {"n": int(one["n"])}
    return found
