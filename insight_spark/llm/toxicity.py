"""Toxicity by weak supervision: mined voters, a generative label model, a linear classifier on its posteriors.

1. Signs: from a bounded sample of labelled documents, words and word stems that occur in toxic
   documents far more often than in others. The strongest are the lexicon voters; patterns over the
   lexicon (several signs, a high share of signs, none at all) are the pattern voters, and the
   human mark is one more voter whose accuracy is estimated like the others'.
2. Label model: a two-class mixture in which every group of correlated voters has, for each class, a
   table of how many of the group vote. Voters are grouped by the correlation that is left within
   the classes. Expectation-maximisation estimates tables, class share and each document's posterior.
3. Classifier: logistic regression on the signs of the sample, trained on the posteriors.
4. Every document is scored by the classifier in one pass over its whole text, without a shuffle.

Never an input of a score: labels, lang, source, doc_id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, stored

#: Labelled documents the model is fitted on, at most; chosen by a hash of their ids.
SAMPLE = 20_000
#: Signs the classifier weighs, and those of them that vote, at most.
SIGNS, VOTERS = 3_000, 200
#: Toxic documents that must have a sign.
SUPPORT = 5
#: Root of the likelihood ratio that makes a sign telling, and how much more often toxic documents have a voter.
CERTAIN, VOTER_RATE = 4.5, 5.0
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")
STEMS = (3, 4, 5, 6)


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from: crc32 of the id as text leaves 2 modulo 4. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def signs_of(word: str) -> list[str]:
    """The word itself and its stems, which end in a star."""
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) > k)]


def doc_signs(text: str) -> set[str]:
    return {s for w in set(WORD.findall(text.lower())) for s in signs_of(w)}


@dataclass
class Model:
    """Weights of signs and the intercept."""

    weights: dict[str, float]
    bias: float

    @property
    def fitted(self) -> bool:
        """False if the labels gave no sign a weight, so that all texts score alike."""
        return bool(self.weights)

    def scorer(self) -> Callable[[str], float]:
        """A function from text to score; it remembers the weights of the words it has met, a million at most."""
        weights, kept = self.weights, {}

        def weigh(word: str) -> list[tuple[str, float]]:
            return [(s, weights[s]) for s in signs_of(word) if s in weights]

        def score(text: str) -> float:
            found: dict[str, float] = {}
            if len(kept) > 1_000_000:
                kept.clear()
            for w in set(WORD.findall(text.lower())):
                x = kept.get(w)
                if x is None:
                    x = kept[w] = weigh(w)
                if x:
                    found.update(x)
            total = self.bias + sum(found[s] for s in sorted(found))
            return 1 / (1 + math.exp(-min(max(total, -30), 30)))

        return score


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts and marks (text, toxic: double) of at most `sample` labelled documents that are not held out, one of
    each set of (near) copies: texts whose smallest hash of three words is the same.

    Repeated labels of a document are averaged, labels without an id or a mark are left out. The
    sampled ids (at most `sample` rows) are broadcast, so the texts do not move.
    """
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
        .filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = doc_texts(docs).join(F.broadcast(marks), "doc_id").withColumn("least", F.pandas_udf(_least, "long")("text"))
    return rows.groupBy("least").agg(F.min(F.struct("doc_id", "text", "toxic")).alias("x")).select("x.text", "x.toxic")


def _least(texts: pd.Series) -> pd.Series:
    from xxhash import xxh64_intdigest

    def least(text: str) -> int:
        words = WORD.findall(text.lower())
        return min((xxh64_intdigest(" ".join(x)) for x in zip(words, words[1:], words[2:])), default=0) >> 1

    return texts.map(least)


def mine_signs(rows: DataFrame, signs: int = SIGNS, support: int = SUPPORT) -> tuple[pd.DataFrame, float, float]:
    """The most telling signs (sign; pos, neg: documents that have it; rate: log of how much more
    often toxic ones have it; z: root of the likelihood ratio), and the numbers of toxic and other documents."""

    def count(toxic: bool, only: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for b in batches:
                for text in b.column("text").to_pylist():
                    found = doc_signs(text)
                    seen.update(found if only is None else found & only)
            yield pa.RecordBatch.from_pydict({"sign": list(seen), "n": pa.array(list(seen.values()), pa.int64())},
                                             pa.schema([("sign", pa.string()), ("n", pa.int64())]))

        side = rows.filter(F.col("toxic") >= 0.5 if toxic else F.col("toxic") < 0.5).select("text")
        return side.mapInArrow(run, "sign string, n long").groupBy("sign").agg(F.sum("n").alias("n"))

    n_pos, n_neg = rows.agg(F.count_if(F.col("toxic") >= 0.5), F.count_if(F.col("toxic") < 0.5)).first()
    pos = count(True, None).filter(F.col("n") >= support).orderBy(F.desc("n"), "sign").limit(20 * signs).toPandas()
    neg = count(False, set(pos["sign"])).toPandas().set_index("sign")["n"]
    pos = pos.rename(columns={"n": "pos"}).assign(neg=lambda x: x["sign"].map(neg).fillna(0.0))
    seen, share = pos["pos"] + pos["neg"], n_pos / max(n_pos + n_neg, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (pos["pos"] * np.log(pos["pos"] / (seen * share))
                 + (pos["neg"] * np.log(pos["neg"] / (seen * (1 - share)))).fillna(0.0))
    rate = np.log((pos["pos"] + 0.5) / (n_pos + 1)) - np.log((pos["neg"] + 0.5) / (n_neg + 1))
    pos = pos.assign(rate=rate, z=np.sqrt(np.maximum(g, 0)))
    best = pos[pos["z"] > CERTAIN].sort_values(["z", "sign"], ascending=[False, True]).head(signs)
    return best.reset_index(drop=True), float(n_pos), float(n_neg)


def _sparse(rows: DataFrame, signs: list[str]) -> pd.DataFrame:
    """The sample as (toxic, n_words, cols: int32 bytes of the signs it has); bounded by the sample."""
    where = {s: i for i, s in enumerate(signs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, n = [], []
            for text in b.column("text").to_pylist():
                cols.append(np.array(sorted(where[s] for s in doc_signs(text) & where.keys()), "<i4").tobytes())
                n.append(len(WORD.findall(text)))
            yield pa.RecordBatch.from_arrays(
                [b.column("toxic"), pa.array(n, pa.int64()), pa.array(cols, pa.binary())], ["toxic", "n_words", "cols"])

    out = rows.mapInArrow(run, "toxic double, n_words long, cols binary").toPandas()
    return out.sort_values(["toxic", "n_words", "cols"], ignore_index=True)


def groups_of(votes: np.ndarray, posterior: np.ndarray, bound: float = 0.3) -> list[list[int]]:
    """Voters grouped by the correlation of what is left of their votes within the classes."""
    rest = votes.astype(np.float64)
    for weight in (posterior, 1 - posterior):
        rest -= weight[:, None] * (weight @ votes / max(weight.sum(), 1e-9))[None]
    scale = np.sqrt((rest**2).sum(0)) + 1e-9
    near = np.abs((rest / scale).T @ (rest / scale)) > bound
    groups, free = [], set(range(votes.shape[1]))
    for j in range(votes.shape[1]):
        if j in free:  # with its correlated, still free voters
            groups.append([k for k in np.flatnonzero(near[j] | (np.arange(len(near)) == j)) if k in free])
            free -= set(groups[-1])
    return groups


def label_model(votes: np.ndarray, marks: np.ndarray, trust: float = 0.98, rounds: int = 30) -> np.ndarray:
    """Posterior of the toxic class for each row of 0/1 votes and human mark.

    A group of correlated voters enters as one variable: the number of its votes, up to three. Tables of
    groups and the accuracy of the marks, which starts from as much evidence for `trust` as there are
    marks, are re-estimated by expectation-maximisation; groups are formed again after a few rounds.
    """
    posterior = np.where(marks, trust, 1 - trust)
    levels: list[np.ndarray] = []
    for step in range(rounds):
        if step in (0, 5, 15):
            levels = [np.minimum(votes[:, g].sum(1), 3).astype(np.int64) for g in groups_of(votes, posterior)]
        share = np.clip(posterior.mean(), 0.005, 0.995)
        log_odds = np.full(len(votes), math.log(share / (1 - share)))
        for weight, agree, sign in ((posterior, marks, 1), (1 - posterior, ~marks, -1)):
            right = (weight[agree].sum() + trust * weight.sum()) / (2 * weight.sum())
            log_odds += sign * np.where(agree, math.log(right), math.log(1 - right))
        for level in levels:
            toxic = np.bincount(level, posterior, 4) + 0.1
            other = np.bincount(level, 1 - posterior, 4) + 0.1
            log_odds += np.log(toxic / toxic.sum() / (other / other.sum()))[level]
        posterior = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return posterior


def _logistic(indptr: np.ndarray, cols: np.ndarray, target: np.ndarray, width: int,
              penalty: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Weights of `width` sparse 0/1 columns and the intercept, by accelerated gradient steps."""
    n, row = len(target), np.repeat(np.arange(len(target)), np.diff(indptr))
    scale = 1 / np.sqrt(np.maximum(np.bincount(cols, minlength=width) / n, 1e-3))  # rare signs learn as fast
    value = scale[cols]
    w = np.zeros(width + 1)
    v = w.copy()
    curvature = 0.25 * (np.bincount(row, value**2, n).mean() + 1)
    for k in range(rounds):
        z = np.bincount(row, value * v[cols], n) + v[width]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.append(np.bincount(cols, value * d[row], width) + penalty * v[:width], d.sum())
        new = v - grad / curvature
        v, w = new + (k / (k + 3)) * (new - w), new
    return np.append(w[:width] * scale, w[width])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, signs: int = SIGNS, voters: int = VOTERS,
        support: int = SUPPORT) -> Model:
    """The model of the docs' labels. Where toxic or other labelled documents are missing, every
    text gets the share of toxic marks (one half without any marks)."""
    rows = stored(training_rows(docs, labels, sample), "toxicity-sample")
    mined, n_pos, n_neg = mine_signs(rows, signs, support)
    if not len(mined) or not n_neg:
        share = (n_pos + 0.5) / (n_pos + n_neg + 1)
        return Model({}, math.log(share / (1 - share)))
    data = _sparse(rows, list(mined["sign"]))
    parts = [np.frombuffer(c, "<i4") for c in data["cols"]]
    indptr = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    cols, row = np.concatenate([*parts, np.empty(0, "<i4")]).astype(np.int64), np.repeat(np.arange(len(parts)), np.diff(indptr))

    lexicon = mined[mined["rate"] > math.log(VOTER_RATE)].head(voters).index.to_numpy()
    place = np.full(len(mined), -1)
    place[lexicon] = np.arange(len(lexicon))
    votes = np.zeros((len(parts), len(lexicon) + 3), np.int8)
    hit = place[cols] >= 0
    votes[row[hit], place[cols[hit]]] = 1
    signs_hit = votes[:, : len(lexicon)].sum(1)
    share = signs_hit / (data["n_words"].to_numpy() + 20)
    votes[:, -3], votes[:, -2], votes[:, -1] = signs_hit >= 3, signs_hit >= 8, share >= 0.02
    posterior = label_model(votes, data["toxic"].to_numpy() >= 0.5)

    weights = _logistic(indptr, cols, posterior, len(mined))
    return Model({s: float(w) for s, w in zip(mined["sign"], weights) if abs(w) > 1e-6}, float(weights[-1]))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the score of each whole text (null: empty) as one more column; an old column of that name is replaced.

    Rows are scored where they lie, one Arrow batch at a time.
    """
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for batch in texts:
            yield pd.Series([scorer(t) for t in batch], dtype="float64")

    return docs.withColumn(column, F.pandas_udf(run, "double")(F.coalesce(F.col("text"), F.lit(""))))
