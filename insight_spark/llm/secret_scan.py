"""Secret scans: candidates by pattern, false positives removed by a random forest trained on labelled findings.

The forest sees a candidate's length and kinds of characters, how its characters follow each other compared
with dictionary words, how much of it dictionary words cover, whether it stands in a path or address, and
the words around it. It is trained by Spark ML on labelled findings: those of the caller, or
`example_findings`, which writes findings of known outcome from a fixed seed. Tasks apply its trees
with numpy, one Arrow batch of texts at a time.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import string
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, scratch, worker_cache

#: Labelled findings the forest is trained on by default; at most so many of a caller's findings are used.
FINDINGS = 20_000
EXAMPLES = 4_000
TREES, DEPTH, THRESHOLD = 30, 10, 0.5
MASK = "[SECRET]"
#: Characters on each side that count as the neighbourhood.
AROUND = 48

KEY = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credentials?)"
MARK = re.compile(r"-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----")
BARE, DIGIT = re.compile(r"[A-Za-z0-9+/_~.-]{16,}={0,2}"), re.compile("[0-9]")
SIGN, BEFORE = re.compile("[:=]"), re.compile(rf"(?i)(?:^|[^a-z]){KEY}[\"']?\s{{0,3}}$")
VALUE = re.compile(r"\s{0,3}(?:[\"']([^\s\"'<>]{6,})|([^\s\"'<>;&]{6,}))")  # unquoted ones end at ; and &
GOOD = re.compile(rf"(?i){KEY}|bearer|private|aws|login|signing")
BAD = re.compile(r"(?i)\b(?:commit|sha\d*|md5|checksum|digest|hash|uuid|guid|etag|version|revision|example|sample|"
                 r"placeholder|dummy|test|build|image|isbn|phone|order|card|id)\b")
PATH = re.compile(r"://|(?:^|[\"'\s])[./~]*/?[\w.-]+/[\w.-]+/|\.(?:js|py|html?|png|jpe?g|gif|css|json|xml|zip|gz|txt|md|svg)\b")
PLACE = re.compile(r"(?i)your|example|change|here|xxx|dummy|sample|todo|redacted|\$\{|env|1234567|abcdef")
FEATURES = ("length", "digits", "upper", "lower", "other", "entropy", "changes", "transitions", "covered", "longest",
            "hex", "set", "quoted", "path", "place", "good", "bad", "distinct")


@dataclass
class Dictionary:
    """Words of four or more letters, and the log odds of each pair of letters in them against even pairs."""

    words: frozenset[str]
    pairs: np.ndarray

    @staticmethod
    def load(path: str) -> Dictionary:
        """From the whole words (ending in </w>) of a tokenizers file."""
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        words = {t[:-4] for t in vocabulary if re.fullmatch(r"[a-z]{4,}</w>", t)}
        pairs = np.ones((26, 26))
        for w in words:
            for a, b in zip(w, w[1:]):
                pairs[ord(a) - 97, ord(b) - 97] += 1
        return Dictionary(frozenset(words), np.log(pairs / pairs.sum() * 26 * 26))

    def covered(self, value: str) -> float:
        """Share of the characters inside dictionary words, longest words first from the left."""
        low, i, inside = value.lower(), 0, 0
        while i < len(low):
            hit = next((k for k in range(min(14, len(low) - i), 3, -1) if low[i : i + k] in self.words), 0)
            inside += hit
            i += hit or 1
        return inside / max(1, len(low))

    def transitions(self, value: str) -> float:
        steps = [self.pairs[ord(a) - 97, ord(b) - 97] for a, b in zip(value.lower(), value.lower()[1:])
                 if "a" <= a <= "z" and "a" <= b <= "z"]
        return sum(steps) / len(steps) if steps else 0.0


def features(value: str, before: str, after: str, is_set: bool, words: Dictionary) -> list[float]:
    n, counts = len(value), Counter(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = Counter(kinds)
    runs, run = 1, 1
    for a, b in zip(kinds, kinds[1:]):
        run = run + 1 if a == b else 1
        runs = max(runs, run)
    return [
        math.log(n), share["d"] / n, share["u"] / n, share["l"] / n, share["o"] / n,
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        words.transitions(value), words.covered(value), runs / n,
        float(all(c in string.hexdigits or c == "-" for c in value)), float(is_set),
        float(before[-1:] in ('"', "'") or after[:1] in ('"', "'")),
        float(bool(PATH.search(before[-12:] + value))), float(bool(PLACE.search(value))),
        float(bool(GOOD.search(before))), float(bool(BAD.search(before))), len(counts) / n,
    ]


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private key blocks: from the first BEGIN mark to the next END mark, each mark read once."""
    out, begin = [], None
    for mark in MARK.finditer(text) if "-----BEGIN" in text else ():
        if mark[1] == "BEGIN":
            begin = mark.start() if begin is None else begin
        elif begin is not None:
            out.append((begin, mark.end()))
            begin = None
    return out


def candidates(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, set by a key word) of every candidate value: private key blocks, values that a key word is set to,
    and other runs of 16 or more key characters with a digit. They may overlap; each span is one candidate."""
    found = dict.fromkeys(key_blocks(text), False)
    for sign in SIGN.finditer(text):
        if BEFORE.search(text[max(0, sign.start() - 24) : sign.start()]) and (m := VALUE.match(text, sign.end())):
            found[m.span(m.lastindex)] = True
    for m in BARE.finditer(text):
        if DIGIT.search(m[0]):
            found.setdefault(m.span(), False)
    return [(i, j, is_set) for (i, j), is_set in found.items()]


def settled(found: list[tuple[int, int, float]], threshold: float) -> list[tuple[int, int, float]]:
    """In order of place: the confirmed candidates that lie in no other confirmed one, and the rejected ones that
    overlap none of these."""
    kept: list[tuple[int, int, float]] = []
    for x in sorted((x for x in found if x[2] >= threshold), key=lambda x: (x[0], -x[1])):
        if not kept or x[1] > kept[-1][1]:
            kept.append(x)
    starts = [x[0] for x in kept]

    def free(i: int, j: int) -> bool:
        k = bisect_left(starts, j)  # ends rise with starts, so the last that starts before j reaches farthest
        return k == 0 or kept[k - 1][1] <= i

    return sorted(kept + [x for x in found if x[2] < threshold and free(x[0], x[1])])


def example_findings(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, secret 0/1), half of them secrets, from a fixed seed."""
    rng = random.Random(seed)
    pick, alnum = rng.choice, string.ascii_letters + string.digits

    def chars(alphabet: str, k: int) -> str:
        return "".join(rng.choices(alphabet, k=k))

    def hexes(k: int) -> str:
        return chars("0123456789abcdef", k)

    def guid() -> str:
        return str(uuid.UUID(int=rng.getrandbits(128)))

    names = ["token", "api_key", "apikey", "secret", "password", "access_key", "auth_token", "client_secret", "passwd"]
    plain = ["build", "user", "Map", "convert", "File", "index", "Utf8", "handler", "report", "Sha256", "image", "page"]
    letters = "aeiounrstlhd"

    def words(k: int) -> str:
        return " ".join(chars(letters, rng.randint(2, 9)) for _ in range(k))

    def secret() -> str:
        return pick([
            lambda: hexes(pick([16, 18, 20, 24, 32, 40, 48, 64])), lambda: chars(alnum, rng.randint(20, 48)),
            lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + chars(alnum, 36),
            lambda: "sk-" + chars(alnum, rng.randint(32, 48)), lambda: "xoxb-" + chars(string.digits, 12) + "-" + chars(alnum, 24),
            lambda: f"eyJ{chars(alnum, 30)}.eyJ{chars(alnum, 60)}.{chars(alnum + '_-', 43)}",
            lambda: chars(alnum + "+/", 43) + "=", lambda: chars(alnum + "!@#%^*", rng.randint(10, 16)),
        ])()

    def positive() -> tuple[str, str, str]:
        value = secret()
        return pick([
            (f'{pick(names)} = "', value, '"'), (f"{pick(names)}: '", value, "'"), (f"{pick(names)}=", value, ""),
            (f'"{pick(names)}": "', value, '",'), ("Authorization: Bearer ", value, ""),
            (f"export {pick(names).upper()}=", value, ""), (f"login with {pick(names)} ", value, ""),
            ("", pick(["AKIA", "ASIA"]) + chars(string.ascii_uppercase + string.digits, 16), ""),
            ("", pick(["ghp_", "gho_"]) + chars(alnum, 36), ""), ("", "sk-" + chars(alnum, 40), ""),
            ("", f"-----BEGIN RSA PRIVATE KEY-----\n{chars(alnum + '+/', 200)}\n-----END RSA PRIVATE KEY-----", ""),
        ])

    def negative() -> tuple[str, str, str]:
        name = "".join(pick(plain) for _ in range(4)) + str(rng.randint(1, 99))
        return pick([
            ("commit ", hexes(40), ""), ("sha256: ", hexes(64), ""), ("checksum md5 ", hexes(32), ""), ("request id ", guid(), ""),
            ("digest=", hexes(pick([40, 64])), ""), ("https://", f"site{rng.randint(1, 99)}.example.com/a/{chars(string.digits, 6)}/page.html", ""),
            ("see ", f"/usr/lib/python3.{rng.randint(1, 13)}/site-packages/{name}.py", ""), ("", name, "("),
            ("on ", f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:00:00Z", ""), ("card ", chars(string.digits, 16), ""),
            ("", chars(string.digits, rng.randint(16, 22)), ""), ("phone ", f"+49-{chars(string.digits, 4)}-{chars(string.digits, 8)}", ""),
            ("", f"{chars(letters, 5)}.{chars(string.digits, 2)}-mail{rng.randint(1, 9)}.example.com", ""),
            (f'{pick(names)} = "', pick(["your_api_key_here1", "changeme123456", "xxxxxxxxxxxxxxxx", "EXAMPLEKEY0000000", "<insert>key1"]), '"'),
            (f"{pick(names)} = ", pick(["os.environ.get(1)", "${SECRET_2}", "getToken(user1)", "None,", "config.value1"]), ""),
            (f"{pick(names)}: ", chars(letters, rng.randint(6, 12)), ""), (f"{pick(names)} = ", chars(letters, rng.randint(6, 9)) + ".", ""),
            ("", "-".join(chars(letters, rng.randint(3, 8)) for _ in range(4)) + f"-{rng.randint(1, 2024)}", ""),
            ("", "--------------" + chars(string.digits, 3), ""), ("build ", f"1.{rng.randint(0, 99)}.{rng.randint(0, 99)}-beta.{hexes(8)}", ""),
        ])

    out = []
    while len(out) < n:
        label = len(out) % 2
        before, value, after = positive() if label else negative()
        lead = words(rng.randint(1, 8)) + pick([" ", "\n", ": ", "("])
        out.append((lead + before + value + after + " " + words(3), len(lead + before), len(lead + before + value), label))
    return out


@dataclass
class Forest:
    """Trees as flat arrays: the tested feature (-1: leaf), threshold, children and the leaf's share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    words_path: str

    def probability(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                goes_left = x[rows, np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(goes_left, left[node], right[node]), node)
            total += value[node]
        return total / len(self.trees)


def fit(spark: SparkSession, words_path: str, findings: DataFrame | None = None, most: int = FINDINGS,
        seed: int = 7) -> Forest:
    """The forest of labelled findings (text, start, end, secret 0/1); of more than `most`, those of smallest hash.

    Without findings it learns from `example_findings`. The trees (at most TREES * 2^DEPTH leaves) come to the driver.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T

    rows = example_findings(seed=seed)
    if findings is not None:
        some = findings.select("text", "start", "end", "secret").dropna()
        rows = [tuple(r) for r in some.orderBy(F.xxhash64(*some.columns), *some.columns).limit(most).collect()]
    words = Dictionary.load(words_path)
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("features", VectorUDT())])
    is_set = re.compile(rf"(?i){KEY}[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?$")
    data = [
        (float(y), Vectors.dense(features(t[i:j], t[max(0, i - AROUND) : i], t[j : j + AROUND], bool(is_set.search(t[:i])), words)))
        for t, i, j, y in rows
    ]
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, minInstancesPerNode=2).fit(
        spark.createDataFrame(data, schema).coalesce(1))
    path = f"{scratch(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").toPandas()
    trees = []
    for _, tree in sorted(nodes.groupby("treeID")):
        n = sorted(tree["nodeData"], key=lambda x: x["id"])
        split = [x["split"]["leftCategoriesOrThreshold"] for x in n]
        trees.append((
            np.array([x["split"]["featureIndex"] if x["leftChild"] >= 0 else -1 for x in n]),
            np.array([s[0] if s else 0.0 for s in split]),
            np.array([x["leftChild"] for x in n]), np.array([x["rightChild"] for x in n]),
            np.array([x["impurityStats"][1] / max(sum(x["impurityStats"]), 1e-9) if len(x["impurityStats"]) > 1 else 0.0 for x in n]),
        ))
    return Forest(trees, words_path)


def _found(texts: list[str], forest: Forest, words: Dictionary, threshold: float = THRESHOLD) -> list[list[tuple[int, int, float]]]:
    """Of each text the settled candidates (start, end, probability); all candidates are scored before overlaps count."""
    spans, rows = [], []
    for k, t in enumerate(texts):
        for i, j, is_set in candidates(t):
            spans.append((k, i, j))
            rows.append(features(t[i:j], t[max(0, i - AROUND) : i], t[j : j + AROUND], is_set, words))
    out: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    if rows:
        for (k, i, j), p in zip(spans, forest.probability(np.array(rows))):
            out[k].append((i, j, float(p)))
    return [settled(found, threshold) for found in out]


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """Candidates of all documents: doc_id, start, end (code points), value_sha256, probability, is_secret.

    Every candidate is scored; left out are those inside a secret, and rejected ones that overlap a secret.

    Null and empty texts have none; rows of a repeated doc_id each give theirs; the value itself is not returned.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache(f"dictionary {forest.words_path}", lambda: Dictionary.load(forest.words_path))
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            rows = [
                (doc, i, j, hashlib.sha256(t[i:j].encode()).hexdigest(), p, p >= threshold)
                for doc, t, found in zip(ids, texts, _found(texts, forest, words, threshold)) for i, j, p in found
            ]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["doc_id", "start", "end", "value_sha256", "probability", "is_secret"])

    return doc_texts(docs).mapInArrow(
        run, "doc_id long, start long, end long, value_sha256 string, probability double, is_secret boolean")


def redact(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, mask: str = MASK) -> DataFrame:
    """docs with every secret replaced by the mask; n_chars, where there is one, follows. All rows and columns stay."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = worker_cache(f"dictionary {forest.words_path}", lambda: Dictionary.load(forest.words_path))
        for texts in batches:
            known = [t or "" for t in texts]
            out = []
            for t, old, found in zip(known, texts, _found(known, forest, words, threshold)):
                spans: list[list[int]] = []
                for i, j, p in found:
                    if p >= threshold and spans and i < spans[-1][1]:
                        spans[-1][1] = j  # overlapping secrets share a mask
                    elif p >= threshold:
                        spans.append([i, j])
                ends = [0, *(j for _, j in spans)]
                t = "".join(t[e:i] + mask for e, (i, _) in zip(ends, spans)) + t[ends[-1]:]
                out.append(old if old is None else t)
            yield pd.Series(out, dtype=object)

    out = docs.withColumn("text", F.pandas_udf(run, "string")("text"))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
