"""Collocations against their SQL over all phrases, with few results so that the frontier is opened in rounds."""

import random

import duckdb
import numpy as np
import pytest

from insight_spark.llm import collocations as co
from insight_spark.llm.oracle import OP12

COLUMNS = "doc_id long, text string, lang string, score string, w1 string, word string, n int, part int"


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 3))) for _ in range(60)] + ["Ünder", "日本", "x\x1cy", " ", "i'm"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    passages = [" ".join(rng.choices(words, k=9)) for _ in range(12)]
    for i in range(400):
        parts = []
        for _ in range(rng.randint(1, 12)):
            body = rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, weights, k=rng.randint(1, 9)))
            parts.append(body.upper() if rng.random() < 0.1 else body)
        rows.append((i, rng.choice([". ", "\t\t", "\n", "; ", "  ", "\r\n"]).join(parts), rng.choice(["en", "en", "de", None])))
    rows += [(900, None, "en"), (901, "", "fr"), (902, " .,;\n", "fr"), (903, "one two", "fr"), (None, "a b c d e", None)]
    rows += [(904, "same words here " * 4000, "es")] + [rows[0]] * 3  # one very long text, repeated rows
    return rows


def expected(rows, top):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return set(con.execute(OP12.replace("rank <= 2000", f"rank <= {top}")).fetchall())


@pytest.mark.parametrize("top", [3, 2000])
def test_collocations_equal_all_phrases(spark, top):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", "x", "x", 1, 1) for r in rows], COLUMNS)
    got = [tuple(r) for r in co.collocations(docs, top).collect()]
    assert len(got) == len(set(got)) and set(got) == expected(rows, top)


def test_small_filters_and_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "FILTER_BITS", 1 << 7)
    monkeypatch.setattr(co, "BLOCK", 1 << 9)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", "x", "x", 1, 1) for r in rows], COLUMNS)
    assert {tuple(r) for r in co.collocations(docs, 40).collect()} == expected(rows, 40)


def test_blocks_end_where_pieces_end():
    rng = np.random.default_rng(0)
    blob = bytes(rng.choice(list(b"ab \n"), 5000, p=[0.4, 0.3, 0.2, 0.1]))
    for most in (1, 7, 100, 9000):
        parts = list(co._blocks(blob, most))
        assert b"".join(parts) == blob and all(p.endswith(b"\n") for p in parts[:-1])


def test_bounds_are_exact_and_admissible(spark):
    big = 6_000_000_000_000_000_000
    rows = spark.createDataFrame([(30, 40, 55), (big, big, big), (7, 9, 1000)], "a long, f1 long, f2 long")
    for r in co._scored(rows, [("f1", "f2")]).collect():
        assert r.score == 2_000_000 * r.a // (r.f1 + r.f2)
        assert r.bound == 2_000_000 * r.a // (r.f1 + r.a)


def test_no_candidates(spark):
    assert co.collocations(spark.createDataFrame([], COLUMNS)).count() == 0
    few = spark.createDataFrame([(1, "a b c", "en", "x", "x", "x", 1, 1)], COLUMNS)
    assert co.collocations(few).count() == 0
