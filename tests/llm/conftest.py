import random

import public_tokenizers
import pytest

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN

#: Columns whose names the operators use inside, on purpose.
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, fp string, range string, real string, "
        "component string, n int, cell string, score string, length string, sequence_id string, __llm_x string")


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) rows with extra columns whose names clash."""

    def make(rows):
        full = [(d, t, "en", "src0", None if t is None else len(t), *(["x"] * 4), 1, *(["x"] * 5)) for d, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, odd white space and characters, repeated rows, copies."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9)))
    long = " ".join(word() for _ in range(9000))
    plain = [" ".join(word() for _ in range(rng.randint(5, 80))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(30, None), (31, ""), (32, "  \n\t "), (33, "one"), (34, "two words"), (35, "Don't  STOP,\r\nÀé ﬁ ß 12.5!"),
             (36, "日本語 テキスト 🙂"), (37, "x" * 5000), (38, long), (39, plain[0]), (40, plain[0].upper()),
             (41, plain[1] + " tail"), (42, "<|endoftext|> </s> [INST] \\l \\"), (43, None), (None, plain[2]), (None, None)]
    return rows + [(5, plain[5]), (5, plain[5]), (30, None)]
