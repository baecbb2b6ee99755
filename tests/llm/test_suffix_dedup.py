"""Removal of long repeats against brute force over all windows."""

import random

import numpy as np
import pytest

from insight_spark.llm import suffix_dedup as sd


def brute(rows, length):
    """(doc_id, n_bytes, spans, kept) of every row."""
    texts = [(sd.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for (own, _), (d, t) in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i + 1 : i + 1 + length] = True
        edge = np.diff(gone.astype(int))
        spans = tuple(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        out.append((own, len(t), spans, bytes(c for c, g in zip(t, gone[1:-1]) if not g)))
    return sorted(out, key=repr)


def odd_corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 40))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 9):] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(3, 25)))
                 for _ in range(rng.randint(1, 6))]
        rows.append((rng.randint(0, 1 << 40), rng.choice([" ", "\n", "\x00"]).join(parts)))
    rows += [(i, "=" * n) for i, n in ((3, 49), (4, 50), (5, 51), (6, 700))]  # periods of one byte
    rows += [(7, "ab" * 90), (8, "x" + "ab" * 60), (9, "abc" * 50), (10, None), (11, ""), (12, "short"), (13, "日本語" * 30)]
    rows += [(14, rows[0][1]), (14, rows[0][1]), (14, rows[1][1]), (None, rows[1][1]), (None, rows[1][1] + " more"), (None, None)]
    return rows + [(15, rows[2][1] * 40), (-5, rows[3][1]), (16, rows[4][1][5:])]


@pytest.mark.parametrize(("length", "ranges", "batch_bytes"), [(50, 16, 1 << 23), (50, 2, 500), (25, 5, 2000)])
def test_removal_equals_brute_force(make_docs, length, ranges, batch_bytes):
    rows = odd_corpus()
    found = sd.remove_repeats(make_docs(rows), length, ranges, batch_bytes, part_bytes=1000).collect()
    got = sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in found), key=repr)
    assert got == brute(rows, length)


def test_hot_anchors_split_by_windows(make_docs, monkeypatch):
    monkeypatch.setattr(sd, "HOT_LEAST", 2)
    monkeypatch.setattr(sd, "HOT_SHARE", 0.0)
    rows = odd_corpus()
    found = sd.remove_repeats(make_docs(rows), batch_bytes=500).collect()
    assert sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in found),
                  key=repr) == brute(rows, 50)


def test_runs_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 300)
    texts = [(t or "").encode() for _, t in odd_corpus()]
    runs = sd.runs_of(texts)
    windows = {(d, a + i) for d, a, n in zip(runs.doc.tolist(), runs.at.tolist(), runs.n.tolist()) for i in range(n)}
    assert sum(runs.n.tolist()) == len(windows)
    assert windows == {(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)}
    named = {}
    assert sd.runs_of([]).n.sum() == 0
    for d, a, n, m in zip(runs.doc.tolist(), runs.at.tolist(), runs.n.tolist(), runs.anchor.tolist()):
        for i in range(a, a + n):
            assert named.setdefault(texts[d][i : i + 50], m) == m


def test_levels_merge_geometrically():
    levels, seen = sd.Levels(), set()
    rng = np.random.default_rng(1)
    for batch in range(1, 33):
        keys = np.unique(np.char.mod("%06d", rng.integers(0, 5000, 100)).astype("S6"))
        known = levels.scan(keys)
        assert known.tolist() == [k in seen for k in keys.tolist()]
        levels.add(keys[~known])
        seen |= set(keys.tolist())
        assert len(levels.levels) == bin(batch).count("1")
        assert all(np.all(level[1:] > level[:-1]) for _, level in levels.levels)


def test_suffix_array_is_sorted():
    data = np.frombuffer(bytes(random.Random(2).choices(b"ab\x00\xff", k=3000)), np.uint8)
    starts = np.arange(len(data) - 49)
    order, _ = sd.suffix_array(data, starts)
    raw = data.tobytes()
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in starts)


def test_empty_and_short(make_docs):
    assert sd.remove_repeats(make_docs([])).count() == 0
    assert [tuple(r) for r in sd.remove_repeats(make_docs([(1, "ab"), (2, "ab")])).select("doc_id", "kept").orderBy("doc_id").collect()] == [
        (1, bytearray(b"ab")), (2, bytearray(b"ab"))]
    with pytest.raises(ValueError):
        sd.remove_repeats(make_docs([]), 24)
