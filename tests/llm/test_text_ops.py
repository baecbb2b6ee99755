"""BPE, packing, SimHash, fingerprints and token shards against brute force on a fixture of odd cases."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from insight_spark.llm import bpe, fingerprint, packing, simhash, token_shards
from insight_spark.llm.common import components

from .conftest import PATTERN, RANKS, WORDS


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_bpe_equals_tiktoken(make_docs, odd_rows):
    pairs = bpe.BytePairs(RANKS, PATTERN)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    want = Counter()
    for d, t in odd_rows:
        ids = np.array(own.encode_ordinary(t or ""), "<u4").tobytes()
        want[(d, len(ids) // 4, sha(ids), sha((t or "").encode()))] += 1
    docs = make_docs(odd_rows)
    assert Counter(tuple(r) for r in bpe.round_trip(docs, RANKS, PATTERN).collect()) == want
    encoded = bpe.encode(docs, RANKS, PATTERN)
    back = bpe.decode(encoded, RANKS, PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((d, (t or "").encode()) for d, t in odd_rows)


def test_bpe_long_and_short_cuts_merge_alike():
    pairs = bpe.BytePairs(RANKS, PATTERN)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcetinos"), n)) for n in (1, 2, 3, 17, 64, 255, 256, 257, 900)] * 3
    for text, ids in zip(texts, pairs.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode_ordinary(text)


def test_word_tokenizer_equals_library():
    library, own = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    texts = ["", " ", "Don't stop, we'll 've x''s 's", "12.5e-3 ### *** a1b2", "ÀÉÎ ñandú Straße", "á Å", "İstanbul ΣΑΣ",
             "a b c\x1cd", "<|endoftext|>x", "\x00 \x01", "tab\tline\r\nend", "日本語 🙂", "word " * 3000, "ª º × ÷"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing(make_docs, odd_rows, spark):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, t in odd_rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 256)):
            cut = ids[at : at + 256]
            want[(d, k, at, len(cut), zlib.crc32(cut.tobytes()))] += 1
    rows = packing.pack_documents(make_docs(odd_rows), WORDS, capacity=256, open_bins=4).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 256
    assert len(bins) <= 1.15 * sum(r.length for r in rows) / 256 + 1
    assert packing.pack_documents(make_docs([]), WORDS).count() == 0


def test_packing_with_several_packers_and_sequences(make_docs, odd_rows):
    distinct = [(i, t) for i, (_, t) in enumerate(odd_rows)]
    docs = make_docs(distinct)
    packed = packing.pack_documents(docs, WORDS, capacity=128, group_tokens=2000)
    places = packed.collect()
    assert len({(r.sequence_id, r.offset) for r in places}) == len(places)
    library = Tokenizer.from_file(WORDS)
    made = {r.sequence_id: r.ids for r in packing.sequences(docs, packed, WORDS, capacity=128).collect()}
    for r in places:
        ids = [*library.encode(distinct[r.doc_id][1] or "", add_special_tokens=False).ids, 1]
        assert made[r.sequence_id][r.offset : r.offset + r.length] == ids[r.start : r.start + r.length]


def test_best_fit_rule():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    packer = packing.BestFit(10, 2)
    assert [packer.place(n)[0] for n in (6, 7, 8)] == [0, 1, 2]  # the third opens a bin and the fullest, 7, closes
    assert packer.place(2)[0] == 2 and packer.place(3)[0] == 0


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes(range(256))).split()
    words = [w.lower() for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    comp = {f: f for f in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= bits:
                comp[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(make_docs, odd_rows):
    fps = [(d, brute_fingerprint(t)) for d, t in odd_rows]
    for bits in (2, 12):
        comp = brute_components({f for _, f in fps}, bits)
        first = {}
        for d, f in fps:
            if d is not None:
                first[comp[f]] = min(d, first.get(comp[f], d))
        want = Counter((d, f"{f:016x}", first.get(comp[f])) for d, f in fps)
        near = simhash.near_duplicates(make_docs(odd_rows), bits=bits)
        got = near.select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id").collect()
        assert Counter(tuple(r) for r in got) == want


def test_simhash_keeps_one_of_each_component(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    comp = brute_components({brute_fingerprint(t) for _, t in odd_rows}, 2)
    best = {}
    for d, t in odd_rows:
        key, c = (d is None, d or 0), comp[brute_fingerprint(t)]
        best[c] = min(best.get(c, key), key)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(None if n else d for n, d in best.values())
    assert simhash.keep_one(make_docs([])).count() == 0
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_trie_cells_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    ball = base[0] ^ np.array([1 << i for i in range(64)], np.uint64)  # one dense group
    fps = np.unique(np.concatenate([base, near, ball]))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    want = brute_components([int(f) for f in fps], 2)
    # small cells and bounds: several bits of depth, and cells that are split
    edges = simhash.links(table, cell=16, bound=24)
    got = {r.node & (2**64 - 1): r.component for r in components(edges).collect()}
    groups = defaultdict(set)
    for f, c in want.items():
        groups[c].add(f)
    for members in groups.values():
        if len(members) > 1:
            assert len({got[m] for m in members}) == 1
        else:
            assert not members & got.keys()
    assert len({got[m] for m in got}) == sum(len(m) > 1 for m in groups.values())


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}




def test_fingerprints(make_docs, odd_rows, spark):
    rows = [(i, t) for i, (_, t) in enumerate(odd_rows)]
    for range_rows in (1000, 4):
        got = {r.doc_id: r for r in fingerprint.edited_and_next(make_docs(rows), range_rows=range_rows).collect()}
        order = sorted(rows, reverse=True)
        assert len(got) == len(rows)
        by_text = {}
        for i, (d, t) in enumerate(order):
            t, after = t or "", order[(i + 1) % len(order)][1] or ""
            m = len(t) // 3
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), sha((t[: len(t) - m] + after[:m]).encode()))
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
            f, g = ({x[k : k + 8] for k in range(0, len(x), 8)} for x in (r.fingerprint, got[order[(i + 1) % len(order)][0]].fingerprint))
            assert r.near_next == (len(f & g) / len(f | g) if f | g else 1.0)
    assert fingerprint.edited_and_next(make_docs([])).count() == 0
    alone = fingerprint.edited_and_next(make_docs([(None, "a b c")])).first()
    assert alone.n_chars == 5 and alone.near_next == 1.0


def test_closed_syncmers_by_definition(spark):
    words = [f"w{i * 7919 % 101}" for i in range(200)]
    hashes = {}
    table = spark.createDataFrame([(w,) for w in sorted(set(words))], "w string")
    for r in table.select("w", F.xxhash64("w").alias("h")).collect():
        hashes[r.w] = r.h
    pairs = spark.createDataFrame([(hashes[a], hashes[b]) for a, b in zip(words, words[1:])], "a long, b long")
    runs = [r.h for r in pairs.coalesce(1).select(F.xxhash64("a", "b").alias("h")).collect()]
    want = [i for i in range(len(words) - 4) if min(runs[i : i + 4]) in (runs[i], runs[i + 3])]
    text = spark.createDataFrame([(" ".join(words),)], "text string")
    got = text.select(fingerprint.anchors(F.col("text")).alias("a")).first().a
    assert [x.pos for x in got] == want
    shifted = text.select(fingerprint.matches(
        fingerprint.anchors(F.col("text")), fingerprint.anchors(F.concat(F.lit("new words first "), F.col("text")))).alias("m")).first().m
    assert {x.pos_b - x.pos_a for x in shifted if x.pos_b - x.pos_a > 0} <= {3} | set(range(200))


def test_permutation_is_one():
    for n in (1, 2, 3, 10, 1000, 4097):
        assert sorted(token_shards.permute(np.arange(n), n).tolist()) == list(range(n))
    assert token_shards.permute(np.arange(1000), 1000, key=1).tolist() != token_shards.permute(np.arange(1000), 1000, key=2).tolist()


def test_token_shards_read_back(make_docs, odd_rows, spark, tmp_path):
    source, folder = f"file://{tmp_path}/docs", f"file://{tmp_path}/shards"
    make_docs(odd_rows).repartition(3).write.parquet(source)
    docs = spark.read.parquet(source)
    slots = token_shards.write(docs, RANKS, PATTERN, folder, length=64, per_shard=40).collect()
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.BytePairs(RANKS, PATTERN).ranks, special_tokens={})
    want = Counter()
    for d, t in odd_rows:
        ids = [*own.encode_ordinary(t or ""), token_shards.END_ID]
        for k in range(0, len(ids), 64):
            want[(d, k // 64, tuple(ids[k : k + 64]))] += 1
    n = sum(want.values())
    assert sorted(r.slot for r in slots) == list(range(n))
    assert all((r.shard, r.offset) == (r.slot // 40, r.slot % 40 * (16 + 128)) for r in slots)
    back = token_shards.read(spark, folder, 0, n, length=64, per_shard=40).collect()
    assert Counter((r.doc_id, r.piece, tuple(r.tokens)) for r in back) == want
    some = token_shards.read(spark, folder, 35, 90, length=64, per_shard=40, tasks=3).collect()
    assert [r.slot for r in some] == list(range(35, 90))
    assert {r.slot: (r.doc_id, r.piece) for r in back} == {r.slot: (r.doc_id, r.piece) for r in slots}
    empty = token_shards.write(make_docs([]), RANKS, PATTERN, f"file://{tmp_path}/none")
    assert empty.count() == 0
