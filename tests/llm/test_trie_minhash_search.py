"""Prefix tries, MinHash near duplicates and ranked search against plain forms, on odd rows and small shards."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import minhash, prefix_trie, ranked_search

ROWS = "conv_id long, turn long, role string, text string, n_convs int"


def plain_trie(rows, every=100, most=5):
    own = {}
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        built[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:]
    members, ends = {}, {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
        ends.setdefault(tuple(built[c]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children.get(n, [])), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest())
        for n, m in members.items()
    )


def _conversations(seed, n=260):
    """Turns of few kinds, so prefixes are shared to any depth; a third begins alike and goes on alike for a while."""
    draw, rows = random.Random(seed), []
    for c in range(n):
        length = draw.choice([1, 2, 3, 5, 9])
        turns = [f"t{draw.randrange(3)}" for _ in range(length)]
        if c % 3 == 0:
            turns = ["same"] * 6 + turns
        rows += [(c, k if k else None, "user" if k % 2 else None, t if t != "t2" else None, 1) for k, t in enumerate(turns)]
    return rows + [(None, 1, "user", "no conversation", 1), (-7, 1, "a", "né" * 40_000, 1), (1005, 0, "user", "only turn", 1)]


@pytest.mark.parametrize("shard", [1, 7, 60, 1 << 18])
def test_trie_of_small_shards_agrees_with_a_plain_one(spark, shard):
    rows = _conversations(shard)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), ROWS)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(df)), shard)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_trie(rows), key=str)


def test_trie_of_copies_repeated_rows_and_no_rows(spark):
    rows = [(c, t, "user", f"hello {t}", 1) for c in range(300) for t in range(4)]
    rows += [(7, 2, "user", "hello 2", 1)]
    df = spark.createDataFrame(rows, ROWS)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(df)), 50)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_trie(rows), key=str)
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(df.limit(0)))).count() == 0


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone", 1), (c, 1, "user", "gone too", 1)]
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame(rows, ROWS)))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_double_array_holds_its_tree_and_nothing_else():
    draw = random.Random(3)
    for n in (1, 2, 50, 3000):
        parent, code, seen = [0], [0], {}
        while len(parent) < n:
            p, c = draw.randrange(len(parent)) if draw.random() < 0.7 else 0, draw.randrange(1, 2 * n)
            if (p, c) not in seen:
                seen[p, c] = len(parent)
                parent.append(p)
                code.append(c)
        array = prefix_trie.packed(np.array(parent), np.array(code))
        assert (array.check >= 0).sum() == n - 1
        state = {0: 0}
        for v in range(1, n):
            state[v] = int(array.step(np.array([state[parent[v]]]), np.array([code[v]]))[0])
        assert len(set(state.values())) == n and min(state.values()) == 0
        for v in range(min(n, 60)):
            for c in range(1, 2 * n, max(1, n // 40)):
                assert (int(array.step(np.array([state[v]]), np.array([c]))[0]) >= 0) == ((v, c) in seen)


def test_seals_are_running_hashes_over_batches():
    import pyarrow as pa

    rows = [(bytes([k]), i) for k in range(4) for i in range(k * 5 + 1)]
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"seq": pa.array([r[0] for r in rows[a : a + size]], pa.binary()), "conv_id": [r[1] for r in rows[a : a + size]]}) for a in range(0, len(rows), size)]
        got = {a: b for x in prefix_trie.sealed(iter(batches)) for a, b in zip(x["seq"].to_pylist(), x["ends_sha256"].to_pylist(), strict=True)}
        assert got == {bytes([k]): hashlib.sha256(",".join(map(str, range(k * 5 + 1))).encode()).hexdigest() for k in range(4)}


# near duplicates


def plain_components(rows, width=3, num=85):
    sets = {}
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())
    group = {d: d for d in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in docs)


def _near_copies(seed, groups=12, copies=9):
    draw, rows = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([5, 9, 30, 200]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                text[draw.randrange(len(text))] = f"x{draw.randrange(9)}"
            rows.append((len(rows), draw.choice([" ", "\n", "\t "]).join(text).title() if draw.random() < 0.3 else " ".join(text)))
    return rows


@pytest.mark.parametrize("block", [600, minhash.BLOCK])
def test_near_duplicates_agree_with_all_pairs(spark, block):
    rows = _near_copies(5) + [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "é " * 60_000), (907, "É " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("extra")).withColumn("component_id", F.lit(1))
    got = minhash.near_duplicates(df.repartition(3), block=block)
    assert sorted(map(tuple, got.collect())) == plain_components(rows)


def test_near_duplicates_of_one_large_group_in_small_blocks(spark):
    draw = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):  # a chain of drifting copies: far ends share little, neighbours link
        base[draw.randrange(120)] = f"y{k}"
        rows.append((k, " ".join(base)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=4000)
    assert sorted(map(tuple, got.collect())) == plain_components(rows)


def test_near_duplicates_of_repeated_null_and_no_ids(spark):
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "a b c d e f g h i j"), (3, "k l m n o p q r s t"), (None, "a b c d e f g h i j"), (None, None), (4, "u v w x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 8, 1, True), (1, 8, 1, True), (2, 8, 1, False), (3, 8, 1, False), (4, 2, 4, True), (None, 8, None, None), (None, 0, None, None)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_minima_are_those_of_each_hash_and_rarely_miss():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 1 << 64, n, np.uint64)) for n in (0, 1, 5, 400)]
    edges = np.cumsum([0, *map(len, sets)])
    got = minhash.minima(np.concatenate(sets), edges)
    for s, row in zip(sets, got, strict=True):
        want = [min((((int(x) * int(a) + int(b)) & (1 << 64) - 1) >> 32 for x in s), default=0xFFFFFFFF) for a, b in zip(minhash.TIMES, minhash.PLUS, strict=True)]
        assert row.tolist() == want
    agree, band = [], []
    for _ in range(300):  # pairs at the threshold: 17 of 20 shingles are in both
        both = draw.integers(0, 1 << 64, 20 * draw.integers(1, 20), np.uint64)
        n = len(both) // 20
        a, b = np.sort(both[: -2 * n]), np.sort(np.append(both[: -3 * n], both[-2 * n :][:n])) if n > 1 else np.sort(np.append(both[:17], both[18:19]))
        jaccard = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        m = minhash.minima(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        agree.append(((m[0] == m[1]).mean(), jaccard))
        band.append((minhash.bands(m[:1]) == minhash.bands(m[1:])).any())
    assert abs(np.mean([x for x, _ in agree]) - np.mean([x for _, x in agree])) < 0.02 and all(band)
    assert min(x for x, _ in agree) * 150 >= minhash.AGREE


# ranked search


def plain_search(docs, items, k=10):
    def terms(text):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    docs = [(d, terms(t)) for d, t in docs]
    docs = [(d, t) for d, t in docs if t]
    n, length = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for d, t in docs:
            m = 100 - 75 + (75 * len(t) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in wanted if x in df and x in t)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _searched(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("item_id", F.lit(2)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("extra"))
    return sorted(map(tuple, ranked_search.search(d, i, **more).collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"shard_docs": 40, "item_bytes": 200}, {"k": 3, "shard_docs": 300}])
def test_search_agrees_with_scores_of_all_documents(spark, more):
    draw = random.Random(11)
    words = [f"{a}{b}" for a in ("Re", "th", "é", "x7", "日") for b in range(60)]
    weights = [1 / (1 + i) for i in range(len(words))]
    docs = [(d, draw.choice([" ", "-", ", "]).join(draw.choices(words, weights, k=draw.choice([1, 3, 20, 90])))) for d in range(700)]
    docs += [(d, docs[5][1]) for d in (701, 705, 703, 705)] + [(None, docs[5][1]), (710, None), (711, ""), (712, " .,;"), (713, "th1 " * 30_000), (714, "RE0 re1")]
    items = [(i, " ".join(draw.choices(words, weights, k=draw.choice([1, 2, 12, 60])))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "unheard of"), (None, "re0"), (33, docs[5][1]), (3, "re0 re0 x71"), (34, "th1")]
    assert _searched(spark, docs, items, **more) == plain_search(docs, items, more.get("k", 10))


def test_search_of_empty_tables(spark):
    assert _searched(spark, [], [(1, "a")]) == []
    assert _searched(spark, [(1, "a")], []) == []
    assert _searched(spark, [(1, " "), (2, None)], [(1, "a b")]) == []
    assert _searched(spark, [(1, "a")], [(1, " .")]) == []


def test_search_skips_documents_that_cannot_be_among_the_best():
    """In a shard of 4096 documents most are never looked up, and the best are the same as by full sums."""
    draw = np.random.default_rng(2)
    docs, vocabulary = 4096, 30
    tf = draw.poisson(0.6 / (1 + np.arange(vocabulary)[:, None] / 4), (vocabulary, docs))
    tf[-2:, 100:] = 0
    term, doc = np.nonzero(tf)
    weight = 1000 + 400 * np.arange(vocabulary)
    shard = ranked_search.Shard([term, doc, tf[term, doc]], np.arange(docs), np.zeros(docs, bool), np.full(docs, 100), weight)
    total = np.zeros(docs, np.int64)
    np.add.at(total, shard.doc, shard.share)
    got, score = shard.best(np.arange(vocabulary), np.ones(vocabulary, np.int64), 0, 10)
    best = np.lexsort((got, -score))[:10]
    want = np.lexsort((np.arange(docs), -total))[:10]
    assert got[best].tolist() == want.tolist() and score[best].tolist() == total[want].tolist()
    floor = int(total[want[-1]])
    again, _ = shard.best(np.arange(vocabulary), np.ones(vocabulary, np.int64), floor, 10)
    assert sorted(again.tolist()) == sorted(np.flatnonzero(total >= floor).tolist())[: len(again)] and len(again) >= 10
