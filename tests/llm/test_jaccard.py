"""The Jaccard join against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard as J
from tessera.llm.trie import Trie


def brute(texts: dict, k: int, percent: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed: int, groups: int, copies: int, words: int) -> dict:
    rng, texts = random.Random(seed), []
    shared = [f"p{i}" for i in range(words // 2)]
    for g in range(groups):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(3, words))] + (shared if g % 2 else [])
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(rng.choice((" ", "\n", "  ")).join(w))
    rng.shuffle(texts)
    out = dict(enumerate(texts, 1))
    out[-6] = " ".join(f"long{i % 7000}" for i in range(60_000))
    return out | {-5: None, -4: "", -3: " \t\n", -2: "One Two", -1: "one  two", 0: "one three"}


@pytest.mark.parametrize(("k", "percent", "seed"), [(4, 85, 1), (5, 80, 2)])
def test_join_equals_brute_force(spark, k, percent, seed):
    texts = corpus(seed, 40, 8, 90)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in texts.items()], "doc_id long, text string, node string, comp string").withColumns({c: F.lit("z") for c in ("row", "keys", "gram", "n", "rank", "a", "b")}).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(df, k=k, percent=percent).collect()}
    assert got == brute(texts, k, percent)


def test_variants_about_the_threshold(spark):
    """Groups without a common original, in which some pairs link and most nearly do, and texts that only share a passage."""
    rng, texts = random.Random(3), []
    passage = [f"p{i}" for i in range(40)]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(70)]
        for _ in range(40):
            texts.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < rng.choice((0.01, 0.03, 0.05)) else w for w in base))
        for _ in range(20):
            texts.append(" ".join([f"u{rng.randrange(10**6)}" for _ in range(30)] + passage + base[:10]))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, percent in ((4, 85), (3, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(df, k=k, percent=percent).collect()}
        assert got == brute(dict(enumerate(texts)), k, percent)


def test_small_sets_equal_brute_force(spark):
    rng, texts = random.Random(8), []
    for _ in range(900):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 32))]
        texts += [" ".join(w), " ".join(w + [f"w{rng.randrange(10**6)}"] * rng.randint(0, 2)), " ".join(w[1:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(df, k=4, percent=85).collect()}
    assert got == brute(dict(enumerate(texts)), 4, 85)


def test_hash_order_can_not_lose_a_link(spark):
    words = "w688554 w286171 w679689 w746156 w308798 w476789 w736756 w337643 w520611"
    rows = [(1, words), (2, words + " w496784"), (3, "something else entirely that is long enough")]
    assert sorted(map(tuple, J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect())) == [(1, 6, 1), (2, 7, 1), (3, 4, 3)]


def test_empty_table_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_join(none).collect() == []
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "z")], "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_join(twice).collect()), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 1, 2)], key=str)
    kept = J.keep_one(twice.withColumn("comp", twice.text))
    assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", "a b c d e f"), (2, "z", "z")]
    assert J.keep_one(none).columns == ["doc_id", "text"] and J.keep_one(none).collect() == []


def test_keep_one_of_rows_without_doc_id(spark):
    w = [f"w{i}" for i in range(60)]
    near = " ".join(w[:-1] + ["x"])
    rows = [(None, " ".join(w), "a"), (None, near, "b"), (None, "q r s", "c"), (None, "q r s", "d"), (5, "t u v", "e"), (None, "t u v", "f"), (7, "", "g"), (7, None, "h"), (None, " \n", "i")]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string, row string")).collect()
    assert sorted(r.row for r in kept if r.row in "efghi") == ["e", "g", "h", "i"]
    assert len({r.row for r in kept} & set("ab")) == len({r.row for r in kept} & set("cd")) == 1 and len(kept) == 6


def test_near_copies_without_doc_id_link(spark):
    w = [f"w{i}" for i in range(60)]
    near = [" ".join(w[:i] + ["x"] + w[i + 1 :]) for i in (1, 58)]
    lone = [" ".join(f"{c}{i}" for i in range(60)) + e for c, e in (("u", " y"), ("u", ""))]
    rows = [(7, " ".join(w)), (None, near[0]), (None, near[0]), (9, near[1]), (None, lone[0]), (None, lone[1]), (None, ""), (None, None)]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=4, percent=85).collect()
    want = [(7, 57, 7), (None, 57, 7), (None, 57, 7), (9, 57, 7), (None, 58, None), (None, 57, None), (None, 0, None), (None, 0, None)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sketches_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(40_000):
        n, percent = int(rng.integers(1, 31) if rng.random() < 0.9 else rng.integers(31, 400)), int(rng.choice((50, 80, 85, 95)))
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        keep = rng.random(len(a)) > rng.random() * (100 - percent) / 100
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 1 << 64, int(rng.integers(0, 2 + len(a) * (100 - percent) // 120)), np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or not inter or 100 * inter < percent * (len(a) + len(b) - inter):
            continue
        a, b = sorted((a, b), key=len)
        (whole, _), (part, _), (small, _), (_, large) = (x.tolist() for x in J.sketch_bounds([len(a), len(b)], percent))
        both = len(np.intersect1d(a[:part], b[: J.sketch_bounds(len(b), percent)[0]]))
        assert both >= small and both >= large and part <= whole
        met += 1
    assert met > 10_000


def test_trie_finds_what_brute_force_finds():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > rng.random() * 0.3], rng.integers(0, 1 << 60, int(rng.integers(0, 30))).astype(np.uint64)])) for _ in range(80)]
    sets += [sets[0], base[:1], base[:0]]
    trie = Trie(sets)
    for percent in (50, 80, 85, 100):
        for probe in sets[::7]:
            want = {i for i, s in enumerate(sets) if len(probe) and 100 * len(np.intersect1d(probe, s)) >= percent * len(np.union1d(probe, s))}
            assert set(trie.search(probe, percent)) == want
