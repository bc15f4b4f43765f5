"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np

from tessera.llm import vptree as V


def brute(ids, vectors, queries, k):
    norm = np.linalg.norm(vectors, axis=1)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = (vectors * vectors[i]).sum(1) / (norm * norm[i])
        out[q] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def test_factor_one_is_exact_and_less_is_a_trade():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    v = centres[rng.integers(0, 8, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    v[100:140] = v[100]
    ids = rng.permutation(3000) * 3
    tree = V.Tree.load(V.build(ids, v, 32).dump())
    asked = np.sort(ids)[::60]
    at = [int(np.flatnonzero(ids == q)[0]) for q in asked]
    want = brute(ids, v, asked, 5)
    row, name, score, compared = V.search(tree, asked, v[at], 5)
    got = {q: [(int(n), s) for r, n, s in zip(row, name, score, strict=True) if r == i] for i, q in enumerate(asked)}
    for q in asked:
        assert sorted(n for n, _ in got[q]) == sorted(n for n, _ in want[q])
        assert np.allclose(sorted(s for _, s in got[q]), sorted(s for _, s in want[q]), atol=1e-12)
    assert compared < len(asked) * 3000
    row, name, _, fewer = V.search(tree, asked, v[at], 5, factor=0.6)
    hits = sum(n in dict(want[asked[r]]) for r, n in zip(row, name, strict=True))
    assert fewer <= compared and hits >= 0.9 * sum(map(len, want.values()))


def test_query_takes_only_usable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [2.0, 0.0]), (5, [4.0, 0.0]), (6, None), (7, [0.0, 0.0]), (8, [float("nan"), 1.0]), (9, [None, 1.0]), (10, [1.0]), (100, []), (150, [1.0, float("inf")])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    got = [tuple(r) for r in V.nearest(df, df.filter("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 4), (0, 2, 5), (0, 3, 50), (50, 1, 0), (50, 2, 3), (50, 3, 4)]
    assert got[0][3] == 1.0 and abs(got[2][3] - 0.5**0.5) < 1e-15
    assert V.nearest(df.limit(0), df.limit(0)).collect() == []


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 40)
    monkeypatch.setattr(V, "BLOCK", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    v[:30] = v[0]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(400)], "vec_id long, embedding array<float>")
    want = brute(np.arange(400), v.astype(float), range(0, 400, 50), 5)
    got = {}
    for r in V.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in w] for q, w in want.items()}


def test_tiny_and_huge_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 60)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8))
    scale = np.ones(300)
    scale[[3, 50]], scale[[4, 100]], scale[7] = 1e-200, 1e200, 5e-310
    df = spark.createDataFrame([(i, [float(x) for x in v[i] * scale[i]]) for i in range(300)], "vec_id long, embedding array<double>")
    want = brute(np.arange(300), v, range(0, 300, 50), 5)
    got = {}
    for r in V.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-6 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_clusters_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 100)
    monkeypatch.setattr(V, "BLOCK", 4)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    v = centres[rng.integers(0, 20, 1500)] + 0.05 * rng.normal(size=(1500, 8))
    v[::3] = v[0]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(1500)], "vec_id long, embedding array<double>").repartition(3)
    want = brute(np.arange(1500), v, range(0, 1500, 50), 5)
    got = {}
    for r in V.nearest(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    assert set(got) == set(want) and all(np.allclose(got[q], [s for _, s in want[q]], atol=1e-12) for q in want)


def test_compared_share_of_clustered_vectors_and_recall():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 6000)] + 0.15 * rng.normal(size=(6000, 32))
    ids = np.arange(6000)
    tree, asked = V.build(ids, v), ids[::50]
    want = brute(ids, v, asked, 5)
    shares, recalls = [], []
    for factor in (1.0, 0.5):
        row, name, _, compared = V.search(tree, asked, v[asked], 5, factor)
        shares.append(compared / (len(asked) * 6000))
        recalls.append(sum(n in dict(want[asked[r]]) for r, n in zip(row, name, strict=True)) / (5 * len(asked)))
    assert recalls[0] == 1 and recalls[1] >= 0.9 and shares[1] <= shares[0] < 0.25, (shares, recalls)
    best = np.array([want[q][-1][1] for q in asked])
    _, _, _, fewer = V.search(tree, asked, v[asked], 5, 1.0, best)
    assert fewer <= shares[0] * len(asked) * 6000 * 1.01
