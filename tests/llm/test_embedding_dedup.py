"""Embedding near-duplicates against brute force."""

import tracemalloc

import numpy as np

from critiq.llm import embedding_dedup
from critiq.llm.embedding_dedup import embedding_groups, near_in_tile, tile_links

KIND = "vec_id long, embedding array<float>, label int, links string"


def brute(rows, threshold):
    good = {i: np.array(v, np.float64) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in root}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 24))
    rows = [rng.normal(size=24) for _ in range(60)]
    rows += [base[k % 12] + rng.normal(size=24) * rng.uniform(0, 0.35) for k in range(120)]
    rows += [base[0].copy() for _ in range(40)] + [base[0] * 3, base[1] * 1e-20, base[1] * 1e20]
    rows = [np.float32(r).tolist() for r in rows]
    rows += [None, [], [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows = [(5 * i + 1, v) for i, v in enumerate(rows)]
    got = embedding_groups(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], KIND), 0.95)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute(rows, 0.95)


def test_edges(spark):
    assert embedding_groups(spark.createDataFrame([], KIND)).count() == 0
    got = embedding_groups(spark.createDataFrame([(None, [1.0], 0, "x"), (3, [1.0], 0, "x"), (3, [1.0], 0, "x"), (4, None, 0, "x")], KIND))
    assert sorted(map(tuple, got.collect())) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 50))
    x[100:] = x[:100] + rng.normal(size=(100, 50)) * 0.3
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    i, j = near_in_tile(x, x, 0.9, steps=(3, 10, 30))
    assert set(zip(i.tolist(), j.tolist())) >= set(zip(*(v.tolist() for v in np.nonzero(x @ x.T >= 0.9))))
    assert len(i) < 1000


def test_a_tile_of_near_vectors_is_counted_in_bounded_memory():
    """6,000 vectors that are all near each other: 18 million pairs, of which a strip's are held."""
    rng = np.random.default_rng(6)
    n, dim = 6000, 32
    x = rng.normal(size=dim) + rng.normal(size=(n, dim)) * 0.05
    copies = rng.integers(1, 4, n)
    tracemalloc.start()
    links, u, v = tile_links(x, copies, np.eye(dim), np.arange(n), np.arange(n), True, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert (links == copies.sum() - copies).all() and len(u) == n - 1
    a, b = np.arange(0, n, 2), np.arange(1, n, 2)
    links, u, v = tile_links(x[:400], copies[:400], np.eye(dim), a[:200], b[:200], False, 0.95)
    assert (links[a[:200]] == copies[b[:200]].sum()).all() and len(u) == 399
