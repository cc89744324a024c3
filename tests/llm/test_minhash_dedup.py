"""MinHash near-duplicates against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from critiq.llm import minhash_dedup, shingles
from critiq.llm.common import components
from critiq.llm.minhash_dedup import minhash_groups

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, pct):
    """(size, component) by id, from all pairs."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, size, changes, words=60):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for k in rng.sample(range(words), rng.randint(0, changes)):
            own[k] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


def corpus(seed):
    rng = random.Random(seed)
    texts = [*family(rng, 40, 4), *family(rng, 25, 6), *family(rng, 6, 2, 12)]
    texts += [texts[0]] * 30 + [texts[3].upper(), "  " + texts[5].replace(" ", "\t\n")]
    texts += ["the common line of all " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30)) for _ in range(40)]
    texts += ["", None, " \n", "one", "ONE", "two words", "two  words", "x " * 3000, "É é", "é é"]
    rng.shuffle(texts)
    return [(7 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width,block", [(2, minhash_dedup.BLOCK), (5, 300)])
def test_equals_brute_force(spark, monkeypatch, width, block):
    """A tiny block makes every family a large one, dealt over many blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    rows = corpus(width)
    docs = spark.createDataFrame([(i, t, "c", "k") for i, t in rows], "doc_id long, text string, component string, n string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_groups(docs, width).collect()}
    assert got == brute(rows, width, 80)


def test_edges(spark):
    kind = "doc_id long, text string"
    assert minhash_groups(spark.createDataFrame([], kind)).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (5, "A  B c"), (6, None)], kind)
    got = sorted(map(tuple, minhash_groups(docs, 2).collect()))
    assert got == [(2, 2, 2, True), (5, 2, 2, False), (6, 0, 6, True)]


def test_shingles_of_batches_and_pieces():
    texts = ["a b c", None, "", "A\x0bb  C", "c" * 10, "é É"] + ["w%d x" % i for i in range(50)]
    whole = list(shingles.shingle_sets(pa.array(texts), 2))
    single = [next(shingles.shingle_sets(pa.array([t], pa.string()), 2)) for t in texts]
    assert all(np.array_equal(a, b) for a, b in zip(whole, single))
    assert np.array_equal(whole[0], whole[3]) and [len(x) for x in whole[1:3]] == [0, 0] and len(whole[5]) == 1
    sliced = list(shingles.shingle_sets(pa.array(["skip me", *texts]).slice(1), 2))
    assert all(np.array_equal(a, b) for a, b in zip(whole, sliced))


def test_block_links_join_what_is_similar():
    rng = np.random.default_rng(1)
    base = np.arange(100)
    x = [np.sort(np.unique(np.concatenate((base[: 100 - k], rng.integers(1000, 10**6, k))))) for k in (0, 5, 9, 50, 52)]
    links = minhash_dedup.joined(np.arange(5), x, np.arange(5), np.arange(5), 80)
    assert {frozenset(p) for p in links} == {frozenset((0, 1)), frozenset((0, 2))}


def test_families_are_dealt_by_rows_too(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "ROWS", 4)
    rows = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute(rows, 2, 80)


def test_many_short_rows_need_no_square():
    """6,000 rows: the square alone would be 144 MB; a hundred parts of 60 rows that share 18 of 20 shingles."""
    rng = np.random.default_rng(2)
    x = [np.sort(np.concatenate((np.arange(18) + 100 * (k % 100), 10**6 + rng.choice(10**9, 2, replace=False)))) for k in range(6000)]
    everything = np.arange(len(x))
    tracemalloc.start()
    links = minhash_dedup.joined(everything, x, everything, everything, 80)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(links) == 5900 and all(a % 100 == b % 100 for a, b in links) and peak < 140e6


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_very_long_texts(spark):
    """Texts of many pieces link by their whole sets; what differs only far behind is seen."""
    words = [f"w{k % 90_001}x{k // 7}" for k in range(150_000)]
    some = [w if k % 1500 else "changed" for k, w in enumerate(words)]
    tail = [w if k < 100_000 else f"other{k}" for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(some)), (3, " ".join(tail)), (4, "\n\t".join(words).upper()), (5, "x " * 500_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (149_996, 1), 2: (149_996, 1), 3: (149_996, 3), 4: (149_996, 1), 5: (1, 5)}
