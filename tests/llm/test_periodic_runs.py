"""Periodic runs against a comparison of words at every distance."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from critiq.llm.periodic_runs import batch_runs, common_extension, grammar, mirrored, periodic_runs
from critiq.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of every run: for each distance, the maximal stretches of equal words."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, z, q) for (s, z), q in found.items())


def plain_row(words):
    runs = plain_runs(words)
    gone = {i for s, z, q in runs for i in range(s + q, s + z)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{z},{q}\n" for s, z, q in runs).encode()
    milli = 1000 * best[1] // best[2] if runs else None
    return (len(runs), *best, milli, lines, b" ".join(w for i, w in enumerate(words) if i not in gone))


def got(texts):
    return [sorted((int(s), int(e - s), int(q)) for s, e, q in zip(*rows)) for rows in batch_runs(texts)]


def periodic_text(rng):
    words = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        words += (unit * 12)[: rng.randint(0, 40)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]
    return [w.encode() for w in words]


def test_random_periodic_texts():
    rng = random.Random(5)
    for _ in range(60):
        texts = [periodic_text(rng) for _ in range(rng.randint(1, 9))]
        assert got(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=40), max_size=4))
def test_two_letters(texts):
    assert got(texts) == [plain_runs(t) for t in texts]


def test_lce_equals_comparison():
    rng = np.random.default_rng(3)
    for size, letters in ((2, 1), (50, 1), (300, 2), (400, 3), (999, 50)):
        body = rng.integers(0, letters, size)
        text = np.concatenate(([letters], np.tile(body, 3), [letters + 1]))
        n = len(text)
        a = rng.integers(1, n - 1, 400)
        b = rng.integers(1, n - 1, 400)
        x, y = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        levels = grammar(text)
        assert len(levels[-1].symbol) == 1
        for lv, t in ((levels, text), (mirrored(levels), text[::-1])):
            t = t.tolist()
            want = []
            for i, j in zip(x.tolist(), y.tolist()):
                k = 0
                while j + k < n and t[i + k] == t[j + k]:
                    k += 1
                want.append(k)
            assert common_extension(lv, x.copy(), y.copy()).tolist() == want


def test_long_texts():
    words = [b"%d" % (i % 7000) for i in range(60_000)]
    assert got([words, [b"x"] * 30_000]) == [[(0, 60_000, 7000)], [(0, 30_000, 1)]]


def test_edge_rows(spark):
    texts = {1: None, 2: "", 3: " \t\n ", 4: "a", 5: "a a a a a", 6: "a a a a a a", 7: "x a b a b a b a b y", 8: "a b a b " * 5, 9: "q " * 9 + "z", 10: "q " * 9 + "z"}
    rows = [(k, t, k) for k, t in texts.items()] + [(None, "b " * 8, 0), (10, texts[10], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs long")
    out = periodic_runs(df)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"]
    want = sorted(((k, *plain_row((t or "").encode().split())) for k, t, _ in rows), key=str)
    assert sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in out.collect()), key=str) == want
    assert periodic_runs(df.filter("doc_id < 0")).collect() == []


def test_query_equals_plain(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {}
    for d in docs:
        words = (d["text"] or "").encode().split()
        h = zlib.crc32(str(d["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        *head, runs, collapsed = plain_row(words)
        want[d["doc_id"]] = (*head, hashlib.sha256(runs).hexdigest(), hashlib.sha256(collapsed).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()} == want
    assert sum(v[0] > 0 for v in want.values()) > 5
