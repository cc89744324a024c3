"""Source mixing against a plain water-filling, and the copies that are emitted."""

import hashlib
import re
from collections import Counter

import pytest

from critiq.llm.mixing import emit, mix, targets
from critiq.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, share, cap):
    """Targets by giving out the share again and again until nobody is above the cap."""
    target, free = {s: 0.0 for s in sizes}, {s for s in sizes if weights[s] and sizes[s]}
    left = share * sum(sizes.values())
    while free:
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if level * weights[s] >= cap * sizes[s]}
        if not full:
            return target | {s: level * weights[s] for s in free}
        for s in full:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= full
    return target


@pytest.mark.parametrize("share,cap", [(1.0, 1.0), (1.5, 2.0), (0.3, 4.0), (9.0, 2.0)])
def test_targets(spark, share, cap):
    sizes = {"a": 100, "b": 0, "c": 7, "d": 5000, "e": 1, None: 40, "f": 300}
    weights = {"a": 5.0, "b": 2.0, "c": 0.5, "d": 1.0, "e": 9.0, None: 3.0, "f": 0.0}
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    want = filled(sizes, weights, share, cap)
    assert {r.source: r.target for r in targets(df, share, cap).collect()} == pytest.approx(want)


def test_edge_rows(spark):
    rows = [(1, "one two", "b"), (1, "one two", "b"), (2, None, "b"), (3, "", None), (4, " \t\n", "z"), (None, "x y z", "a"), (None, "x", "a"), (5, "long " * 50_000, "a")]
    df = spark.createDataFrame([(*r, "kept", "clash") for r in rows], "doc_id long, text string, source string, MIX string, copy string")
    out = mix(df, [5, 2, 1], share=1.5, cap=2.0)
    assert out.columns == [*df.columns, "mix_"]
    got = {(r.doc_id, r.text): (r.source, *r.mix_) for r in out.collect()}
    assert out.count() == len(rows)
    assert {v[0]: v[2] for v in got.values()} == {"a": 50_004, "b": 4, "z": 0, None: 0}
    assert got[2, None][1] == got[3, ""][1] == got[4, " \t\n"][1] == 0
    assert got[3, ""][3:] == (0.0, 0) and got[4, " \t\n"][3:] == (0.0, 0)
    assert got[1, "one two"][3:] == (8.0, 2)
    copies = emit(out)
    assert copies.columns == [*df.columns, "copy_"]
    assert Counter(r.doc_id for r in copies.collect() if r.doc_id in (1, 2)) == {1: 4, 2: 2}
    none = mix(df.filter("doc_id = 99"), [1])
    assert none.collect() == [] and emit(none).collect() == []


def test_weights_by_table(spark):
    df = spark.createDataFrame([(k, "w " * 10, s) for k, s in enumerate("abc" * 400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    taken = Counter()
    for r in emit(mix(df, weights, share=0.5, cap=4.0)).collect():
        taken[r.source] += 10
    assert set(taken) == {"a", "b"}
    assert taken["a"] == pytest.approx(4500, rel=0.15) and taken["b"] == pytest.approx(1500, rel=0.2)


def test_query_reaches_its_targets(spark):
    rows = QUERIES["op11_source_mix"](spark, SF).collect()
    size, taken, target = Counter(), Counter(), {}
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(target))}
    assert target == pytest.approx(filled(size, weights, 1.5, 2.0))
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.1)
    again = {r.doc_id: r.taken for r in QUERIES["op11_source_mix"](spark, SF).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_draw_is_the_seeded_hash(spark):
    df = spark.createDataFrame([(k, f"t {k}", "s") for k in range(300)], "doc_id long, text string, source string")
    got = {r.doc_id: r.mix.copies for r in mix(df, [1], share=1.3, seed="x").collect()}
    draw = lambda k: int(hashlib.md5(f"x:{k}:{hashlib.md5(f't {k}'.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
    rate = 1.3 * 600 / 600
    assert got == {k: 1 + (draw(k) < rate - 1) for k in range(300)}
