"""The Merkle manifest against trees built leaf by leaf."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest

from critiq.llm import merkle
from critiq.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, arity):
    """(last node, the steps of every leaf)."""
    at, steps, now = list(range(len(leaves))), [[] for _ in leaves], list(leaves)
    while len(now) > 1:
        for k, i in enumerate(at):
            run = i - i % arity
            steps[k].append(("".join(now[run:i]), "".join(now[i + 1 : run + arity])))
        now = [h(*now[k : k + arity]) for k in range(0, len(now), arity)]
        at = [i // arity for i in at]
    return now[0], steps


def plain(rows, arity=3):
    """(doc_id, source, leaf) -> (subroot, root, steps) for rows of these."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = tree([r[2] for r in groups[g]], arity)
    root, upper = tree([trees[g][0] for g in order], arity)
    return {r: (trees[g][0], root, [*trees[g][1][k], *upper[j]]) for j, g in enumerate(order) for k, r in enumerate(groups[g])}


def check(spark, rows, arity=3):
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    got = merkle.manifest(df, arity=arity).collect()
    assert len(got) == len(rows)
    want = plain(rows, arity)
    assert {(r.doc_id, r.source, r.leaf): (r.subroot, r.root, [tuple(s) for s in r.path]) for r in got} == want


@pytest.mark.parametrize("arity,sizes", [(3, [1]), (3, [3, 1, 4]), (3, [244, 243, 2]), (2, [33, 32, 1, 7]), (2, [1100, 5]), (5, [26, 3125])])
def test_trees(spark, arity, sizes):
    rng = random.Random(sum(sizes))
    rows = [(k * 7 + rng.randint(0, 6), f"s{g}" if g else None, h(str((g, k)))) for g, n in enumerate(sizes) for k in range(n)]
    rng.shuffle(rows)
    check(spark, rows, arity)


def test_many_groups(spark):
    check(spark, [(1, f"s{k}é", h(str(k))) for k in range(800)])


def test_repeats_nulls_and_clashing_names(spark):
    rows = [(None, None, h("x")), (1, None, h("y")), (1, None, h("z")), (2, "", h("v")), (3, "é", h("w"))]
    check(spark, rows)
    twice = spark.createDataFrame([*rows, rows[1]], "doc_id long, source string, leaf string")
    got = merkle.manifest(twice).collect()
    assert len(got) == 6 and len({r.root for r in got}) == 1
    assert all(fold(r.leaf, r.path) == r.root for r in got)
    odd = twice.selectExpr("doc_id as `group`", "source as `Path`", "leaf as node", "'r' as ROOT", "1 as `row`", "2 as `_rank`", "3 as `a.b`")
    out = merkle.manifest(odd, leaf_col="node", group_col="Path", order_col="group")
    assert out.columns == [*odd.columns, "subroot", "root_", "path_"]
    assert sorted(r.node for r in out.collect()) == sorted(r.leaf for r in got)
    assert out.filter("`a.b` = 3 and `_rank` = 2 and row = 1 and root = 'r'").count() == 6
    assert merkle.manifest(twice.filter("doc_id > 9")).collect() == []
    null = merkle.manifest(spark.createDataFrame([(1, "a", None)], "doc_id long, source string, leaf string")).first()
    assert (null.leaf, null.root, null.path) == ("", "", [])


def fold(leaf, path):
    for left, right in path:
        leaf = h(left, leaf, right)
    return leaf


def test_query_detects_what_was_changed(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()

    def leaf(d, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d["doc_id"], d["source"], d["lang"], d["n_chars"], text)))

    rows = [(d["doc_id"], d["source"], leaf(d, d["text"])) for d in docs]
    want = {}
    for (r, (subroot, root, path)), d in zip(((r, plain(rows)[r]) for r in rows), docs):
        broken = zlib.crc32(str(d["doc_id"]).encode()) % 2 == 0 and d["text"] is not None
        folded = fold(leaf(d, d["text"].replace("\n", "")) if broken else r[2], path)
        want[d["doc_id"]] = (r[2], subroot, root, h("".join(a + b for a, b in path)), folded, folded == root)
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in QUERIES["op13_merkle_manifest"](spark, SF).collect()}
    assert got == want
    assert len({r[-1] for r in want.values()}) == 2


def test_long_text_and_null_fields(spark):
    df = spark.createDataFrame([(None, None), (1, "é" * 500_000)], "doc_id long, text string")
    got = df.select(merkle.digest(merkle.field(df.doc_id), merkle.field(df.text)).alias("leaf")).collect()
    assert {r.leaf for r in got} == {h("--"), h("1:1", "1000000:" + "é" * 500_000)}
