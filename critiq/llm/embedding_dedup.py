"""Embedding near-duplicates by a PCA-ordered tiled comparison.

Unit vectors are rotated to the principal axes of all vectors (a covariance summed over all rows, one
small matrix), so that the leading dimensions hold most of every inner product. Equal vectors are one
from the start. The distinct vectors are dealt into blocks, and every two blocks meet in one tile, which
accumulates the product of the leading dimensions, bounds what the rest can add by the product of the
suffix norms (Cauchy-Schwarz), and goes on only with the pairs whose cosine can still reach the
threshold. Survivors are confirmed in double precision on the vectors themselves. A tile returns a link
count for each vector and links that join its parts, no list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import components, cut

BLOCK = 6000  # vectors of a block, in the mean
STRIP = 128  # rows of a tile compared at once
STEPS = (12, 24, 40)  # leading dimensions after which hopeless pairs are dropped
PAIRS = 1 << 14  # pairs compared at once
SLACK = 1e-6  # over the rounding of float sums; the confirmation is exact


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, valid): the vector in double precision as bytes; valid: not null, not zero, all components finite."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, v in enumerate(batch.column(1)):
                x = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                ok = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
                out.append((x + 0.0).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x")).filter("id is not null").mapInArrow(rows, "id long, v binary")


def _norm(x: np.ndarray) -> np.ndarray:
    """Unit rows; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def principal_axes(reps: DataFrame, dim: int) -> np.ndarray:
    """Axes by falling variance, from sums of x x' over all rows (one dim x dim matrix per task)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _norm(_matrix(batch.column(0)))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    parts = reps.select("v").mapInArrow(sums, "i long, row array<double>")
    added = parts.select("i", F.posexplode("row").alias("j", "s")).groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()  # dim * dim rows
    c = np.zeros((dim, dim))
    c[added.column("i").to_numpy(), added.column("j").to_numpy()] = added.column("s").to_numpy()
    return np.linalg.eigh(c)[1][:, ::-1]


def near_in_tile(x: np.ndarray, y: np.ndarray, threshold: float, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and y (rotated unit vectors) whose product reaches the threshold, but for SLACK."""
    dim = x.shape[1]
    cuts = [0, *(s for s in steps if s < dim), dim]
    tail = lambda a, k: np.sqrt(np.maximum((a[:, k:] ** 2).sum(1), 0)).astype(np.float32)
    at = cuts[1]
    lead = x[:, :at].astype(np.float32) @ y[:, :at].astype(np.float32).T
    lead += tail(x, at)[:, None] * tail(y, at)[None]
    hopeful = np.nonzero(lead >= threshold - 10 * SLACK)
    tails = {k: (tail(x, k), tail(y, k)) for k in cuts[2:]}
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2]
    for k in range(0, len(hopeful[0]), PAIRS):
        i, j = (v[k : k + PAIRS] for v in hopeful)
        dot = np.einsum("ij,ij->i", x[i, :at], y[j, :at])
        for a, b in zip(cuts[1:], cuts[2:]):
            dot += np.einsum("ij,ij->i", x[i, a:b], y[j, a:b])
            keep = dot + tails[b][0][i] * tails[b][1][j] >= threshold - SLACK
            i, j, dot = i[keep], j[keep], dot[keep]
        kept.append((i, j))
    i, j = zip(*kept)
    return np.concatenate(i), np.concatenate(j)


def tile_links(x: np.ndarray, copies: np.ndarray, axes: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links, u, v): for each row of x the copies of the rows it links to, and links u - v that join parts not joined before.

    a, b: the rows of the tile's two blocks, the same ones if ``same``. Links are counted and parts joined strip by
    strip: the pairs of STRIP rows are the most that is held, however many vectors are near each other.
    """
    turned = _norm(x) @ axes
    links, part = np.zeros(len(x)), np.arange(len(x))
    u: list[int] = []
    v: list[int] = []
    for at in range(0, len(a), STRIP):
        strip = a[at : at + STRIP]
        i, j = near_in_tile(turned[strip], turned[b], threshold)
        p, q = strip[i], b[j]
        if same:
            p, q = p[p < q], q[p < q]
        exact = cosines(x, p, q) >= threshold
        p, q = p[exact], q[exact]
        links += np.bincount(p, copies[q], len(x)) + np.bincount(q, copies[p], len(x))
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        firsts = np.flatnonzero(np.diff(p, prepend=-1))
        for first, last in zip(firsts.tolist(), [*firsts[1:].tolist(), len(p)]):
            row, near = int(p[first]), q[first:last]
            near = near[part[near] != part[row]]
            if len(near):
                met, one = np.unique(part[near], return_index=True)
                u += [row] * len(one)
                v += near[one].tolist()
                part[np.isin(part, met)] = part[row]
    return links.astype(np.int64), np.array(u, np.int64), np.array(v, np.int64)


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) for every id of vectors.

    Two vectors link if their cosine in double precision is at least ``threshold``; n_links counts the
    other vectors linked directly, equal ones included, and component_id is the least id reachable.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
    vectors of different lengths don't link. Rows that repeat an id are one vector: the one that is
    least as bytes counts. Rows without an id are left out. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    rows = unit_vectors(vectors, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    rows = cut(rows)
    # equal vectors, by a scale-free key, are one vertex
    usable = rows.filter("v is not null")
    classes = usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = cut(classes.select("rep", "copies", "v", F.length("v").alias("bytes")))
    mapped = rows.join(classes.select("v", "rep", "copies"), "v", "left").select("id", "rep", "copies")

    counts, edges = [], []
    for size, n in sorted((r["bytes"], r["n"]) for r in classes.groupBy("bytes").agg(F.count("*").alias("n")).collect()):  # a row for each vector length
        found = cut(_tiles(classes.filter(F.col("bytes") == size).drop("bytes"), int(n), size // 8, threshold))
        counts.append(found.filter("other is null").select("id", "links"))
        edges.append(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    empty = rows.sparkSession.createDataFrame([], "id long, links long, a long, b long")
    linked, joined = empty.select("id", "links"), empty.select("a", "b")
    for c, e in zip(counts, edges):
        linked, joined = linked.unionByName(c), joined.unionByName(e)
    linked = linked.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")
    group = components(joined).select(F.col("id").alias("rep"), "component")
    out = mapped.join(linked, "rep", "left").join(group, "rep", "left")
    own = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"), own.alias("component_id"), (F.col("id") == own).alias("kept"))


def _tiles(classes: DataFrame, n: int, dim: int, threshold: float) -> DataFrame:
    """(id, links, other): with other null, copies of the vectors linked to id in a tile; else a link that joins parts."""
    axes = classes.sparkSession.sparkContext.broadcast(principal_axes(classes, dim))
    blocks = max(1, -(-n // BLOCK))
    dealt = classes.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    cells = dealt.select("rep", "copies", "v", "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    cells = cells.select(F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), (F.col("block") > F.col("o")).alias("second"), "rep", "copies", "v")

    def tile(t: pa.Table) -> pa.Table:
        ids, copies, second = t.column("rep").to_numpy(), t.column("copies").to_numpy(), t.column("second").to_numpy()
        same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        a, b = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        links, u, v = tile_links(_matrix(t.column("v")), copies, axes.value, a, b, same, threshold)
        some = np.flatnonzero(links)
        return pa.table({
            "id": pa.array(np.concatenate((ids[some], ids[u])), pa.int64()),
            "links": pa.array(np.concatenate((links[some], np.zeros(len(u), np.int64)))),
            "other": pa.array([None] * len(some) + ids[v].tolist(), pa.int64()),
        })

    return cells.groupBy("i", "j").applyInArrow(tile, "id long, links long, other long")


def cosines(x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.empty(len(p))
    for at in range(0, len(p), PAIRS):
        a, b = x[p[at : at + PAIRS]], x[q[at : at + PAIRS]]
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
        out[at : at + len(a)] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    return out
