"""MinHash near-duplicates by a signature-coordinate inverted join.

Method. Every distinct shingle set gets a MinHash signature. A document is posted under
(coordinate, value) pairs; two sets at the similarity threshold agree on at least
``least_matches`` of the coordinates (but for a chance below 1e-4), so by the prefix principle it
is enough to post the ``coordinates - least_matches + 1`` pairs that come first in one fixed order,
and rare pairs come first in it: boilerplate that thousands of documents share is skipped, not merged.
Documents meet through the lists. The agreements of two that meet are counted on sketches (four bits
of each coordinate, never fewer agreements than the signatures have), pairs under the match threshold
are dropped, and what remains is confirmed on the full shingle sets.

Hot lists. Equal sets are one vertex from the start. In a list all members meet the most central one
(largest sum of list lengths) instead of each other; those that pass the match threshold form coarse
families, and members of different families that meet in a list are compared inside the join, which
returns only pairs above the match threshold. A family is then settled exactly: all compare with its
hub; those that link to it are one component and need no pairs among themselves; the rest is compared
in blocks of bounded size, rest with rest and rest with linked, by products of indicator matrices.
No pair rows come out of a block, only one link for each two parts that it joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import components, cut, lean_batches
from critiq.llm.memory import released
from critiq.llm.shingles import U64, mix, set_key, shingle_sets, signature

COORDINATES = 64
CELLS = 1 << 16  # counters of list lengths: a fixed-size statistic, the only thing broadcast
BLOCK = 400_000  # shingles of a block, in the mean
ROWS = 2_000  # rows of a block, in the mean: short texts fill a block by their number
CELL_STRIP = 4_000_000  # counts of a block's product held at a time
NIBBLES = 0x1111111111111111


def least_matches(similarity: float, coordinates: int = COORDINATES) -> int:
    """Agreements that a pair at the threshold falls short of with a chance below 1e-4."""
    mean, deviation = coordinates * similarity, (coordinates * similarity * (1 - similarity)) ** 0.5
    return max(1, int(np.ceil(mean - 4.15 * deviation)))


def shingle_table(docs: DataFrame, width: int, id_col: str, text_col: str, coordinates: int = COORDINATES) -> DataFrame:
    """(id, n, key, sig) of every row: size of the shingle set, key equal for equal sets, signature."""

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for x in shingle_sets(batch.column(1), width):
                n.append(len(x))
                key.append(set_key(x) if len(x) else None)
                sig.append(signature(x, coordinates).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["id", "n", "key", "sig"])

    return lean_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "id long, n long, key binary, sig binary")


def _signatures(column: pa.Array, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as a matrix, and their (coordinate, value) pairs as 64-bit tokens."""
    s = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coordinates)
    return s, mix(s.astype(U64) + (np.arange(coordinates, dtype=U64) << U64(32)))


def _list_lengths(reps: DataFrame, coordinates: int) -> np.ndarray:
    """Postings per cell of a hashed counter table: CELLS numbers, whatever the input."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((_signatures(batch.column(0), coordinates)[1] >> U64(48)).astype(np.int64).ravel(), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "c"])

    got = reps.select("sig").mapInArrow(count, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()  # at most CELLS rows
    out = np.zeros(CELLS, np.int64)
    out[got.column("cell").to_numpy()] = got.column("c").to_numpy()
    return out


def _posted(reps: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """(id, n, pop, s0..s3, tokens): sketch, centrality and the prefix of each representative."""
    lengths = reps.sparkSession.sparkContext.broadcast(_list_lengths(reps, coordinates))
    words = coordinates // 16

    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, tokens = _signatures(batch.column(2), coordinates)
            seen = lengths.value[(tokens >> U64(48)).astype(np.int64)]
            order = np.lexsort((tokens, seen), axis=1)[:, : coordinates - matches + 1]
            low = (s & np.uint32(15)).astype(np.uint8)
            sketch = (low[:, 0::2] << 4 | low[:, 1::2]).view(np.int64)
            prefix = np.take_along_axis(tokens, order, 1).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, prefix.size + 1, prefix.shape[1], dtype=np.int32), pa.array(prefix.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(seen.sum(1)), *(pa.array(sketch[:, k].copy()) for k in range(words)), lists],
                ["id", "n", "pop", *(f"s{k}" for k in range(words)), "tokens"],
            )

    kinds = ", ".join(f"s{k} long" for k in range(words))
    return reps.select("id", "n", "sig").mapInArrow(rows, f"id long, n long, pop long, {kinds}, tokens array<long>")


def _agree(a: str, b: str, words: int, matches: int, similarity_pct: int) -> F.Column:
    """Whether two rows' sketches agree often enough and their sizes allow the similarity."""
    differ = F.lit(0)
    for k in range(words):
        x = F.col(f"{a}.s{k}").bitwiseXOR(F.col(f"{b}.s{k}"))
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        some = some.bitwiseOR(F.shiftrightunsigned(some, 2))
        differ = differ + F.bit_count(some.bitwiseAND(F.lit(NIBBLES)))
    least, most = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (differ <= words * 16 - matches) & (least * 100 >= most * similarity_pct)


def _similar(x: np.ndarray, y: np.ndarray, pct: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= pct * (len(x) + len(y) - both)


def links(docs: DataFrame, reps: DataFrame, width: int, pct: int, id_col: str, text_col: str, coordinates: int = COORDINATES) -> DataFrame:
    """(a, b): confirmed links that join all representatives that links of the full sets join."""
    matches, words = least_matches(pct / 100, coordinates), coordinates // 16
    posted = cut(_posted(reps, coordinates, matches))
    sketches = posted.drop("tokens")
    posts = posted.select("id", "pop", F.explode("tokens").alias("token"))
    hubs = posts.groupBy("token").agg(F.count("*").alias("c"), F.max(F.struct("pop", (-F.col("id")).alias("i"))).alias("h")).filter("c > 1").select("token", (-F.col("h.i")).alias("hub"))
    shared = posts.select("token", "id").join(hubs, "token")
    shared = cut(shared)

    # members with the hub of their list
    met = shared.filter("id != hub").select("id", "hub").distinct()
    a = met.join(sketches.alias("x"), "id").select("hub", F.struct("id", "n", *(f"s{k}" for k in range(words))).alias("x"))
    near = a.join(sketches.select(F.col("id").alias("hub"), F.struct("n", *(f"s{k}" for k in range(words))).alias("y")), "hub")
    near = near.filter(_agree("x", "y", words, matches, pct)).select(F.col("x.id").alias("a"), F.col("hub").alias("b"))
    family = cut(components(near))

    # members of different families that meet in a list: the join's condition keeps near ones only
    here = shared.join(sketches, "id").join(family, "id", "left").withColumn("f", F.coalesce("component", "id"))
    here = here.select("token", "id", "hub", "f", "n", *(f"s{k}" for k in range(words)))
    mixed = here.groupBy("token").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).filter("lo != hi").select("token")
    here = here.join(mixed, "token", "left_semi")
    mains = here.filter("id = hub").select("token", F.col("f").alias("main"))
    off = here.join(mains, "token").filter("f != main")
    across = (
        off.alias("x").join(here.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.f") != F.col("y.f")) & ((F.col("y.f") == F.col("x.main")) | (F.col("x.id") < F.col("y.id"))) & _agree("x", "y", words, matches, pct))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    )
    across = cut(across)

    # what a family holds, shingles and rows, decides whether its hub comes first or one block takes it all
    member = family.join(sketches.select("id", "n", "pop"), "id")
    stats = member.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("rows"), F.max(F.struct("pop", (-F.col("id")).alias("i"))).alias("h"))
    large = cut(stats.filter((F.col("total") > BLOCK) | (F.col("rows") > ROWS)).select("component", (-F.col("h.i")).alias("hub")))

    # full sets of all that met, from their texts
    need = family.unionByName(across.select(F.col("a").alias("id"), F.lit(None).cast("long").alias("component"))).unionByName(across.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("component")))
    need = need.groupBy("id").agg(F.max("component").alias("component")).join(reps.select("id", "key"), "id")
    need = need.join(large.select("component", F.lit(True).alias("large")), "component", "left").select("id", "key", "component", F.coalesce("large", F.lit(False)).alias("large"))

    @released
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = list(shingle_sets(part.column(4), width))
                own = pa.array([set_key(v) == k for v, k in zip(x, part.column(1).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "component", "large", "x"]).filter(own)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    full = texts.join(need, "id").select("id", "key", "component", "large", "text").distinct().mapInArrow(sets, "id long, component long, large boolean, x binary")
    return _settle(cut(full), member, large, across, pct)


def _settle(full: DataFrame, member: DataFrame, large: DataFrame, across: DataFrame, pct: int) -> DataFrame:
    @released
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_similar(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), pct) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        wide = pairs.join(sets.select(F.col("id").alias("a"), "x"), "a").join(sets.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
        return wide.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")

    of_large = full.filter("large")
    star = cut(confirmed(member.join(large, "component").filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")), of_large))

    # in a large family what links to the hub is settled; the rest is compared in blocks with all
    linked = star.select(F.col("a").alias("id")).unionByName(large.select(F.col("hub").alias("id"))).withColumn("settled", F.lit(True))
    pools = member.join(large, "component").join(linked, "id", "left").select("id", "component", "n", F.coalesce("settled", F.lit(False)).alias("settled"))
    blocks = lambda own: F.ceil(F.greatest(F.sum(F.when(own, F.col("n"))) / BLOCK, F.count(F.when(own, 1)) / ROWS))
    sizes = pools.groupBy("component").agg(blocks(~F.col("settled")).alias("rest"), blocks(F.col("settled")).alias("done")).filter("rest > 0").fillna(0, ["done"])
    dealt = pools.join(sizes, "component").withColumn("block", F.when(F.col("settled"), F.col("rest") + F.expr("pmod(xxhash64(id), done)")).otherwise(F.expr("pmod(xxhash64(id), rest)")))
    partners = F.when(F.col("settled"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("done") - 1))
    cells = dealt.select("id", "component", "block", F.explode(partners).alias("other"))
    cells = cells.select("id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"))

    def block(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        x = [np.frombuffer(v, np.int64) for v in t.column("x").to_pylist()]
        first = ~t.column("second").to_numpy()
        a, b = (np.flatnonzero(first), np.flatnonzero(~first)) if t.column("i")[0].as_py() != t.column("j")[0].as_py() else (np.arange(len(ids)),) * 2
        found = joined(ids, x, a, b, pct)
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    # a family that one block holds needs no dealing
    whole = full.filter("component is not null and not large").select("id", "component", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(False).alias("second"), "x")
    parts = cells.join(of_large.select("id", "x"), "id").select(whole.columns)
    inside = whole.unionByName(parts).groupBy("component", "i", "j").applyInArrow(block, "a long, b long")
    return star.unionByName(confirmed(across, full)).unionByName(inside)


def joined(ids: np.ndarray, x: list[np.ndarray], a: np.ndarray, b: np.ndarray, pct: int) -> list[tuple[int, int]]:
    """Links between rows a and rows b of a block that join parts not joined before (a spanning forest)."""
    if not len(a) or not len(b) or len(ids) < 2:
        return []
    sizes = np.array([len(v) for v in x])
    flat, owner = np.concatenate(x), np.repeat(np.arange(len(x)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(new) - 1
    twice = np.bincount(column) > 1  # a shingle of one member alone adds to no intersection
    keep = twice[column]
    column, owner = (np.cumsum(twice) - 1)[column[keep]], owner[keep]
    place_b = np.full(len(x), -1)
    place_b[b] = np.arange(len(b))
    width = max(256, 8_000_000 // len(x))
    bounds = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    part = np.arange(len(x))  # of each row; the product is scanned in strips of rows a, row by row
    out = []
    step = max(1, CELL_STRIP // len(b))
    for start in range(0, len(a), step):
        strip = a[start : start + step]
        place_a = np.full(len(x), -1)
        place_a[strip] = np.arange(len(strip))
        both = np.zeros((len(strip), len(b)), np.float32)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            o = owner[lo:hi]
            in_a, in_b = place_a[o] >= 0, place_b[o] >= 0
            if not in_a.any() or not in_b.any():
                continue
            c = column[lo:hi] - column[lo] // width * width
            ma, mb = np.zeros((len(strip), width), np.float32), np.zeros((len(b), width), np.float32)
            ma[place_a[o][in_a], c[in_a]] = 1
            mb[place_b[o][in_b], c[in_b]] = 1
            both += ma @ mb.T
        for i, counts in zip(strip, both):
            near = b[(100 + pct) * counts.astype(np.float64) >= pct * (sizes[i] + sizes[b])]
            near = near[part[near] != part[i]]
            if len(near):
                met, first = np.unique(part[near], return_index=True)
                out += [(int(ids[i]), int(ids[j])) for j in near[first]]
                part[np.isin(part, met)] = part[i]
    return out


def minhash_groups(docs: DataFrame, width: int = 5, similarity_pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every id of docs.

    Words are runs of other bytes than space and 0x09-0x0D, A-Z lower-cased; a document's set holds
    its distinct shingles of ``width`` words, with fewer words the whole sequence as one. Two
    documents link when 100 * intersection >= similarity_pct * union; component_id is the least id
    reachable. Null, empty and blank texts have 0 shingles and link with nothing. Rows that repeat an
    id are one document; if their texts differ, the text with the smallest set key stands for it.
    Rows without an id are left out. An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    rows = cut(shingle_table(docs, width, id_col, text_col).filter("id is not null").withColumn("k", F.xxhash64(F.coalesce("key", F.lit(b"")))))
    chosen = rows.groupBy("id").agg(F.min("k").alias("k"), F.count("*").alias("copies"))
    repeated = chosen.filter("copies > 1").select("id", "k")
    rows = rows.join(repeated.select("id", F.col("k").alias("k0")), "id", "left").filter("k0 is null or k = k0")
    usable = rows.filter("key is not null")
    classes = usable.groupBy("key").agg(F.min("id").alias("rep"))
    mapped = cut(rows.select("id", "n", "key").join(classes, "key", "left").select("id", "n", "rep").distinct())
    reps = rows.join(mapped.filter("id = rep").select("id"), "id", "left_semi").select("id", "n", "key", "sig").dropDuplicates(["id"])
    group = components(links(docs, cut(reps), width, similarity_pct, id_col, text_col))
    out = mapped.join(group.select(F.col("id").alias("rep"), "component"), "rep", "left")
    own = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), (F.col("id") == own).alias("kept"))
