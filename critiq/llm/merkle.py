"""Merkle manifest of a dataset: a tree over each group's rows, and one over the groups.

A leaf is the digest of a row. In a group the leaves stand by their order column, and every ``arity`` consecutive
nodes (the last run: as many as are left) become their digest until one node, the subroot, remains; the
subroots, by group, become the root in the same way.

The position of a node among its group's is written in digits of base ``arity``. DIGITS digits make a block.
Within blocks the digit columns are grouped away one after another, the last one first: a group-by on the
digits that remain makes a parent of the nodes that differ in this digit alone, and nests them in it as an array
of structs. All these group-bys need the rows by (group, block), so they share one shuffle. Then a block is one row that
holds its part of the tree, arity ** DIGITS leaves at most, and the blocks of all groups are the leaves of the
next tier. Once the tiers above have told a block the siblings on its way up, nested transforms walk down
its structs and an explode emits its leaves with their proofs. Blocks get these siblings by a union and a
group-by on the block: no tier joins anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import cut, ranked

DIGITS = 5  # 243 leaves of base 3 in a block
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after another, as UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """A value as part of a leaf: '-' if null, else the number of its UTF-8 bytes, ':' and the value as text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda at, step: digest(step["left"], at, step["right"]))


def siblings(path: Column) -> Column:
    """Every sibling of ``path`` in one string: level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def _side(nodes: Column, keep) -> Column:
    return F.array_join(F.transform(F.filter(nodes, keep), lambda n: n["node"]), "")


def _rollup(nodes: DataFrame, arity: int) -> DataFrame:
    """(group, block, height, node, kids): one row per block. nodes: (group, rank, height, node, row), where height is the
    number of levels left to climb in the group; a level above it passes its only node on."""
    width = arity**DIGITS
    digits = [f"d{k}" for k in range(DIGITS)]
    place = [F.floor(F.pmod(F.col("rank"), F.lit(width)) / F.lit(arity**k)) % arity for k in range(DIGITS)]
    block = F.floor(F.col("rank") / F.lit(width)).cast("long")
    at = nodes.select("group", block.alias("block"), "height", "node", F.col("row").alias("kids"), *[p.cast("int").alias(d) for p, d in zip(place, digits)])
    at = at.repartition("group", "block")  # serves every group-by below
    for level, digit in enumerate(digits):
        rest = digits[level + 1 :]
        kids = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), "node", "kids")))
        at = at.groupBy("group", "block", "height", *rest).agg(kids.alias("kids"))
        joined = F.array_join(F.transform("kids", lambda n: n["node"]), "")
        at = at.select("group", "block", "height", F.when(F.col("height") > level, digest(joined)).otherwise(F.col("kids")[0]["node"]).alias("node"), "kids", *rest)
    return at


def _unroll(blocks: DataFrame) -> DataFrame:
    """(group, node, row, tops, path) for every leaf of the blocks (group, height, kids, tops, path); path: first the block's, then the leaf's."""

    def leaves(kids: Column, path: Column, level: int) -> Column:
        def below(kid: Column) -> Column:
            left, right = _side(kids, lambda n: n["digit"] < kid["digit"]), _side(kids, lambda n: n["digit"] > kid["digit"])
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            own = F.when(F.col("height") > level, F.concat(step, path)).otherwise(path)
            if level:
                return leaves(kid["kids"], own, level - 1)
            return F.array(F.struct(kid["node"].alias("node"), kid["kids"].alias("row"), own.alias("path")))

        return F.flatten(F.transform(kids, below))

    return blocks.select("group", "tops", F.explode(leaves(F.col("kids"), F.col("path"), DIGITS - 1)).alias("leaf")).select("group", "tops", "leaf.*")


def _climb(nodes: DataFrame, arity: int, tallest: int, crown: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """(group, node, row, tops, path) for every one of ``nodes`` (group, rank, height, node, row).

    tallest: the greatest height. crown: from the groups' last nodes (group, block, node), what stands above each as
    (group, block, tops, path); None: nothing does, tops is the last node and path empty.
    """
    blocks = cut(_rollup(nodes, arity))
    if tallest > DIGITS:
        tier = blocks.select("group", F.col("block").alias("rank"), F.greatest(F.col("height") - DIGITS, F.lit(0)).alias("height"), "node", F.struct("block").alias("row"))
        upper = _climb(tier, arity, tallest - DIGITS, crown).select("group", "row.block", "tops", "path")
    elif crown:
        upper = crown(blocks.select("group", "block", "node"))
    else:
        return _unroll(blocks.select("group", "height", "kids", F.struct("node").alias("tops"), F.array().cast(STEP).alias("path")))
    return _unroll(_meet(blocks.drop("node"), upper))


def _meet(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """Each block with what stands above it: a union and a group-by on (group, block), of two rows each."""

    def with_nulls(df: DataFrame, other: DataFrame) -> DataFrame:
        return df.select(*df.columns, *[F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns if c not in df.columns])

    both = with_nulls(blocks, upper).unionByName(with_nulls(upper, blocks))
    return both.groupBy("group", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns if c not in ("group", "block")])


def _height(rows: Column, arity: int) -> Column:
    """Levels above ``rows`` leaves: the least k with arity ** k >= rows."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= arity
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < rows))


def _tree(rows: DataFrame, order: list[Column], arity: int, crown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(group, node, row, tops, path) for ``rows`` (group, node, row); see ``_climb``."""
    nodes = ranked(rows, "group", order).withColumn("height", _height(F.col("_rows"), arity))
    tallest = nodes.agg(F.max("height")).first()[0] or 0
    return _climb(nodes.select("group", F.col("_rank").alias("rank"), "height", "node", "row"), arity, tallest, crown)


def manifest(leaves: DataFrame, leaf_col: str = "leaf", group_col: str = "source", order_col: str = "doc_id", arity: int = 3) -> DataFrame:
    """Every row of ``leaves`` with the new columns subroot, root and path (underscores appended where leaves has such a
    column): path holds, from the leaf up to the root, the concatenated digests of the siblings to its left and to its
    right in each level's run, empty strings where there are none.

    A null group is a group of its own and stands first; groups are ordered by UTF-8 bytes, rows of a group by order_col,
    null first, then by leaf. Rows that repeat all columns are leaves of their own and alike. A null leaf counts as
    an empty string. A lone leaf is its group's subroot, the subroot of an only group is the root, and its path is
    then empty. An empty table gives an empty result. No group meets in one task: positions come from a range
    partition (``ranked``), and a block holds arity ** DIGITS rows. Shuffled and written are digests and the other
    columns of ``leaves``, so leave texts out of it.
    """
    names: list[str] = []
    for new in ("subroot", "root", "path"):
        while new.lower() in {c.lower() for c in [*leaves.columns, *names]}:
            new += "_"
        names.append(new)
    others = [c for c in leaves.columns if c != leaf_col]
    group, order = F.col(f"`{group_col}`"), F.col(f"`{order_col}`")
    rows = leaves.select(group.alias("group"), F.coalesce(F.col(f"`{leaf_col}`"), F.lit("")).alias("node"), F.struct(order.alias("by"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("row"))

    def crown(tops: DataFrame) -> DataFrame:
        """The tree over the groups: all of them are one group there."""
        subroots = cut(tops.select(F.lit(0).alias("group"), "node", F.struct("group", "block").alias("row")))
        tree = _tree(subroots, [F.col("row.group").asc_nulls_first()], arity)
        return tree.select("row.group", "row.block", F.struct(F.col("node").alias("subroot"), F.col("tops.node").alias("root")).alias("tops"), "path")

    tree = _tree(cut(rows), [F.col("row.by").asc_nulls_first(), F.col("node")], arity, crown)
    own = {c: F.col(f"row.c{k}") for k, c in enumerate(others)} | {leaf_col: F.col("node")}
    return tree.select(*[own[c].alias(c) for c in leaves.columns], F.col("tops.subroot").alias(names[0]), F.col("tops.root").alias(names[1]), F.col("path").alias(names[2]))
