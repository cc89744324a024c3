"""Mixing sources to target weights.

The sizes of the documents are summed for each source, targets follow from the sources' weights, and the
ratio of target to size is the source's repetition rate. A document is emitted floor(rate) times, and once
more if a draw seeded by its hash falls below the rate's fraction; so a source's expected size in the mix is
its target, and a rerun emits the same copies. The documents themselves are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import cut, few, free_name, ranked

WORD = r"[^\x20\x09-\x0D]+"
DRAWS = float(1 << 52)  # 13 hexadecimal digits: a double holds them exactly


def words(text: Column) -> Column:
    """Number of words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sizes: DataFrame, weights: list[float]) -> DataFrame:
    """sizes (source, source_size) with the column weight: by the sources' rank in code points, null last, over and over."""
    order = ranked(sizes.withColumn("_all", F.lit(0)), "_all", [F.col("source").asc_nulls_last()])
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return order.select("source", "source_size", F.get(cycle, F.pmod("_rank", F.lit(len(weights))).cast("int")).alias("weight"))


def targets(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """sizes (source, source_size, weight) with the column target.

    share x all sizes are dealt by weight; no target exceeds cap x its source's size, and what a source cannot take
    is dealt again by weight to the others, until none is above. Every round is an aggregate over the sources that
    returns a count and two sums; the level (target for a weight of 1) rises from round to round. If the caps
    together are less than the share, every target is its cap. Null or negative weights count as 0, and a source
    without weight or without size has the target 0.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    sizes = cut(sizes.select("source", "source_size", weight.alias("weight"), (F.lit(float(cap)) * F.col("source_size")).alias("_cap")))
    total = share * (sizes.agg(F.sum("source_size")).first()[0] or 0)
    level, known = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("weight")
        n, taken, left = sizes.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == known:
            break
        known = n
        level = (total - (taken or 0.0)) / left if left else math.inf
    if math.isinf(level):  # nobody is left to take more
        target = F.when(F.col("weight") > 0, F.col("_cap")).otherwise(F.lit(0.0))
    else:
        target = F.least(F.col("_cap"), F.lit(level) * F.col("weight"))
    return sizes.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: list[float] | DataFrame, share: float = 1.0, cap: float = 4.0, seed: str = "0", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", out_col: str = "mix") -> DataFrame:
    """docs, and the struct ``out_col`` (size, source_size, target, copies) as their last column; ``emit`` makes the copies.

    weights: a list, dealt to the sources in code-point order (null last) over and over, or a table (source,
    weight). share, cap: see ``targets``. size: the text's words; null, empty and blank texts have the size 0, their
    copies follow the same rule. Null sources are a source of their own. copies: floor(rate), plus 1 if the draw of
    (seed, id, text) is below the fraction; rate = target / source_size, 0 for a source of size 0. Rows that repeat
    both id and text share a draw; null ids are told apart by their texts. An empty table gives an empty result.
    Every other column is kept; if docs has a column ``out_col`` already, the new one gets underscores.

    The one shuffle before the result holds a row for each source and task. The sources are broadcast if they are
    few, else joined, and adaptive execution splits a source with very many documents.
    """
    name = free_name(docs, out_col)
    size = words(F.col(text_col))
    sizes = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_size")))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_given"), "weight")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("_given")), "left").select("source", "source_size", "weight")
    else:
        weighed = cycle_weights(sizes, weights)
    key, goal = free_name(docs, "_source"), free_name(docs, "_goal")
    goals = targets(weighed, share, cap).select(F.col("source").alias(key), F.struct("source_size", "target").alias(goal))
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    draw = F.conv(F.substring(draw, 1, 13), 16, 10).cast("double") / F.lit(DRAWS)
    rate = F.coalesce(F.try_divide(F.col(goal)["target"], F.col(goal)["source_size"].cast("double")), F.lit(0.0))
    copies = F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)
    joined = docs.join(few(goals, key), F.col(source_col).eqNullSafe(F.col(key)))
    both = F.struct(size.alias("size"), F.col(goal)["source_size"].alias("source_size"), F.col(goal)["target"].alias("target"), copies.cast("long").alias("copies"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], both.alias(name))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` without its column, each as often as its copies say; a further column ``copy`` (with
    underscores if taken) counts a document's copies from 0."""
    mark = mixed.columns[-1]
    own = [F.col(f"`{c}`") for c in mixed.columns[:-1]]
    name = free_name(mixed.drop(mark), "copy")
    taken = mixed.filter(F.col(mark)["copies"] > 0)
    return taken.select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(mark)["copies"] - 1)).alias(name))
