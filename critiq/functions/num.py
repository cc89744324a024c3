"""Numeric helpers shared by every operator.

Rounding: one rule everywhere, ``floor(x * 10^n + 0.5) / 10^n`` in double
arithmetic.  Spark's ``round`` is half-up on decimals, numpy's is half-even
and DuckDB differs again on values such as 1.005; the explicit form gives
the same bits in Spark and in the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rnd(c: Column | str, n: int) -> Column:
    """Round half up to ``n`` decimals in double arithmetic (null-safe)."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** n)
    return (F.floor(c.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def sql_rnd(expr: str, n: int) -> str:
    """The same rounding rule as SQL text (for the DuckDB oracle)."""
    return f"(floor(({expr}) * 1e{n} + 0.5) / 1e{n})"


def to_double(c: Column | str) -> Column:
    """Lenient numeric coercion: bad text, NaN and infinities become null."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(d)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi] keeping nulls null (least/greatest skip nulls)."""
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def safe_div(a: Column, b: Column) -> Column:
    """Division that yields null instead of raising on zero (ANSI mode)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    ``scalars`` must be a global aggregate (exactly one row).  It becomes one
    uncorrelated scalar subquery (all its columns packed in a struct): Spark
    runs it once and folds the result into the projection, so there is no
    join at all and nothing grows with the data.
    """
    cols = scalars.columns
    packed = scalars.select(F.struct(*cols).alias("_scalars")).scalar()
    out = df.withColumn("_scalars", packed)
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[F.col("_scalars")[c].alias(c) for c in cols])


def min_max_scale(c: Column, lo: Column, hi: Column) -> Column:
    """(x - min) / (max - min + 1e-9), the small-epsilon min-max rule."""
    return (c - lo) / (hi - lo + F.lit(1e-9))


SCALE = 1024     # logarithmic buckets for each doubling of a value
ZOOM = 1 << 21   # equal-width buckets of the second look


def _magnitude(x: Column) -> Column:
    """A bucket number that grows with x: its sign and 1024 steps per doubling
    of |x|, so no outlier can put the other values into one bucket.  There are
    about 4.4 million such numbers for all doubles."""
    steps = F.floor((F.log2(F.abs(x)) + F.lit(1100.0)) * F.lit(float(SCALE))).cast("long") + 1
    return F.when(x > 0, steps).when(x < 0, -steps).otherwise(F.lit(0).cast("long"))


def _holding(buckets: DataFrame, group: list[str], order: str, targets: Column) -> DataFrame:
    """(i, rank, lo, hi): for each of ``targets`` (an array of struct(i, rank, ...))
    the bucket that holds its rank, and the rank inside it."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    c = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    before, upto = F.col("_before"), F.col("_before") + F.col("_n")
    mine = F.filter(targets, lambda t: (t["rank"] >= before) & (t["rank"] < upto))
    return c.select(F.explode(mine).alias("_t"), "_before", "_lo", "_hi").select(
        F.col("_t.i").alias("i"), (F.col("_t.rank") - F.col("_before")).alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"))


def exact_quantiles(df: DataFrame, col: str, probs: list[float], name: str, zoom: int = ZOOM) -> DataFrame:
    """One row with the array ``name`` of exact, linearly interpolated quantiles.

    ``percentile`` gathers all distinct values in one buffer.  Here the
    distinct values are counted, and only the buckets that hold a wanted rank
    are looked into: first by sign and magnitude (1024 buckets per doubling),
    then by equal width between the extremes of that bucket, which leaves at
    most some 1.5 million doubles to a bucket, whatever the data.  Each look is
    an aggregate that merges before its shuffle; windows run over bucket totals,
    and in the end over the distinct values of one bucket.  Whatever is left of
    ``targets`` between the looks is two rows for each quantile.
    """
    x = F.col(col).cast("double")
    v = shared(df.select((x + F.lit(0.0)).alias("_x")).where(F.col("_x").isNotNull()).groupBy("_x").agg(F.count(F.lit(1)).alias("_n")))

    def brackets(stats: DataFrame) -> DataFrame:
        """One row: the targets as an array, and the distinct ranges they lie in."""
        t = F.struct("i", "rank", "lo", "hi")
        return stats.agg(F.collect_list(t).alias("_targets"), F.collect_set(F.struct("lo", "hi")).alias("_ranges"))

    def inside(stats: DataFrame) -> DataFrame:
        """The distinct values within the ranges, each beside its range and the targets there."""
        d = with_scalars(v, brackets(stats))
        d = d.select("_x", "_n", "_targets", F.explode(F.filter("_ranges", lambda r: F.col("_x").between(r["lo"], r["hi"]))).alias("_r"))
        mine = F.filter("_targets", lambda t: (t["lo"] == F.col("_r.lo")) & (t["hi"] == F.col("_r.hi")))
        return d.select("_x", "_n", F.col("_r.lo").alias("_from"), F.col("_r.hi").alias("_to"), mine.alias("_mine"))

    ends = F.min("_x").alias("_lo"), F.max("_x").alias("_hi")
    at = [F.lit(float(p)) * (F.col("_total") - 1) for p in probs]
    total = v.agg(F.sum("_n").alias("_total"))
    ranks = total.select("_total", F.array(*[F.struct(F.lit(k).alias("i"), f(a).cast("long").alias("rank"))
                                             for k, (f, a) in enumerate((f, a) for a in at for f in (F.floor, F.ceil))]).alias("_targets"))
    first = with_scalars(v.groupBy(_magnitude(F.col("_x")).alias("_b")).agg(F.sum("_n").alias("_n"), *ends), ranks.select("_targets"))
    stats = _holding(first, [], "_b", F.col("_targets"))
    share = F.try_divide(F.col("_x") - F.col("_from"), F.col("_to") - F.col("_from"))
    second = inside(stats).withColumn("_b", F.coalesce(F.floor(share * F.lit(float(zoom - 1))), F.lit(0)))
    second = second.groupBy("_from", "_to", "_mine", "_b").agg(F.sum("_n").alias("_n"), *ends)
    stats = _holding(second, ["_from", "_to"], "_b", F.col("_mine"))
    last = inside(stats).select("*", F.col("_x").alias("_lo"), F.col("_x").alias("_hi"))
    found = _holding(last, ["_from", "_to"], "_x", F.col("_mine"))
    values = found.agg(*[F.max(F.when(F.col("i") == k, F.col("lo"))).alias(f"_v{k}") for k in range(2 * len(probs))])
    one = with_scalars(values, total)
    pick = []
    for k, a in enumerate(at):
        lower, upper = F.col(f"_v{2 * k}"), F.col(f"_v{2 * k + 1}")
        pick.append(F.when(lower == upper, lower).otherwise((F.ceil(a) - a) * lower + (a - F.floor(a)) * upper))
    return one.select(F.array(*pick).alias(name))


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def sharing() -> Iterator[list[DataFrame]]:
    """Collects the tables that ``shared`` persists inside the block and
    unpersists them, and no others, at its end.  The list is the caller's to
    look at, or to empty where the tables shall stay."""
    tables: list[DataFrame] = []
    _SCOPES.append(tables)
    try:
        yield tables
    finally:
        _SCOPES.remove(tables)
        for t in tables:
            t.unpersist()


def shared(df: DataFrame) -> DataFrame:
    """Mark an *aggregated* table that several branches of one plan read
    (the main result and its scalar subqueries): persisted, so the scan,
    joins and aggregation beneath it run once.  Only used on tables with one
    row per shop, user, city, month or similar; lost blocks are recomputed
    from lineage.  Inside ``sharing()`` it is dropped at the end of the block;
    elsewhere the caller's ``spark.catalog.clearCache()`` drops it.

    ``get_session`` sets ``CACHED_AQE_FLAG``; without it a cached plan runs
    without adaptive execution.
    """
    from pyspark import StorageLevel
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if _SCOPES:
        _SCOPES[-1].append(df)
    return df


CACHED_AQE_FLAG = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
