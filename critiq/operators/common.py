"""Plan-shape helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critiq.functions.num import with_scalars


def has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def dense_rank_desc(df: DataFrame, score: str, rank: str) -> DataFrame:
    """Dense rank of ``score`` (descending) without a global window over ``df``.

    A window over all shops would pull every row into one task.  Instead the
    distinct score values are ranked (they are rounded: 4,001 values for 3
    decimals in [1, 5]) and joined back; the engine broadcasts them when they
    are as few as that.
    """
    vals = df.select(score).where(F.col(score).isNotNull()).distinct()
    ranked = vals.select(score, F.dense_rank().over(Window.orderBy(F.col(score).desc())).alias(rank))
    return df.join(ranked, score, "left").select(*df.columns, F.col(rank).cast("int").alias(rank))


BEFORE_ALL = -(1 << 63)


def time_number(df: DataFrame) -> Column:
    """review_time in microseconds, as a number that a hash aggregate can hold; null comes before all times."""
    if "review_time" not in df.columns:
        return F.lit(BEFORE_ALL)
    t = F.col("review_time")
    seconds = F.unix_seconds(t.cast("timestamp")) if df.schema["review_time"].dataType.typeName() == "date" else None
    micros = seconds * 1_000_000 if seconds is not None else F.unix_micros(t.cast("timestamp"))
    return F.coalesce(micros, F.lit(BEFORE_ALL))


def grouped_with_first(df: DataFrame, keys: list[str], firsts: list[str], sums: dict[str, Column]) -> DataFrame:
    """(keys..., firsts..., sums...) with one row per ``keys``: sums added up, and
    for each of ``firsts`` the non-null value of the earliest row (pandas
    ``first`` made deterministic: among values of the same time the least).

    Two steps.  Rows are summed per (keys, firsts) with the earliest time as a
    number: all buffers are numbers, so this is a hash aggregate that merges
    before the shuffle.  The values are picked from its result, which has a row
    for each different combination of them.
    """
    firsts = [c for c in firsts if c in df.columns and c not in keys]
    d = df.select(*keys, *firsts, *[c.alias(n) for n, c in sums.items()], time_number(df).alias("_time"))
    combos = d.groupBy(*keys, *firsts).agg(*[F.sum(n).alias(n) for n in sums], F.min("_time").alias("_time"))
    pick = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col("_time").alias("t"), F.col(c).alias("v")))).alias(c) for c in firsts]
    return combos.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums], *pick)


def first_by_review(x: str, df: DataFrame) -> Column:
    """pandas ``first`` made deterministic: the non-null value of ``x`` of the
    earliest review; of reviews at the same time the one with the least id
    (null before all), then the least value.  Merged before the shuffle, so a
    group costs one partial row per task."""
    rid = F.col("review_id") if "review_id" in df.columns else F.lit(None).cast("string")
    key = F.struct(time_number(df).alias("t"), rid.alias("i"), F.col(x).alias("v"))
    return F.min_by(x, F.when(F.col(x).isNotNull(), key))


def is_neg(label: Column) -> Column:
    """(label == -1) with a null label counted as 'not negative'."""
    return F.when(label.try_cast("double") == -1, F.lit(1)).otherwise(F.lit(0))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    salt_col: str | None = None, salt_buckets: int = 64) -> DataFrame:
    """Exact top-k rows per group, safe against one huge group.

    Stage 1 ranks inside (group, hash(salt_col) % buckets) so a hot group is
    spread over many tasks; only the k best of each bucket survive.  The
    global top k of a group is always among those survivors, so stage 2 (a
    window over at most buckets * k rows per group) gives the exact answer.
    """
    if salt_col is not None:
        b = F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salt_buckets))
        w1 = Window.partitionBy(*group, b).orderBy(*order)
        df = df.withColumn("_rn1", F.row_number().over(w1)).where(F.col("_rn1") <= k).drop("_rn1")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w2)).where(F.col("_rn") <= k).drop("_rn")


def hash_cuts(df: DataFrame, id_col: str, ranks: list[Column]) -> DataFrame:
    """One row with the array ``cuts``: for each of ``ranks`` (columns over ``_n``,
    the number of rows) the (hash, id) that is last among so many rows in the
    order of (md5 of the id, id); null for a rank below 1.

    Order statistics without sorting.  Rows are counted by the first 16 bits
    of the hash, then, in the bucket that holds a rank, by the next 16, and only
    the ids that share these 32 bits are put in order: 65,536 counts or some
    ids meet in a window, never the rows.  A rank above ``_n`` gives the last row.
    """
    key = hash_key(id_col)
    rows = df.select(key.alias("_key"))
    bits = F.conv(F.substring(F.col("_key.h"), 1, 8), 16, 10).cast("long")
    rows = rows.select("_key", bits.alias("_x"), F.shiftright(bits, 16).alias("_b"))

    def holding(counts: DataFrame, order: str) -> DataFrame:
        """One row: for each target the value of ``order`` that holds it, with the rest of its rank."""
        w = Window.partitionBy("_of").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        c = counts.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        mine = F.filter("_targets", lambda t: (t["rank"] >= F.col("_before")) & (t["rank"] < F.col("_before") + F.col("_c")))
        hit = c.select(F.explode(mine).alias("_t"), "_before", F.col(order).alias("_at"))
        return hit.agg(F.collect_list(F.struct(F.col("_t.i").alias("i"), (F.col("_t.rank") - F.col("_before")).alias("rank"),
                                               F.col("_at").alias("at"))).alias("_all"))

    def within(stats: DataFrame, at: str) -> DataFrame:
        """The rows whose ``at`` holds a target, with the targets there."""
        mine = F.filter("_all", lambda t: t["at"] == F.col(at))
        d = with_scalars(rows, stats).select("*", mine.alias("_targets")).where(F.size("_targets") > 0)
        return d.withColumn("_of", F.col(at))

    top = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    last = [F.least(r.cast("long"), F.col("_n")) - 1 for r in ranks]
    wanted = df.agg(F.count(F.lit(1)).alias("_n")).select(
        F.array(*[F.struct(F.lit(k).alias("i"), r.alias("rank")) for k, r in enumerate(last)]).alias("_targets"))
    first = holding(with_scalars(top, wanted).withColumn("_of", F.lit(0)), "_b")
    second = holding(within(first, "_b").groupBy("_of", "_targets", "_x").agg(F.count(F.lit(1)).alias("_c")), "_x")
    found = holding(within(second, "_x").groupBy("_of", "_targets", "_key").agg(F.count(F.lit(1)).alias("_c")), "_key")
    def of(k: int) -> Column:
        return F.get(F.transform(F.filter("_all", lambda t: t["i"] == k), lambda t: t["at"]), F.lit(0))

    return found.select(F.array(*[of(k) for k in range(len(ranks))]).alias("cuts"))


def hash_key(id_col: str) -> Column:
    """struct(h, id): the md5 of the id, then the id; null ids come first."""
    text = F.col(id_col).cast("string")
    return F.struct(F.coalesce(F.md5(text), F.lit("0" * 32)).alias("h"), F.coalesce(text, F.lit("")).alias("id"))
