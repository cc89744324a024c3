"""Dataset profile: value shares, null counts and score statistics.

All three tables come from single-pass aggregations; the null counts of
every column are computed in one ``agg`` and unpivoted with ``stack``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from critiq.functions.num import exact_quantiles, rnd, to_double, with_scalars


def value_shares(df: DataFrame, columns=("platform", "sentiment")) -> DataFrame:
    """(column, value, count, pct) for the listed columns (nulls not counted,
    pct of all rows, 1 decimal)."""
    cols = [c for c in columns if c in df.columns]
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    parts = None
    for c in cols:
        g = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
               .agg(F.count(F.lit(1)).cast("long").alias("count"))
               .withColumn("column", F.lit(c)))
        parts = g if parts is None else parts.unionByName(g)
    out = with_scalars(parts, total)
    return out.select("column", "value", "count",
                      rnd(F.col("count") / F.col("_n") * F.lit(100.0), 1).alias("pct"))


def null_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """(position, column, null_count, null_pct) of columns that have nulls;
    ``top`` keeps the first few by column position."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"_c{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    pairs = ", ".join(f"{i}, '{c}', _c{i}" for i, c in enumerate(df.columns))
    long = one.selectExpr("_n", f"stack({len(df.columns)}, {pairs}) as (position, column, null_count)")
    long = long.where(F.col("null_count") > 0)
    if top is not None:
        # the long table has one row per column, so this window is tiny
        w = Window.orderBy("position")
        long = long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
    return long.select(F.col("position").cast("int"), "column", F.col("null_count").cast("long"),
                       rnd(F.col("null_count") / F.col("_n") * F.lit(100.0), 1).alias("null_pct"))


def score_stats(df: DataFrame) -> DataFrame:
    """rows, columns, mean / median / sample std of the numeric score."""
    s = to_double("review_score")
    out = df.agg(F.count(F.lit(1)).cast("long").alias("rows"), F.lit(len(df.columns)).cast("int").alias("columns"),
                 rnd(F.avg(s), 2).alias("mean_score"), rnd(F.stddev_samp(s), 2).alias("std_score"))
    out = with_scalars(out, exact_quantiles(df.select(s.alias("_s")), "_s", [0.5], "_q"))
    return out.select("rows", "columns", "mean_score", rnd(F.col("_q")[0], 1).alias("median_score"), "std_score")
