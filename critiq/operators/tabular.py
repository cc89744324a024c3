"""Shop-level aggregations and rankings (summary, Bayes, Wilson, correlation).

All shop statistics are algebraic (count, sum, mean, first-by-time), so
they run as hash aggregates that merge before the shuffle on the shop key; a
shop holding a third of all rows makes a few rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.functions.num import clip, rnd, shared, to_double, with_scalars
from critiq.operators.common import dense_rank_desc, first_by_review, has, is_neg

BAYES_PRIOR_WEIGHT = 30      # fixed value: prior weight m of the shrinkage
WILSON_Z = 1.96              # fixed value: 95 % normal quantile


# ----------------------------------------------------------------- TAB-1
EDA_METRICS = ["reviews", "shops", "users", "cities", "mean_score", "score_std",
               "positive_reviews", "negative_reviews", "mean_length"]


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact number of different non-null values of each
    column (0 for a column that df lacks).

    Several distinct counts in one aggregate make Spark expand every row once
    per column and carry all of them through one shuffle.  Here each column has
    a scan of its own that reads this column alone and drops its repeats
    before the shuffle; the counts meet as scalars.
    """
    one = df.agg(F.count(F.lit(1)).alias("_rows"))
    for c in columns:
        if c in df.columns:
            values = df.select(c).where(F.col(c).isNotNull()).distinct()
            one = with_scalars(one, values.agg(F.count(F.lit(1)).alias(c)))
        else:
            one = one.withColumn(c, F.lit(0).cast("long"))
    return one.select(*columns)


def eda_summary(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Nine (metric, value) rows.  Sums and means come from one global
    aggregate; exact distinct counts from one narrow scan each, which drops
    repeated values before its shuffle (no row is expanded)."""
    zero = F.lit(0)
    score = to_double("review_score") if has(df, "review_score") else F.lit(None).cast("double")
    length = to_double("content_len") if has(df, "content_len") else F.lit(None).cast("double")
    distinct = {"shops": "shop_id", "users": "user_id", "cities": "city"}
    aggs = [
        F.count(F.lit(1)).alias("reviews"),
        rnd(F.avg(score), 3).alias("mean_score"),
        rnd(F.stddev_samp(score), 3).alias("score_std"),
        (F.sum(F.when(F.col("sentiment") == "positive", 1).otherwise(0)) if has(df, "sentiment") else zero).alias("positive_reviews"),
        (F.sum(F.when(F.col("sentiment") == "negative", 1).otherwise(0)) if has(df, "sentiment") else zero).alias("negative_reviews"),
        rnd(F.avg(length), 1).alias("mean_length"),
    ]
    if approx_distinct:
        aggs += [(F.approx_count_distinct(c) if has(df, c) else zero).alias(n) for n, c in distinct.items()]
        one = df.agg(*aggs)
    else:
        counts = distinct_counts(df, list(distinct.values()))
        one = with_scalars(df.agg(*aggs), counts.select(*[F.col(c).alias(n) for n, c in distinct.items()]))
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in EDA_METRICS)
    return one.selectExpr(f"stack({len(EDA_METRICS)}, {pairs}) as (metric, value)")


# ----------------------------------------------------------------- TAB-2/3
def _shop_groups(df: DataFrame, extras: list[str]) -> DataFrame:
    """One row per (shop_id, shop_name), null keys kept as groups so that the
    score sums still cover every row (for the global mean); the extras are those
    of the shop's first review by (time, review id)."""
    score = to_double("review_score")
    sums = {"review_count": F.col("review_id").isNotNull().cast("long"), "_s": score, "_c": score.isNotNull().cast("long")}
    if has(df, "sentiment_label"):
        sums["neg_count"] = is_neg(F.col("sentiment_label")).cast("long")
    present = [c for c in extras if c in df.columns]
    g = df.groupBy("shop_id", "shop_name").agg(*[F.sum(c).alias(n) for n, c in sums.items()],
                                               *[first_by_review(c, df).alias(c) for c in present])
    return g.select("shop_id", "shop_name", "review_count", F.try_divide(F.col("_s"), F.col("_c")).alias("avg_score"), "_s", "_c",
                    *present, *[c for c in ("neg_count",) if c in sums])


def _with_global_mean(groups: DataFrame, min_reviews: int) -> DataFrame:
    """Shops with enough reviews plus ``_mu``, the mean score over all rows.

    The mean comes from the per-shop partial sums (a table with one row per
    shop), so the fact table is scanned once for both."""
    # The shop table (one row per shop) feeds both the mean and the ranking;
    # persisting it makes the scan, joins and aggregate over the reviews run
    # once (lost blocks are recomputed from lineage).
    groups = shared(groups)
    mu = groups.agg((F.sum("_s") / F.sum("_c")).alias("_mu"))
    keep = groups.where(F.col("shop_id").isNotNull() & F.col("shop_name").isNotNull()
                        & (F.col("review_count") >= min_reviews)).drop("_s", "_c")
    return with_scalars(keep, mu)


def _bayes_cols(stats: DataFrame, m: int) -> DataFrame:
    n = F.col("review_count").cast("double")
    bayes = (F.col("_mu") * F.lit(float(m)) + F.col("avg_score") * n) / (F.lit(float(m)) + n)
    out = stats.withColumn("bayes_score", rnd(bayes, 3))
    if "neg_count" in stats.columns:
        out = out.withColumn("neg_rate", rnd(F.col("neg_count") / n * F.lit(100.0), 1))
    else:
        out = out.withColumn("neg_rate", F.lit(0.0))
    return out


def bayesian_ranking(df: DataFrame, min_reviews: int = 5,
                     prior_weight: int = BAYES_PRIOR_WEIGHT) -> DataFrame:
    """Bayesian shrinkage toward the global mean, dense-ranked descending.

    Columns: shop_id, shop_name, review_count, avg_score, city, district,
    category (those present), neg_count, bayes_score, neg_rate, bayes_rank.
    """
    stats = _with_global_mean(_shop_groups(df, ["city", "district", "category"]), min_reviews)
    out = _bayes_cols(stats, prior_weight).drop("_mu")
    return dense_rank_desc(out, "bayes_score", "bayes_rank")


def wilson_ranking(df: DataFrame, min_reviews: int = 5, z: float = WILSON_Z,
                   prior_weight: int = BAYES_PRIOR_WEIGHT) -> DataFrame:
    """Wilson lower bound of the normalised mean, with the Bayes rank beside it.

    One aggregation feeds both scores (no second scan, no self-join).
    ``rank_drift = bayes_rank - wilson_rank``: positive means Wilson places
    the shop better.
    """
    stats = _with_global_mean(_shop_groups(df, ["city", "category"]), min_reviews)
    s = _bayes_cols(stats, prior_weight).drop("_mu")
    n = F.col("review_count").cast("double")
    z2 = z * z
    p = clip((F.col("avg_score") - F.lit(1.0)) / F.lit(4.0), 0.0, 1.0)
    s = s.withColumn("_p", p)
    p = F.col("_p")
    denom = F.lit(1.0) + F.lit(z2) / n
    centre = p + F.lit(z2) / (F.lit(2.0) * n)
    spread = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (F.lit(4.0) * n * n))
    lower = clip((centre - spread) / denom, 0.0, 1.0)
    s = (s.withColumn("_lower", lower)
          .withColumn("wilson_lower", rnd(F.col("_lower"), 4))
          .withColumn("wilson_score", rnd(F.col("_lower") * F.lit(4.0) + F.lit(1.0), 3))
          .drop("_p", "_lower"))
    s = dense_rank_desc(s, "wilson_score", "wilson_rank")
    s = dense_rank_desc(s, "bayes_score", "bayes_rank")
    s = s.withColumn("rank_drift", F.coalesce(F.col("bayes_rank") - F.col("wilson_rank"), F.lit(0)).cast("int"))
    cols = ["shop_id", "shop_name", "review_count", "avg_score"] + \
        [c for c in ["city", "category"] if c in s.columns] + \
        ["wilson_lower", "wilson_score", "wilson_rank", "bayes_score", "bayes_rank", "neg_rate", "rank_drift"]
    return s.select(*cols)


# ----------------------------------------------------------------- TAB-7
CORR_COLUMNS = ["review_score", "like_count", "reply_count", "content_len",
                "sentiment_label", "aspect_count"]


def correlation(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Pearson matrix in long form (row, col, r) from one aggregation.

    Pairwise-complete rows as in pandas; a constant column yields null
    instead of raising (``try_divide`` on sample covariance / deviations).
    """
    cols = [c for c in (columns or CORR_COLUMNS) if c in df.columns]
    num = df.select(*[to_double(c).alias(c) for c in cols])
    aggs, keys = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            ca, cb = F.col(a), F.col(b)
            a2 = F.when(cb.isNull(), None).otherwise(ca)
            b2 = F.when(ca.isNull(), None).otherwise(cb)
            r = F.try_divide(F.covar_samp(ca, cb), F.stddev_samp(a2) * F.stddev_samp(b2))
            name = f"c{i}_{cols.index(b)}"
            aggs.append(rnd(r, digits).alias(name))
            keys.append((a, b, name))
    one = num.agg(*aggs)
    parts = []
    for a, b, name in keys:
        parts.append(f"'{a}', '{b}', {name}")
        if a != b:
            parts.append(f"'{b}', '{a}', {name}")
    return one.selectExpr(f"stack({len(parts)}, {', '.join(parts)}) as (row, col, r)")
