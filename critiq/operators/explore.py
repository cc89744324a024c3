"""Exploratory queries (the data behind the notebook tables and figures)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.num import min_max_scale, rnd, shared, with_scalars
from critiq.operators.tabular import distinct_counts


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based equal-width bin over [lo, hi]; the maximum lands in the last bin."""
    raw = F.floor((x - lo) * F.lit(float(bins)) / (hi - lo)) + F.lit(1)
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(raw, F.lit(bins))).cast("int")


def drift_histogram(ranked: DataFrame, top: int | None = None, bins: int = 20) -> DataFrame:
    """FIG-1: histogram of rank drift, with the 90th percentile of the
    absolute drift, over all shops or the ``top`` best by Wilson."""
    best = shared(ranked.orderBy("wilson_rank", "shop_id").limit(top) if top else ranked)
    mm = best.agg(F.min("rank_drift").alias("_lo"), F.max("rank_drift").alias("_hi"),
                  F.percentile(F.abs(F.col("rank_drift")), 0.9).alias("p90_abs_drift"))
    b = with_scalars(best, mm)
    b = b.withColumn("bin", equal_width_bin(F.col("rank_drift"), F.col("_lo"), F.col("_hi"), bins))
    return b.groupBy("bin").agg(F.count(F.lit(1)).cast("long").alias("shop_count"),
                                F.min("p90_abs_drift").alias("p90_abs_drift"))


# ----------------------------------------------------------------- NBK-1/2
def value_distribution(df: DataFrame, col: str, share: bool = True) -> DataFrame:
    """count per value (nulls skipped) with its % of the non-null rows."""
    d = df.where(F.col(col).isNotNull())
    g = d.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("count"))
    if not share:
        return g
    g = shared(g)
    tot = g.agg(F.sum("count").alias("_t"))
    return with_scalars(g, tot).select(col, "count", rnd(F.col("count") / F.col("_t") * F.lit(100.0), 1).alias("pct"))


# ----------------------------------------------------------------- NBK-3
def length_box(df: DataFrame, by: str = "sentiment", col: str = "content_len", cap: float | None = None) -> DataFrame:
    """Box statistics per group on lengths (clipped to [0, cap] if given): quartiles
    and 1.5-IQR whiskers (the most extreme values inside the fences)."""
    x = F.greatest(F.col(col).cast("double"), F.lit(0.0))
    d = df.where(F.col(by).isNotNull()).select(by, (x if cap is None else F.least(x, F.lit(cap))).alias("_x"))
    q = d.groupBy(by).agg(F.percentile("_x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    # one row per group; AQE broadcasts it when the group count is small and
    # keeps a shuffle join when ``by`` has many values
    j = d.join(q, by)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - F.lit(1.5) * iqr, F.col("q3") + F.lit(1.5) * iqr
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
        F.count(F.lit(1)).cast("long").alias("count"))


# ----------------------------------------------------------------- NBK-4/5/13
def city_summary(df: DataFrame) -> DataFrame:
    """Our definition (the original class was removed): per city the review
    count, mean score (3 d), distinct shops and negative share in % (1 d)."""
    lab = F.col("sentiment_label")
    return df.where(F.col("city").isNotNull()).groupBy("city").agg(
        F.count("review_id").cast("long").alias("review_count"),
        rnd(F.avg(F.col("review_score").cast("double")), 3).alias("avg_score"),
        F.countDistinct("shop_id").cast("long").alias("shop_count"),
        rnd(F.avg(F.when(lab == -1, 1.0).otherwise(0.0)) * F.lit(100.0), 1).alias("neg_rate"))


def top_values(df: DataFrame, col: str, k: int = 12) -> DataFrame:
    """The k most frequent values (ties by value); k is the report size."""
    g = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("count"))
    return g.orderBy(F.col("count").desc(), F.col(col)).limit(k)


def coverage(df: DataFrame, approx: bool = False) -> DataFrame:
    """Numbers of shops, cities and districts; exact ones from one narrow scan each."""
    names = {"shops": "shop_id", "cities": "city", "districts": "district"}
    if approx:
        return df.agg(*[F.approx_count_distinct(c).cast("long").alias(n) for n, c in names.items()])
    return distinct_counts(df, list(names.values())).select(*[F.col(c).cast("long").alias(n) for n, c in names.items()])


# ----------------------------------------------------------------- NBK-14
QUADRANTS = ["star market", "high traffic, improve", "niche quality", "weak"]  # fixed labels (ours)


def city_quadrants(cities: DataFrame, top: int | None = None) -> DataFrame:
    """Split the cities (or the ``top`` ones by review count) into four quadrants
    at the medians of review count and mean score over those cities."""
    best = shared(cities.orderBy(F.col("review_count").desc(), F.col("city")).limit(top) if top else cities)
    med = best.agg(F.percentile(F.col("review_count").cast("double"), 0.5).alias("_mc"),
                   F.percentile("avg_score", 0.5).alias("_ms"))
    b = with_scalars(best, med)
    hi_c, hi_s = F.col("review_count") >= F.col("_mc"), F.col("avg_score") >= F.col("_ms")
    quad = (F.when(hi_c & hi_s, QUADRANTS[0]).when(hi_c, QUADRANTS[1]).when(hi_s, QUADRANTS[2])
            .otherwise(QUADRANTS[3]))
    return b.select("city", "review_count", "avg_score", "shop_count", "neg_rate", quad.alias("quadrant"))


# ----------------------------------------------------------------- NBK-6/7
def score_vs_negrate(ranking: DataFrame, min_reviews: int = 15, top: int | None = None) -> DataFrame:
    """Shops with at least ``min_reviews`` reviews (or the first ``top`` of
    them by Bayes rank); mean of their average score and negative rate."""
    sub = ranking.where(F.col("review_count") >= min_reviews)
    if top:
        sub = sub.orderBy("bayes_rank", "shop_id").limit(top)
    return sub.agg(F.count(F.lit(1)).cast("long").alias("shops"),
                   rnd(F.avg("avg_score"), 4).alias("mean_avg_score"),
                   rnd(F.avg("neg_rate"), 4).alias("mean_neg_rate"))


# ----------------------------------------------------------------- NBK-8
def lower_triangle(corr: DataFrame, columns: list[str]) -> DataFrame:
    pos = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return corr.where(pos[F.col("col")] < pos[F.col("row")])


# ----------------------------------------------------------------- NBK-9 / FIG-3
def peak_hour(hourly: DataFrame) -> DataFrame:
    """Hour with the most reviews (earliest hour on ties)."""
    return hourly.agg(F.max_by("review_hour", F.struct(F.col("count"), -F.col("review_hour"))).alias("peak_hour"),
                      F.max("count").alias("count"))


MEALS = {"lunch": (11, 14), "dinner": (18, 22)}  # fixed values: inclusive hour ranges


def meal_buckets(hourly: DataFrame) -> DataFrame:
    h = F.col("review_hour")
    bucket = F.when(h.between(*MEALS["lunch"]), "lunch").when(h.between(*MEALS["dinner"]), "dinner").otherwise("other")
    g = shared(hourly.groupBy(bucket.alias("meal")).agg(F.sum("count").cast("long").alias("count")))
    tot = g.agg(F.sum("count").alias("_t"))
    return with_scalars(g, tot).select("meal", "count", rnd(F.col("count") / F.col("_t") * F.lit(100.0), 1).alias("pct"))


# ----------------------------------------------------------------- FIG-4
def flag_period(monthly: DataFrame, since: str = "2020-03") -> DataFrame:
    return monthly.withColumn("anomaly_period", F.col("year_month") >= F.lit(since))


# ----------------------------------------------------------------- FIG-5/6
def segment_sample(rfm: DataFrame, per_segment: int = 600, seg_col: str = "segment") -> DataFrame:
    """A fixed-size, reproducible sample per segment (smallest md5 of the
    user id), computed with a two-stage exact top-k so a huge segment is
    spread over many tasks."""
    from critiq.operators.common import top_k_per_group
    d = rfm.withColumn("_h", F.md5(F.col("user_id").cast("string")))
    return top_k_per_group(d, [seg_col], [F.col("_h"), F.col("user_id")], per_segment, salt_col="user_id").drop("_h")


def segment_share(rfm: DataFrame, seg_col: str = "segment") -> DataFrame:
    g = shared(rfm.groupBy(seg_col).agg(F.count(F.lit(1)).cast("long").alias("user_count")))
    tot = g.agg(F.sum("user_count").alias("_t"))
    return with_scalars(g, tot).select(seg_col, "user_count", rnd(F.col("user_count") / F.col("_t") * F.lit(100.0), 1).alias("pct"))


# ----------------------------------------------------------------- NBK-15
KOL_TIERS = [("KOL", 0.95), ("Super", 0.80), ("Active", 0.50)]  # ours; below -> Regular


def influence_rank(df: DataFrame, exact: bool = True, accuracy: int = 100000) -> DataFrame:
    """Our definition (the original formula is not published): mean of the
    min-max-scaled review count, total likes and distinct shops per user;
    tiers at the 50th / 80th / 95th percentile of that score (``exact=False``:
    ``percentile_approx``, for user tables with very many distinct scores)."""
    g = df.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("review_id").cast("long").alias("review_count"),
        F.sum(F.coalesce(F.col("like_count").cast("double"), F.lit(0.0))).alias("total_likes"),
        F.countDistinct("shop_id").cast("long").alias("shop_count"))
    g = shared(g)
    mm = g.agg(*[f(F.col(c).cast("double")).alias(f"_{n}_{c}") for c in ("review_count", "total_likes", "shop_count")
                 for n, f in (("lo", F.min), ("hi", F.max))])
    s = with_scalars(g, mm)
    parts = [min_max_scale(F.col(c).cast("double"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"))
             for c in ("review_count", "total_likes", "shop_count")]
    s = shared(s.select("user_id", "review_count", "total_likes", "shop_count",
                        rnd((parts[0] + parts[1] + parts[2]) / F.lit(3.0), 6).alias("influence_score")))
    probs = F.array(*[F.lit(p) for _, p in KOL_TIERS])
    pct = F.percentile("influence_score", probs) if exact else \
        F.percentile_approx("influence_score", probs, accuracy).cast("array<double>")
    q = s.agg(pct.alias("_q"))
    s = with_scalars(s, q)
    tier = None
    for i, (name, _) in enumerate(KOL_TIERS):
        cond = F.col("influence_score") >= F.col("_q")[i]
        tier = F.when(cond, name) if tier is None else tier.when(cond, name)
    return s.select("user_id", "review_count", "total_likes", "shop_count", "influence_score",
                    tier.otherwise("Regular").alias("kol_tier"))


# ----------------------------------------------------------------- NBK-16
SITE_WEIGHTS = (0.4, 0.4, 0.2)  # ours: score, log volume, (1 - negative share)


def site_score(cities: DataFrame) -> DataFrame:
    """Our definition: weighted min-max-scaled score, log volume and
    positive share per city; grades A-D by quartile of the site score."""
    c = shared(cities.withColumn("_vol", F.log(F.lit(1.0) + F.col("review_count").cast("double")))
                     .withColumn("_pos", F.lit(1.0) - F.col("neg_rate") / F.lit(100.0)))
    feats = ["avg_score", "_vol", "_pos"]
    mm = c.agg(*[f(c_).alias(f"_{n}{c_}") for c_ in feats for n, f in (("lo", F.min), ("hi", F.max))])
    s = with_scalars(c, mm)
    sc = None
    for w, f in zip(SITE_WEIGHTS, feats):
        term = F.lit(w) * min_max_scale(F.col(f), F.col(f"_lo{f}"), F.col(f"_hi{f}"))
        sc = term if sc is None else sc + term
    s = shared(s.withColumn("site_score", rnd(sc, 4)))
    q = s.agg(F.percentile("site_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    s = with_scalars(s, q)
    grade = (F.when(F.col("site_score") >= F.col("_q")[2], "A").when(F.col("site_score") >= F.col("_q")[1], "B")
             .when(F.col("site_score") >= F.col("_q")[0], "C").otherwise("D"))
    return s.select("city", "review_count", "avg_score", "neg_rate",
                    rnd(F.col("_vol"), 4).alias("log_volume"), "site_score", grade.alias("grade"))
