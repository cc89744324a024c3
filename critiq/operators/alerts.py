"""Tiered negative-rate alerts per shop.

Reviews are counted per shop and second; from that table come the reference
time (latest review in the data) and, for every tier window at once, the
number of reviews and of negative ones inside it.  No per-shop loop, no range
join, one scan of the reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.functions.num import rnd, shared, to_double, with_scalars
from critiq.operators.common import grouped_with_first, is_neg
from critiq.operators.explore import equal_width_bin
from critiq.operators.sequential import prep_time

# Fixed values: (level, days, threshold, label) in severity order, and actions.
ALERT_LEVELS = [
    ("P0", 1, 0.50, "P0-Crisis"),
    ("P1", 3, 0.35, "P1-Warning"),
    ("P2", 7, 0.25, "P2-Watch"),
    ("P3", 14, 0.20, "P3-Track"),
]
ALERT_ACTIONS = {
    "P0": "Immediate escalation: contact customers, halt new orders",
    "P1": "Reply all negative reviews within 24h, issue vouchers",
    "P2": "Analyze root causes this week, optimize service process",
    "P3": "Monitor daily trend, benchmark against competitors",
}
MIN_SHOP_REVIEWS = 3
MIN_WINDOW_REVIEWS = 2


def alerts(df: DataFrame, levels=ALERT_LEVELS, actions=ALERT_ACTIONS) -> DataFrame:
    """level, shop_id, shop_name, score, neg_rate, message, action (+ severity).

    The reviews are read once, into counts per shop and second; the reference
    time and all windows come from these, by hash aggregates."""
    d = prep_time(df)
    label = F.col("sentiment_label") if "sentiment_label" in d.columns else F.lit(None)
    score = to_double("review_score")
    d = d.select("shop_id", "shop_name", "review_time", is_neg(label).cast("long").alias("_neg"), score.alias("_s"))
    # reviews without a shop count for the reference time alone
    seconds = shared(d.groupBy("shop_id", "shop_name", "review_time").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_neg").alias("_neg"), F.sum("_s").alias("_s"), F.count("_s").alias("_c")))
    ref = seconds.agg(F.max("review_time").alias("_ref"))
    t = with_scalars(seconds.where(F.col("shop_id").isNotNull()), ref)
    sums = {"_n": F.col("_n"), "_s": F.col("_s"), "_c": F.col("_c")}
    for lvl, days, _, _ in levels:
        inside = F.col("review_time") >= F.col("_ref") - F.expr(f"INTERVAL {days} DAYS")
        sums[f"_n_{lvl}"] = F.when(inside, F.col("_n")).otherwise(F.lit(0))
        sums[f"_x_{lvl}"] = F.when(inside, F.col("_neg")).otherwise(F.lit(0))
    g = grouped_with_first(t, ["shop_id"], ["shop_name"], sums).where(F.col("_n") >= MIN_SHOP_REVIEWS)
    return tiers(g, levels, actions).where(F.col("level").isNotNull())


def tiers(g: DataFrame, levels=ALERT_LEVELS, actions=ALERT_ACTIONS, keep: tuple = ()) -> DataFrame:
    """The alert row of every shop from its window counts: ``_n_P0``, ``_x_P0``
    (reviews and negative ones in the tier's window) and so on, and the sum
    ``_s`` and number ``_c`` of its scores.  The first tier of ``levels`` that
    fires counts; level is null where none does."""
    g = g.withColumn("_score", F.try_divide(F.col("_s"), F.col("_c")))
    level = rate = days_c = sev = None
    for i, (lvl, days, thr, name) in enumerate(levels):
        r = F.try_divide(F.col(f"_x_{lvl}"), F.col(f"_n_{lvl}"))
        fire = (F.col(f"_n_{lvl}") >= MIN_WINDOW_REVIEWS) & (r >= F.lit(thr))
        if level is None:
            level, rate, days_c, sev = (F.when(fire, F.lit(name)), F.when(fire, r),
                                        F.when(fire, F.lit(days)), F.when(fire, F.lit(i)))
        else:
            level, rate, days_c, sev = (level.when(fire, F.lit(name)), rate.when(fire, r),
                                        days_c.when(fire, F.lit(days)), sev.when(fire, F.lit(i)))
    action = None
    for lvl, _, _, name in levels:
        a = actions.get(lvl, "Monitor")
        action = F.when(F.col("level") == name, F.lit(a)) if action is None else action.when(F.col("level") == name, F.lit(a))
    g = g.select("shop_id", "shop_name", "_score", level.alias("level"), rate.alias("_rate"),
                 days_c.alias("_days"), sev.cast("int").alias("severity"), *keep)
    pct = F.bround(F.col("_rate") * F.lit(100.0), 0).cast("long").cast("string")
    return g.select(
        "level", "shop_id", "shop_name", rnd(F.col("_score"), 2).alias("score"),
        rnd(F.col("_rate") * F.lit(100.0), 1).alias("neg_rate"),
        F.concat(F.col("_days").cast("string"), F.lit("d negative rate "), pct, F.lit("% >= threshold")).alias("message"),
        action.alias("action"), "severity", *keep)


def alert_levels(al: DataFrame) -> DataFrame:
    return al.groupBy("level").agg(F.count(F.lit(1)).cast("long").alias("shop_count"))


def alert_histogram(al: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins of the alert negative rate (the maximum in the last bin)."""
    al = shared(al)
    mm = al.agg(F.min("neg_rate").alias("_lo"), F.max("neg_rate").alias("_hi"))
    b = with_scalars(al, mm).withColumn("bin", equal_width_bin(F.col("neg_rate"), F.col("_lo"), F.col("_hi"), bins))
    return b.groupBy("bin").agg(F.count(F.lit(1)).cast("long").alias("shop_count"),
                                F.min("neg_rate").alias("min_rate"), F.max("neg_rate").alias("max_rate"))
