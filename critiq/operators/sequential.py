"""Time-series operators: hourly and monthly series, negative bursts, trend
decomposition and forecast, rule-based RFM.

Shapes: the per-review work is one partial/final aggregation to a day,
month or user table.  Row-ordered windows run only on day and month tables,
whose size is bounded by the calendar (a few thousand rows for decades),
never on review or user tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critiq.functions.num import exact_quantiles, rnd, shared, to_double, with_scalars
from critiq.operators.common import is_neg



# ------------------------------------------------------------------ SEQ-0
def prep_time(df: DataFrame) -> DataFrame:
    """Parse ``review_time`` leniently and drop rows without a time."""
    dt = df.schema["review_time"].dataType
    # TIMESTAMP_NTZ stays as it is: hour, date and day differences are then
    # independent of the session time zone
    if not isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        t = (F.col("review_time").cast("timestamp_ntz") if isinstance(dt, T.DateType)
             else F.col("review_time").cast("string").try_cast("timestamp_ntz"))
        df = df.withColumn("review_time", t)
    return df.where(F.col("review_time").isNotNull())


def _label(df: DataFrame) -> Column:
    return F.col("sentiment_label") if "sentiment_label" in df.columns else F.lit(None).cast("double")


# ------------------------------------------------------------------ SEQ-1/2
def hourly_pattern(df: DataFrame) -> DataFrame:
    d = prep_time(df)
    return d.groupBy(F.hour("review_time").alias("review_hour")).agg(
        F.count("review_id").cast("long").alias("count"))


def monthly_trend(df: DataFrame, key: str | None = None) -> DataFrame:
    """count and mean score per ``yyyy-MM`` (per ``key`` when given)."""
    d = prep_time(df)
    keys = ([key] if key else []) + [F.date_format("review_time", "yyyy-MM").alias("year_month")]
    return d.groupBy(*keys).agg(F.count("review_id").cast("long").alias("count"),
                                F.avg(to_double("review_score")).alias("avg_score"))


# ------------------------------------------------------------------ SEQ-3
def burst_detection(df: DataFrame, window: int = 7, threshold: float = 2.0) -> DataFrame:
    """Rolling z-score of the daily negative rate over the last ``window``
    observed days (today included).  A one-day frame uses std 0.01; a
    constant frame gives 0/0 -> null and no alert; z is rounded to 2
    digits before the threshold test."""
    d = prep_time(df)
    # the day is a 'yyyy-MM-dd' label, like the 'yyyy-MM' label of the
    # monthly series (it sorts in time order)
    daily = d.groupBy(F.date_format("review_time", "yyyy-MM-dd").alias("date")).agg(
        F.count("review_id").cast("long").alias("total"),
        F.sum(is_neg(_label(d))).cast("long").alias("neg"))
    daily = daily.withColumn("neg_rate", F.col("neg") / F.col("total"))
    # one ordered partition over the day table (bounded by the calendar)
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    mean = F.avg("neg_rate").over(w)
    std = F.coalesce(F.stddev_samp("neg_rate").over(w), F.lit(0.01))
    z = rnd(F.try_divide(F.col("neg_rate") - mean, std), 2)
    out = daily.withColumn("z_score", z)
    return out.withColumn("alert", F.coalesce(F.col("z_score") >= F.lit(float(threshold)), F.lit(False)))


# ------------------------------------------------------------------ SEQ-4/5
DECOMP_SCHEMA = ("year_month string, count long, avg_score double, trend double, "
                 "seasonal double, residual double, method string")


def cma_decomposition(monthly: DataFrame, key: str | None = None, period: int = 12) -> DataFrame:
    """Classical fallback: centred ``period``-month mean (at least half a
    period of rows in the frame), seasonal = count - trend (or the mean
    count where the trend is undefined), residual 0."""
    part = [key] if key else []
    half = period // 2
    w = Window.partitionBy(*part).orderBy("year_month").rowsBetween(-half, half - 1)
    wall = Window.partitionBy(*part)
    n_in = F.count(F.lit(1)).over(w)
    trend = F.when(n_in >= half, F.avg(F.col("count").cast("double")).over(w))
    out = monthly.withColumn("trend", trend)
    mean_count = F.avg(F.col("count").cast("double")).over(wall)
    out = out.withColumn("seasonal", F.col("count") - F.coalesce(F.col("trend"), mean_count))
    return out.withColumn("residual", F.lit(0.0)).withColumn("method", F.lit("CMA-12"))


def trend_decomposition(df: DataFrame, key: str | None = None, method: str = "auto",
                        min_stl_months: int = 24, period: int = 12) -> DataFrame:
    """Monthly decomposition per series: robust STL (grouped pandas function,
    one task per series, all series in parallel) for series of at least
    ``min_stl_months`` months, the centred-mean fallback otherwise.
    ``method`` = 'auto' | 'stl' | 'cma'."""
    monthly = shared(monthly_trend(df, key))
    if method == "cma":
        return cma_decomposition(monthly, key, period)
    from critiq.operators.stl import stl_grouped
    # series lengths from an aggregate (one row per series) and semi joins,
    # not a window: the STL input then keeps the explicit key partitioning
    # that spreads the series over the cores
    if key:
        sizes = monthly.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        long_ = monthly.join(sizes.where(F.col("_n") >= min_stl_months), key, "left_semi")
        short = monthly.join(sizes.where(F.col("_n") < min_stl_months), key, "left_semi")
    else:
        sized = with_scalars(monthly, monthly.agg(F.count(F.lit(1)).alias("_n")))
        long_ = sized.where(F.col("_n") >= min_stl_months).drop("_n")
        short = sized.where(F.col("_n") < min_stl_months).drop("_n")
    stl = stl_grouped(long_, key, period=period)
    if method == "stl":
        return stl
    return stl.unionByName(cma_decomposition(short, key, period))


# ------------------------------------------------------------------ SEQ-6
def forecast_trend(decomp: DataFrame, steps: int = 6, key: str | None = None,
                   digits: int | None = 6) -> DataFrame:
    """OLS line through the trend (index 0..n-1 over months with a trend),
    extended ``steps`` months.  Forecast rows: count = max(y, 0) rounded half
    to even, trend = y, avg_score null, seasonal = residual = 0.  Months
    without a trend are dropped; a series with fewer than 6 trend points
    gets no forecast rows (its actual rows are kept, typed 'actual').

    ``digits`` rounds the fitted trend of forecast rows (different OLS
    implementations differ in the last bits); None keeps it raw.
    """
    part = [key] if key else []
    d = shared(decomp.where(F.col("trend").isNotNull()))
    d = d.withColumn("_t", (F.row_number().over(Window.partitionBy(*part).orderBy("year_month")) - 1).cast("double"))
    fit = d.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope("trend", "_t").alias("_b"),
        F.regr_intercept("trend", "_t").alias("_a"), F.max("year_month").alias("_last"),
        F.max_by("method", "year_month").alias("_method"))
    fit = fit.where(F.col("_n") >= 6)
    steps_df = fit.select(*part, "_n", "_a", "_b", "_last", "_method",
                          F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_i"))
    y = F.col("_a") + F.col("_b") * (F.col("_n") + F.col("_i") - F.lit(1)).cast("double")
    ym = F.date_format(F.add_months(F.to_date(F.concat(F.col("_last"), F.lit("-01"))), F.col("_i")), "yyyy-MM")
    trend = rnd(y, digits) if digits is not None else y
    fc = steps_df.select(
        *part, ym.alias("year_month"),
        F.bround(F.greatest(y, F.lit(0.0)), 0).cast("long").alias("count"),
        F.lit(None).cast("double").alias("avg_score"), trend.alias("trend"),
        F.lit(0.0).alias("seasonal"), F.lit(0.0).alias("residual"),
        F.col("_method").alias("method"), F.lit("forecast").alias("type"))
    actual = d.drop("_t").withColumn("type", F.lit("actual"))
    return actual.unionByName(fc.select(*actual.columns))


# ------------------------------------------------------------------ SEQ-7
RFM_SEGMENTS = ["Champions", "Recent Users", "Loyal Users", "Potential", "At Risk"]  # fixed values


def _quartile_score(x: Column, edges: Column, reverse: bool) -> Column:
    """pandas-qcut style score 1..4 (4..1 when ``reverse``); right-closed
    bins, lowest edge included; if any edge repeats every row gets 2.0."""
    e = [F.element_at(edges, i) for i in range(1, 6)]
    distinct = (e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3]) & (e[3] < e[4])
    idx = F.when(x <= e[1], 0).when(x <= e[2], 1).when(x <= e[3], 2).when(x <= e[4], 3)
    score = (F.lit(4) - idx) if reverse else (idx + F.lit(1))
    return F.when(distinct, score.cast("double")).otherwise(F.lit(2.0))


def rfm_table(df: DataFrame) -> DataFrame:
    """Per user: R = whole days since the user's last review, counted from
    the latest review in the data; F = reviews; M = mean score.

    The reference time is the maximum of the per-user maxima (the null-user
    group is kept for it), so the review table is read once."""
    g = shared(prep_time(df).groupBy("user_id").agg(F.max("review_time").alias("_last"),
                                                    F.count("review_id").cast("long").alias("F"),
                                                    F.avg(to_double("review_score")).alias("M")))
    ref = g.agg(F.max("_last").alias("_ref"))
    g = with_scalars(g.where(F.col("user_id").isNotNull()), ref)
    return g.select("user_id", F.expr("timestampdiff(DAY, _last, _ref)").cast("long").alias("R"), "F", "M")


def rfm_segmentation(df: DataFrame) -> DataFrame:
    """Quartile RFM scores and rule segments.

    Quartile edges are exact.  R and F are whole numbers (days; counts, of
    which n reviews have fewer than sqrt(2n) different ones), so one aggregate
    holds their values; the mean scores M go through ``exact_quantiles``.
    """
    t = rfm_table(df)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    at = F.array(*[F.lit(p) for p in probs])
    edges = t.agg(*[F.percentile(F.col(c).cast("double"), at).alias(f"_e{c}") for c in ("R", "F")])
    edges = with_scalars(edges, exact_quantiles(t, "M", probs, "_eM"))
    s = with_scalars(t, edges)
    s = s.select("user_id", "R", "F", "M",
                 _quartile_score(F.col("R").cast("double"), F.col("_eR"), True).alias("R_score"),
                 _quartile_score(F.col("F").cast("double"), F.col("_eF"), False).alias("F_score"),
                 _quartile_score(F.col("M"), F.col("_eM"), False).alias("M_score"))
    s = s.withColumn("rfm_total", F.col("R_score") + F.col("F_score") + F.col("M_score"))
    r, f = F.col("R_score"), F.col("F_score")
    seg = (F.when((r >= 3) & (f >= 3), RFM_SEGMENTS[0]).when(r >= 3, RFM_SEGMENTS[1])
           .when(f >= 3, RFM_SEGMENTS[2]).when(F.col("rfm_total") >= 8, RFM_SEGMENTS[3])
           .otherwise(RFM_SEGMENTS[4]))
    return s.withColumn("segment", seg).withColumn("M", rnd(F.col("M"), 2))


def rfm_segment_means(rfm: DataFrame) -> DataFrame:
    """Users and mean R/F/M scores per segment (2 digits)."""
    return rfm.groupBy("segment").agg(
        F.count("user_id").cast("long").alias("user_count"),
        rnd(F.avg("R_score"), 2).alias("avg_R_score"), rnd(F.avg("F_score"), 2).alias("avg_F_score"),
        rnd(F.avg("M_score"), 2).alias("avg_M_score"))
