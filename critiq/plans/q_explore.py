"""Registered exploratory queries (notebook tables and figure data)."""

from __future__ import annotations

from critiq.functions.num import sql_rnd as R
from critiq.operators import explore as ex
from critiq.operators import sequential as seq
from critiq.operators import tabular as tab
from critiq.plans.q_sequential import MONTHLY, rfm_sql
from critiq.plans.q_tabular import CORR_COLS, _corr_sql, bayes_sql
from critiq.plans.registry import register
from critiq.sources.fixtures import ALERT_COLS, RFM_COLS, TREND_COLS, rv_docs, rv_events, rv_orders, with_views


@register("star_distribution", with_views(f""",
d AS (SELECT review_score FROM rv_orders WHERE review_score IS NOT NULL),
t AS (SELECT count(*) AS t FROM d)
SELECT review_score, CAST(count(*) AS BIGINT) AS count, {R('CAST(count(*) AS DOUBLE) / min(t) * 100.0e0', 1)} AS pct
FROM d, t GROUP BY review_score""", "rv_orders"))
def q_star_distribution(spark, sf_dir):
    return ex.value_distribution(rv_orders(spark, sf_dir, only="review_score"), "review_score")


@register("sentiment_distribution", with_views("""
SELECT sentiment, CAST(count(*) AS BIGINT) AS count FROM rv_docs WHERE sentiment IS NOT NULL GROUP BY 1""", "rv_docs"))
def q_sentiment_distribution(spark, sf_dir):
    return ex.value_distribution(rv_docs(spark, sf_dir), "sentiment", share=False)


@register("length_box", with_views(""",
d AS (SELECT sentiment, greatest(CAST(content_len AS DOUBLE), 0.0e0) AS x FROM rv_docs WHERE sentiment IS NOT NULL),
q AS (SELECT sentiment, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM d GROUP BY 1)
SELECT d.sentiment, q1, median, q3,
  min(CASE WHEN x >= q1 - 1.5e0 * (q3 - q1) THEN x END) AS whisker_lo,
  max(CASE WHEN x <= q3 + 1.5e0 * (q3 - q1) THEN x END) AS whisker_hi,
  CAST(count(*) AS BIGINT) AS count
FROM d JOIN q ON d.sentiment = q.sentiment GROUP BY d.sentiment, q1, median, q3""", "rv_docs"))
def q_length_box(spark, sf_dir):
    return ex.length_box(rv_docs(spark, sf_dir))


@register("top_cities", with_views("""
SELECT city, CAST(count(*) AS BIGINT) AS count FROM rv_orders WHERE city IS NOT NULL
GROUP BY city ORDER BY count DESC, city LIMIT 12""", "rv_orders"))
def q_top_cities(spark, sf_dir):
    return ex.top_values(rv_orders(spark, sf_dir, only="city"), "city", 12)


@register("coverage", with_views("""
SELECT CAST(count(DISTINCT shop_id) AS BIGINT) AS shops, CAST(count(DISTINCT city) AS BIGINT) AS cities,
       CAST(count(DISTINCT district) AS BIGINT) AS districts FROM rv_orders""", "rv_orders"))
def q_coverage(spark, sf_dir):
    return ex.coverage(rv_orders(spark, sf_dir, only="shop_id city district"))


@register("top_ranking", bayes_sql("rv_orders", 10).replace(
    "SELECT *, CAST(dense_rank() OVER (ORDER BY bayes_score DESC) AS INTEGER) AS bayes_rank FROM b",
    "SELECT *, CAST(dense_rank() OVER (ORDER BY bayes_score DESC) AS INTEGER) AS bayes_rank FROM b "
    "ORDER BY bayes_rank, shop_id LIMIT 20"))
def q_top_ranking(spark, sf_dir):
    r = tab.bayesian_ranking(rv_orders(spark, sf_dir, only=ALERT_COLS + " city district category"), min_reviews=10)
    return r.orderBy("bayes_rank", "shop_id").limit(20)


@register("score_vs_negrate", bayes_sql("rv_orders", 5, by_id=False).replace(
    "SELECT *, CAST(dense_rank() OVER (ORDER BY bayes_score DESC) AS INTEGER) AS bayes_rank FROM b",
    f""", rk AS (SELECT *, CAST(dense_rank() OVER (ORDER BY bayes_score DESC) AS INTEGER) AS bayes_rank FROM b),
sub AS (SELECT * FROM rk WHERE review_count >= 15)
SELECT CAST(count(*) AS BIGINT) AS shops, {R('avg(avg_score)', 4)} AS mean_avg_score,
       {R('avg(neg_rate)', 4)} AS mean_neg_rate FROM sub""").replace("FROM g, mu)\n, rk", "FROM g, mu), rk"))
def q_score_vs_negrate(spark, sf_dir):
    return ex.score_vs_negrate(tab.bayesian_ranking(rv_orders(spark, sf_dir, only=ALERT_COLS + " city district category"), min_reviews=5))


def _lower_sql() -> str:
    base = with_views(_corr_sql("rv_orders", CORR_COLS), "rv_orders")
    head, tail = base.split("\nSELECT '", 1)
    pos = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CORR_COLS))
    return (head + ", allr AS (SELECT '" + tail + ")\nSELECT * FROM allr WHERE "
            f"(CASE col {pos} END) < (CASE row {pos} END)")


@register("correlation_lower", _lower_sql())
def q_correlation_lower(spark, sf_dir):
    return ex.lower_triangle(tab.correlation(rv_orders(spark, sf_dir, only=" ".join(CORR_COLS)), CORR_COLS), CORR_COLS)


HOURLY = """h AS (SELECT CAST(hour(review_time) AS INTEGER) AS review_hour, CAST(count(review_id) AS BIGINT) AS count
      FROM rv_events WHERE review_time IS NOT NULL GROUP BY 1)"""


@register("peak_hour", with_views(f", {HOURLY}\nSELECT arg_max(review_hour, (count, -review_hour)) AS peak_hour, max(count) AS count FROM h", "rv_events"))
def q_peak_hour(spark, sf_dir):
    return ex.peak_hour(seq.hourly_pattern(rv_events(spark, sf_dir)))


@register("meal_buckets", with_views(f""", {HOURLY},
m AS (SELECT CASE WHEN review_hour BETWEEN 11 AND 14 THEN 'lunch' WHEN review_hour BETWEEN 18 AND 22 THEN 'dinner'
             ELSE 'other' END AS meal, count FROM h)
SELECT meal, CAST(sum(count) AS BIGINT) AS count,
       {R('CAST(sum(count) AS DOUBLE) / (SELECT CAST(sum(count) AS DOUBLE) FROM h) * 100.0e0', 1)} AS pct
FROM m GROUP BY meal""", "rv_events"))
def q_meal_buckets(spark, sf_dir):
    return ex.meal_buckets(seq.hourly_pattern(rv_events(spark, sf_dir)))


CITY = f"""cs AS (SELECT city, CAST(count(review_id) AS BIGINT) AS review_count, {R('avg(review_score)', 3)} AS avg_score,
       CAST(count(DISTINCT shop_id) AS BIGINT) AS shop_count,
       {R('avg(CASE WHEN sentiment_label = -1 THEN 1.0e0 ELSE 0.0e0 END) * 100.0e0', 1)} AS neg_rate
FROM rv_orders WHERE city IS NOT NULL GROUP BY city)"""


@register("city_summary", with_views(f", {CITY}\nSELECT * FROM cs", "rv_orders"))
def q_city_summary(spark, sf_dir):
    return ex.city_summary(rv_orders(spark, sf_dir, only="review_id city review_score shop_id sentiment_label"))


@register("city_quadrants", with_views(f""", {CITY},
b AS (SELECT * FROM cs),
m AS (SELECT quantile_cont(CAST(review_count AS DOUBLE), 0.5) AS mc, quantile_cont(avg_score, 0.5) AS ms FROM b)
SELECT city, review_count, avg_score, shop_count, neg_rate,
  CASE WHEN review_count >= mc AND avg_score >= ms THEN 'star market' WHEN review_count >= mc THEN 'high traffic, improve'
       WHEN avg_score >= ms THEN 'niche quality' ELSE 'weak' END AS quadrant
FROM b, m""", "rv_orders"))
def q_city_quadrants(spark, sf_dir):
    return ex.city_quadrants(ex.city_summary(rv_orders(spark, sf_dir, only="review_id city review_score shop_id sentiment_label")))


def _mm(c: str) -> str:
    return f"((CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c} + 1e-9))"


@register("influence_rank", with_views(f""",
g AS (SELECT user_id, CAST(count(review_id) AS BIGINT) AS review_count,
        sum(coalesce(CAST(like_count AS DOUBLE), 0.0e0)) AS total_likes,
        CAST(count(DISTINCT shop_id) AS BIGINT) AS shop_count
      FROM rv_orders WHERE user_id IS NOT NULL GROUP BY user_id),
mm AS (SELECT {', '.join(f'CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}' for c in ('review_count', 'total_likes', 'shop_count'))} FROM g),
s AS (SELECT user_id, review_count, total_likes, shop_count,
        {R(f"({_mm('review_count')} + {_mm('total_likes')} + {_mm('shop_count')}) / 3.0e0", 6)} AS influence_score FROM g, mm),
q AS (SELECT quantile_cont(influence_score, [0.95, 0.80, 0.50]) AS q FROM s)
SELECT user_id, review_count, total_likes, shop_count, influence_score,
  CASE WHEN influence_score >= q[1] THEN 'KOL' WHEN influence_score >= q[2] THEN 'Super'
       WHEN influence_score >= q[3] THEN 'Active' ELSE 'Regular' END AS kol_tier
FROM s, q""", "rv_orders"))
def q_influence_rank(spark, sf_dir):
    return ex.influence_rank(rv_orders(spark, sf_dir, only="review_id user_id shop_id like_count"))


def _mm2(c: str) -> str:
    return f"(({c} - lo{c}) / (hi{c} - lo{c} + 1e-9))"


@register("site_score", with_views(f""", {CITY},
c AS (SELECT *, ln(1.0e0 + CAST(review_count AS DOUBLE)) AS vol, 1.0e0 - neg_rate / 100.0e0 AS pos FROM cs),
mm AS (SELECT min(avg_score) AS loavg_score, max(avg_score) AS hiavg_score, min(vol) AS lovol, max(vol) AS hivol,
              min(pos) AS lopos, max(pos) AS hipos FROM c),
s AS (SELECT *, {R(f"0.4e0 * {_mm2('avg_score')} + 0.4e0 * {_mm2('vol')} + 0.2e0 * {_mm2('pos')}", 4)} AS site_score FROM c, mm),
q AS (SELECT quantile_cont(site_score, [0.25, 0.5, 0.75]) AS q FROM s)
SELECT city, review_count, avg_score, neg_rate, {R('vol', 4)} AS log_volume, site_score,
  CASE WHEN site_score >= q[3] THEN 'A' WHEN site_score >= q[2] THEN 'B' WHEN site_score >= q[1] THEN 'C' ELSE 'D' END AS grade
FROM s, q""", "rv_orders"))
def q_site_score(spark, sf_dir):
    return ex.site_score(ex.city_summary(rv_orders(spark, sf_dir, only="review_id city review_score shop_id sentiment_label")))


@register("monthly_flagged", with_views(f", m AS ({MONTHLY.format(v='rv_orders').strip()})\n"
                                        "SELECT *, year_month >= '1996-01' AS anomaly_period FROM m", "rv_orders"))
def q_monthly_flagged(spark, sf_dir):
    return ex.flag_period(seq.monthly_trend(rv_orders(spark, sf_dir, only=TREND_COLS)), since="1996-01")


@register("segment_sample", with_views(rfm_sql("rv_orders") + """,
rn AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY md5(user_id), user_id) AS k FROM rfm)
SELECT * EXCLUDE (k) FROM rn WHERE k <= 600""", "rv_orders"))
def q_segment_sample(spark, sf_dir):
    return ex.segment_sample(seq.rfm_segmentation(rv_orders(spark, sf_dir, only=RFM_COLS)), 600)


@register("segment_share", with_views(rfm_sql("rv_orders") + f"""
SELECT segment, CAST(count(*) AS BIGINT) AS user_count,
       {R('CAST(count(*) AS DOUBLE) / (SELECT CAST(count(*) AS DOUBLE) FROM rfm) * 100.0e0', 1)} AS pct
FROM rfm GROUP BY segment""", "rv_orders"))
def q_segment_share(spark, sf_dir):
    return ex.segment_share(seq.rfm_segmentation(rv_orders(spark, sf_dir, only=RFM_COLS)))
