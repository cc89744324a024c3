"""Registered time-series queries."""

from __future__ import annotations

from critiq.functions.num import sql_rnd as R
from critiq.operators import sequential as seq
from critiq.plans.registry import register
from critiq.sources.fixtures import RFM_COLS, TREND_COLS, rv_events, rv_orders, with_views


@register("hourly_pattern", with_views("""
SELECT CAST(hour(review_time) AS INTEGER) AS review_hour, CAST(count(review_id) AS BIGINT) AS count
FROM rv_events WHERE review_time IS NOT NULL GROUP BY 1""", "rv_events"))
def q_hourly(spark, sf_dir):
    return seq.hourly_pattern(rv_events(spark, sf_dir))


MONTHLY = """
SELECT strftime(review_time, '%Y-%m') AS year_month, CAST(count(review_id) AS BIGINT) AS count,
       avg(review_score) AS avg_score
FROM {v} WHERE review_time IS NOT NULL GROUP BY 1"""


@register("monthly_trend", with_views(MONTHLY.format(v="rv_orders"), "rv_orders"))
def q_monthly(spark, sf_dir):
    return seq.monthly_trend(rv_orders(spark, sf_dir, only=TREND_COLS))


def burst_sql(view: str, window: int = 7, threshold: float = 2.0) -> str:
    return with_views(f""",
daily AS (SELECT strftime(review_time, '%Y-%m-%d') AS date, CAST(count(review_id) AS BIGINT) AS total,
            CAST(sum(CASE WHEN sentiment_label = -1 THEN 1 ELSE 0 END) AS BIGINT) AS neg
          FROM {view} WHERE review_time IS NOT NULL GROUP BY 1),
r AS (SELECT *, CAST(neg AS DOUBLE) / CAST(total AS DOUBLE) AS neg_rate FROM daily),
w AS (SELECT *, avg(neg_rate) OVER win AS m, coalesce(stddev_samp(neg_rate) OVER win, 0.01e0) AS sd
      FROM r WINDOW win AS (ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)),
z AS (SELECT date, total, neg, neg_rate,
        CASE WHEN sd = 0 THEN NULL ELSE {R('(neg_rate - m) / sd', 2)} END AS z_score FROM w)
SELECT *, coalesce(z_score >= {float(threshold)!r}e0, false) AS alert FROM z""", view)


@register("burst_detection", burst_sql("rv_orders"))
def q_burst(spark, sf_dir):
    return seq.burst_detection(rv_orders(spark, sf_dir, only=TREND_COLS))


@register("burst_detection_events", burst_sql("rv_events"))
def q_burst_events(spark, sf_dir):
    return seq.burst_detection(rv_events(spark, sf_dir))


@register("burst_days", burst_sql("rv_orders").replace(
    "SELECT *, coalesce(z_score >= 2.0e0, false) AS alert FROM z",
    "SELECT *, true AS alert FROM z WHERE coalesce(z_score >= 2.0e0, false)"))
def q_burst_days(spark, sf_dir):
    b = seq.burst_detection(rv_orders(spark, sf_dir, only=TREND_COLS))
    return b.where("alert")


def cma_sql(view: str) -> str:
    return f""",
m AS ({MONTHLY.format(v=view).strip()}),
c AS (SELECT *, CASE WHEN count(*) OVER w >= 6 THEN avg(CAST(count AS DOUBLE)) OVER w END AS trend,
             avg(CAST(count AS DOUBLE)) OVER () AS mc
      FROM m WINDOW w AS (ORDER BY year_month ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)),
c2 AS (SELECT year_month, count, avg_score, trend, count - coalesce(trend, mc) AS seasonal,
              0.0e0 AS residual, 'CMA-12' AS method FROM c)"""


@register("cma_decomposition", with_views(cma_sql("rv_orders") + "\nSELECT * FROM c2", "rv_orders"))
def q_cma(spark, sf_dir):
    return seq.trend_decomposition(rv_orders(spark, sf_dir, only=TREND_COLS), method="cma")


@register("cma_decomposition_events", with_views(cma_sql("rv_events") + "\nSELECT * FROM c2", "rv_events"))
def q_cma_events(spark, sf_dir):
    return seq.trend_decomposition(rv_events(spark, sf_dir), method="auto")


FORECAST = f""",
d AS (SELECT *, CAST(row_number() OVER (ORDER BY year_month) - 1 AS DOUBLE) AS t FROM c2 WHERE trend IS NOT NULL),
f AS (SELECT count(*) AS n, regr_slope(trend, t) AS b, regr_intercept(trend, t) AS a,
             max(year_month) AS last, arg_max(method, year_month) AS meth FROM d HAVING count(*) >= 6),
s AS (SELECT f.*, CAST(i AS BIGINT) AS i FROM f, range(1, 7) r(i))
SELECT year_month, count, avg_score, trend, seasonal, residual, method, 'actual' AS type FROM d
UNION ALL
SELECT strftime(CAST(last || '-01' AS DATE) + to_months(CAST(i AS INTEGER)), '%Y-%m') AS year_month,
       CAST(round_even(greatest(a + b * CAST(n + i - 1 AS DOUBLE), 0.0e0), 0) AS BIGINT) AS count,
       CAST(NULL AS DOUBLE) AS avg_score, {R('a + b * CAST(n + i - 1 AS DOUBLE)', 6)} AS trend,
       0.0e0 AS seasonal, 0.0e0 AS residual, meth AS method, 'forecast' AS type FROM s"""


@register("trend_forecast", with_views(cma_sql("rv_orders") + FORECAST, "rv_orders"))
def q_forecast(spark, sf_dir):
    d = seq.trend_decomposition(rv_orders(spark, sf_dir, only=TREND_COLS), method="cma")
    return seq.forecast_trend(d, steps=6)


@register("stl_decomposition")
def q_stl(spark, sf_dir):
    return seq.trend_decomposition(rv_orders(spark, sf_dir, only=TREND_COLS))


@register("stl_by_city")
def q_stl_city(spark, sf_dir):
    return seq.trend_decomposition(rv_orders(spark, sf_dir, only=TREND_COLS + " city"), key="city")


@register("stl_forecast")
def q_stl_forecast(spark, sf_dir):
    return seq.forecast_trend(seq.trend_decomposition(rv_orders(spark, sf_dir, only=TREND_COLS)), steps=6)


def _qscore(x: str, e: str, reverse: bool) -> str:
    idx = (f"CASE WHEN {x} <= {e}[2] THEN 0 WHEN {x} <= {e}[3] THEN 1 "
           f"WHEN {x} <= {e}[4] THEN 2 WHEN {x} <= {e}[5] THEN 3 END")
    sc = f"(4 - ({idx}))" if reverse else f"(({idx}) + 1)"
    dist = f"({e}[1] < {e}[2] AND {e}[2] < {e}[3] AND {e}[3] < {e}[4] AND {e}[4] < {e}[5])"
    return f"(CASE WHEN {dist} THEN CAST({sc} AS DOUBLE) ELSE 2.0e0 END)"


def rfm_sql(view: str) -> str:
    q = "[0.0, 0.25, 0.5, 0.75, 1.0]"
    return f""",
ref AS (SELECT max(review_time) AS ref FROM {view} WHERE review_time IS NOT NULL),
g AS (SELECT user_id, CAST(date_sub('day', max(review_time), min(ref)) AS BIGINT) AS R,
             CAST(count(review_id) AS BIGINT) AS F, avg(review_score) AS M
      FROM {view}, ref WHERE review_time IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id),
e AS (SELECT quantile_cont(CAST(R AS DOUBLE), {q}) AS eR, quantile_cont(CAST(F AS DOUBLE), {q}) AS eF,
             quantile_cont(M, {q}) AS eM FROM g),
s AS (SELECT user_id, R, F, M, {_qscore('CAST(R AS DOUBLE)', 'eR', True)} AS R_score,
             {_qscore('CAST(F AS DOUBLE)', 'eF', False)} AS F_score, {_qscore('M', 'eM', False)} AS M_score
      FROM g, e),
t AS (SELECT *, R_score + F_score + M_score AS rfm_total FROM s),
rfm AS (SELECT user_id, R, F, {R('M', 2)} AS M, R_score, F_score, M_score, rfm_total,
        CASE WHEN R_score >= 3 AND F_score >= 3 THEN 'Champions' WHEN R_score >= 3 THEN 'Recent Users'
             WHEN F_score >= 3 THEN 'Loyal Users' WHEN rfm_total >= 8 THEN 'Potential' ELSE 'At Risk' END AS segment
        FROM t)"""


@register("rfm_rule", with_views(rfm_sql("rv_orders") + "\nSELECT * FROM rfm", "rv_orders"))
def q_rfm(spark, sf_dir):
    return seq.rfm_segmentation(rv_orders(spark, sf_dir, only=RFM_COLS))


@register("rfm_rule_collapsed", with_views(rfm_sql("rv_events") + "\nSELECT * FROM rfm", "rv_events"))
def q_rfm_events(spark, sf_dir):
    return seq.rfm_segmentation(rv_events(spark, sf_dir))


@register("rfm_segment_means", with_views(rfm_sql("rv_orders") + f"""
SELECT segment, CAST(count(user_id) AS BIGINT) AS user_count, {R('avg(R_score)', 2)} AS avg_R_score,
       {R('avg(F_score)', 2)} AS avg_F_score, {R('avg(M_score)', 2)} AS avg_M_score
FROM rfm GROUP BY segment""", "rv_orders"))
def q_rfm_means(spark, sf_dir):
    return seq.rfm_segment_means(seq.rfm_segmentation(rv_orders(spark, sf_dir, only=RFM_COLS)))
