"""Registered alert queries."""

from __future__ import annotations

from critiq.functions.num import sql_rnd as R
from critiq.operators import alerts as al
from critiq.plans.registry import register
from critiq.sources.fixtures import ALERT_COLS, rv_events, rv_orders, with_views


def alerts_sql(view: str) -> str:
    cols = []
    for lvl, days, _, _ in al.ALERT_LEVELS:
        inside = f"review_time >= ref - INTERVAL {days} DAY"
        cols.append(f"sum(CASE WHEN {inside} THEN 1 ELSE 0 END) AS n_{lvl}")
        cols.append(f"sum(CASE WHEN {inside} AND sentiment_label = -1 THEN 1 ELSE 0 END) AS x_{lvl}")
    fire = {lvl: f"(n_{lvl} >= 2 AND CAST(x_{lvl} AS DOUBLE) / CAST(n_{lvl} AS DOUBLE) >= {thr!r}e0)"
            for lvl, _, thr, _ in al.ALERT_LEVELS}
    lvl_case = "CASE " + " ".join(f"WHEN {fire[l]} THEN '{n}'" for l, _, _, n in al.ALERT_LEVELS) + " END"
    rate_case = "CASE " + " ".join(f"WHEN {fire[l]} THEN CAST(x_{l} AS DOUBLE) / CAST(n_{l} AS DOUBLE)"
                                   for l, _, _, _ in al.ALERT_LEVELS) + " END"
    days_case = "CASE " + " ".join(f"WHEN {fire[l]} THEN {d}" for l, d, _, _ in al.ALERT_LEVELS) + " END"
    sev_case = "CASE " + " ".join(f"WHEN {fire[l]} THEN {i}" for i, (l, _, _, _) in enumerate(al.ALERT_LEVELS)) + " END"
    act_case = "CASE " + " ".join(f"WHEN level = '{n}' THEN '{al.ALERT_ACTIONS[l]}'"
                                  for l, _, _, n in al.ALERT_LEVELS) + " END"
    return with_views(f""",
ref AS (SELECT max(review_time) AS ref FROM {view} WHERE review_time IS NOT NULL),
g AS (SELECT shop_id, count(*) AS n,
        arg_min(shop_name, (review_time, shop_name)) FILTER (WHERE shop_name IS NOT NULL) AS shop_name,
        avg(review_score) AS score, {', '.join(cols)}
      FROM {view}, ref WHERE review_time IS NOT NULL AND shop_id IS NOT NULL GROUP BY shop_id HAVING count(*) >= 3),
l AS (SELECT shop_id, shop_name, score, {lvl_case} AS level, {rate_case} AS rate, {days_case} AS days,
             CAST({sev_case} AS INTEGER) AS severity FROM g),
alerts AS (
  SELECT level, shop_id, shop_name, {R('score', 2)} AS score, {R('rate * 100.0e0', 1)} AS neg_rate,
    CAST(days AS VARCHAR) || 'd negative rate ' || CAST(CAST(round_even(rate * 100.0e0, 0) AS BIGINT) AS VARCHAR) || '% >= threshold' AS message,
    {act_case} AS action, severity
  FROM l WHERE level IS NOT NULL)""", view)


@register("alerts", alerts_sql("rv_orders") + "\nSELECT * FROM alerts")
def q_alerts(spark, sf_dir):
    return al.alerts(rv_orders(spark, sf_dir, only=ALERT_COLS))


@register("alerts_events", alerts_sql("rv_events") + "\nSELECT * FROM alerts")
def q_alerts_events(spark, sf_dir):
    return al.alerts(rv_events(spark, sf_dir))


@register("alert_levels", alerts_sql("rv_orders") +
          "\nSELECT level, CAST(count(*) AS BIGINT) AS shop_count FROM alerts GROUP BY level")
def q_alert_levels(spark, sf_dir):
    return al.alert_levels(al.alerts(rv_orders(spark, sf_dir, only=ALERT_COLS)))


@register("alert_histogram", alerts_sql("rv_events") + """,
mm AS (SELECT min(neg_rate) AS lo, max(neg_rate) AS hi FROM alerts)
SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((neg_rate - lo) * 20.0e0 / (hi - lo)) + 1, 20) END AS INTEGER) AS bin,
       CAST(count(*) AS BIGINT) AS shop_count, min(neg_rate) AS min_rate, max(neg_rate) AS max_rate
FROM alerts, mm GROUP BY 1""")
def q_alert_histogram(spark, sf_dir):
    return al.alert_histogram(al.alerts(rv_events(spark, sf_dir)))
