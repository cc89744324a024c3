"""Registered ranking / summary queries over the review views."""

from __future__ import annotations

from critiq.functions.num import sql_rnd as R
from critiq.operators import tabular as tab
from critiq.plans.registry import register
from critiq.sources.fixtures import ALERT_COLS, rv_events, rv_orders, with_views

Z = tab.WILSON_Z
Z2 = f"{Z * Z!r}e0"
ZL = f"{Z!r}e0"


def _first(c: str, by_id: bool = True) -> str:
    order = "(review_time, review_id)" if by_id else "review_time"
    return f"arg_min({c}, ({order}, {c})) FILTER (WHERE {c} IS NOT NULL)"


def _shop_stats_sql(view: str, extras: list[str], min_reviews: int, by_id: bool = True) -> str:
    ex = "".join(f", {_first(c, by_id)} AS {c}" for c in extras)
    return f"""
g AS (
  SELECT shop_id, shop_name, CAST(count(review_id) AS BIGINT) AS review_count,
         avg(review_score) AS avg_score{ex},
         CAST(sum(CASE WHEN sentiment_label = -1 THEN 1 ELSE 0 END) AS BIGINT) AS neg_count
  FROM {view} WHERE shop_id IS NOT NULL AND shop_name IS NOT NULL
  GROUP BY shop_id, shop_name HAVING count(review_id) >= {min_reviews}),
mu AS (SELECT avg(review_score) AS mu FROM {view}),
b AS (
  SELECT g.*, {R('(mu * 30.0e0 + avg_score * CAST(review_count AS DOUBLE)) / (30.0e0 + CAST(review_count AS DOUBLE))', 3)} AS bayes_score,
         {R('CAST(neg_count AS DOUBLE) / CAST(review_count AS DOUBLE) * 100.0e0', 1)} AS neg_rate
  FROM g, mu)"""


def bayes_sql(view: str, min_reviews: int = 5, by_id: bool = True) -> str:
    """``by_id`` False: for queries that show no attribute that can differ between a shop's reviews."""
    return with_views(f""", {_shop_stats_sql(view, ['city', 'district', 'category'], min_reviews, by_id).strip()}
SELECT *, CAST(dense_rank() OVER (ORDER BY bayes_score DESC) AS INTEGER) AS bayes_rank FROM b""", view).replace("\n, ", ",\n", 1)


def _clip(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest(({x}), 0.0e0), 1.0e0) END)"


def wilson_sql(view: str, min_reviews: int = 5, extras: tuple = ("city", "category"), by_id: bool = True) -> str:
    n = "CAST(review_count AS DOUBLE)"
    p = _clip("(avg_score - 1.0e0) / 4.0e0")
    ex = "".join(f"{c}, " for c in extras)
    body = f""", {_shop_stats_sql(view, list(extras), min_reviews, by_id).strip()},
w0 AS (SELECT b.*, {p} AS p FROM b),
w1 AS (
  SELECT w0.*, {_clip(f'((p + {Z2} / (2.0e0 * {n})) - ({ZL} * sqrt(p * (1.0e0 - p) / {n} + {Z2} / (4.0e0 * {n} * {n})))) / (1.0e0 + {Z2} / {n})')} AS lower_b
  FROM w0),
w2 AS (
  SELECT w1.*, {R('lower_b', 4)} AS wilson_lower, {R('lower_b * 4.0e0 + 1.0e0', 3)} AS wilson_score FROM w1),
w3 AS (
  SELECT w2.*, CAST(dense_rank() OVER (ORDER BY wilson_score DESC) AS INTEGER) AS wilson_rank,
         CAST(dense_rank() OVER (ORDER BY bayes_score DESC) AS INTEGER) AS bayes_rank FROM w2)
SELECT shop_id, shop_name, review_count, avg_score, {ex}wilson_lower, wilson_score,
       wilson_rank, bayes_score, bayes_rank, neg_rate,
       CAST(coalesce(bayes_rank - wilson_rank, 0) AS INTEGER) AS rank_drift
FROM w3"""
    return with_views(body, view).replace("\n, ", ",\n", 1)


@register("bayesian_ranking", bayes_sql("rv_orders"))
def q_bayesian_ranking(spark, sf_dir):
    return tab.bayesian_ranking(rv_orders(spark, sf_dir, only=ALERT_COLS + " city district category"), min_reviews=5)


@register("wilson_ranking", wilson_sql("rv_orders"))
def q_wilson_ranking(spark, sf_dir):
    return tab.wilson_ranking(rv_orders(spark, sf_dir, only=ALERT_COLS + " city category"), min_reviews=5)


@register("wilson_ranking_events", wilson_sql("rv_events", extras=()))
def q_wilson_ranking_events(spark, sf_dir):
    return tab.wilson_ranking(rv_events(spark, sf_dir), min_reviews=5)


# FIG-1: rank drift of all ranked shops (min 10 reviews), 20 bins.
def _drift_hist_sql() -> str:
    w = wilson_sql("rv_orders", 10, by_id=False)
    head, tail = w.rsplit("SELECT shop_id, shop_name, review_count", 1)
    body = head.rstrip() + ",\nwr AS (SELECT shop_id, shop_name, review_count" + tail + """),
top AS (SELECT * FROM wr),
mm AS (SELECT min(rank_drift) AS lo, max(rank_drift) AS hi,
              quantile_cont(abs(rank_drift), 0.9) AS p90 FROM top)
SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(floor((rank_drift - lo) * 20.0e0 / (hi - lo)) + 1, 20) END AS INTEGER) AS bin,
       CAST(count(*) AS BIGINT) AS shop_count, min(p90) AS p90_abs_drift
FROM top, mm GROUP BY 1"""
    return body


@register("rank_drift_hist", _drift_hist_sql())
def q_rank_drift_hist(spark, sf_dir):
    from critiq.operators.explore import drift_histogram
    return drift_histogram(tab.wilson_ranking(rv_orders(spark, sf_dir, only=ALERT_COLS + " city category"), min_reviews=10), bins=20)


EDA_SQL = """
SELECT metric, value FROM (
  SELECT CAST(count(*) AS DOUBLE) AS reviews, CAST(count(DISTINCT shop_id) AS DOUBLE) AS shops,
         CAST(count(DISTINCT user_id) AS DOUBLE) AS users, CAST(count(DISTINCT city) AS DOUBLE) AS cities,
         {ms} AS mean_score, {sd} AS score_std,
         CAST(sum(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END) AS DOUBLE) AS positive_reviews,
         CAST(sum(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) AS DOUBLE) AS negative_reviews,
         {ml} AS mean_length
  FROM rv_orders) UNPIVOT (value FOR metric IN (reviews, shops, users, cities, mean_score, score_std,
         positive_reviews, negative_reviews, mean_length))""".format(
    ms=R("avg(review_score)", 3), sd=R("stddev_samp(review_score)", 3), ml=R("avg(CAST(content_len AS DOUBLE))", 1))


@register("eda_summary", with_views(EDA_SQL, "rv_orders"))
def q_eda_summary(spark, sf_dir):
    return tab.eda_summary(rv_orders(spark, sf_dir, only="shop_id user_id city review_score sentiment content_len"))


def _corr_sql(view: str, cols: list[str]) -> str:
    sel, parts = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            a2 = f"CASE WHEN {b} IS NULL THEN NULL ELSE CAST({a} AS DOUBLE) END"
            b2 = f"CASE WHEN {a} IS NULL THEN NULL ELSE CAST({b} AS DOUBLE) END"
            r = (f"CASE WHEN stddev_samp({a2}) * stddev_samp({b2}) = 0 THEN NULL ELSE "
                 f"covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / (stddev_samp({a2}) * stddev_samp({b2})) END")
            nm = f"c{i}_{cols.index(b)}"
            sel.append(f"{R(r, 3)} AS {nm}")
            parts.append(f"SELECT '{a}' AS row, '{b}' AS col, {nm} AS r FROM one")
            if a != b:
                parts.append(f"SELECT '{b}' AS row, '{a}' AS col, {nm} AS r FROM one")
    return f", one AS (SELECT {', '.join(sel)} FROM {view})\n" + "\nUNION ALL ".join(parts)


CORR_COLS = ["review_score", "like_count", "reply_count", "content_len", "sentiment_label", "aspect_count"]


@register("correlation", with_views(_corr_sql("rv_orders", CORR_COLS), "rv_orders").replace("\n, one", ",\none", 1))
def q_correlation(spark, sf_dir):
    return tab.correlation(rv_orders(spark, sf_dir, only=" ".join(CORR_COLS)), CORR_COLS)
