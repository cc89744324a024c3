"""Registered source-side queries: ETL, alignment, profile, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from critiq.functions.num import sql_rnd as R
from critiq.sources import etl, profile
from critiq.sources.fixtures import rv_docs, rv_orders, rv_raw, with_views
from critiq.sources.schema import STANDARD_COLUMNS, align_columns
from critiq.plans.registry import register

_DUCK_T = {"string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER",
           "timestamp": "TIMESTAMP"}


def _category_sql(c: str) -> str:
    x = f"coalesce({c}, '')"
    whens = " ".join(f"WHEN contains({x}, '{n}') THEN '{n}'" for n in etl.CATEGORY_PRIORITY)
    generic = ", ".join(f"'{g}'" for g in etl.GENERIC_CATEGORIES)
    rest = (f"list_filter(list_transform(string_split({x}, ','), lambda p: trim(p)), "
            f"lambda p: p NOT IN ({generic}))")
    return (f"(CASE WHEN {x} = '' THEN 'Restaurant' {whens} "
            f"ELSE coalesce({rest}[1], 'Restaurant') END)")


def _aspects_sql(text: str, sent: str) -> str:
    t = f"lower(coalesce({text}, ''))"
    items = []
    for a, kws in etl.ASPECT_KEYWORDS.items():
        hit = " OR ".join(f"contains({t}, '{k}')" for k in kws)
        items.append(f"CASE WHEN {hit} THEN '{{\"aspect\": \"{a}\", \"sentiment\": \"' || {sent} || '\"}}' END")
    return f"('[' || concat_ws(', ', {', '.join(items)}) || ']')"


_STARS = "(CASE WHEN stars_y IS NULL OR isnan(stars_y) OR stars_y = 0 THEN 3.0e0 ELSE stars_y END)"
_NAME = f"(CASE WHEN {_STARS} >= 4 THEN 'positive' WHEN {_STARS} = 3 THEN 'neutral' ELSE 'negative' END)"
_RID = ("md5(coalesce(business_id, '') || '|' || coalesce(user_id, '') || '|' || coalesce(date, ''))")

RAW_TO_REVIEWS_SQL = with_views(f"""
SELECT {_RID} AS review_id, business_id AS shop_id, name AS shop_name, 'web' AS platform,
  {_category_sql('categories')} AS category, city, state AS district, user_id,
  user_id AS username, 3 AS user_level, false AS vip_status, text AS review_content,
  {_STARS} AS review_score, 'stars:' || CAST({_STARS} AS VARCHAR) AS score_text,
  strftime(TRY_CAST(date AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS review_time,
  coalesce(useful, 0) AS like_count, coalesce(funny, 0) AS reply_count, 'dine-in' AS order_type,
  '' AS dishes, '' AS images,
  CASE WHEN {_STARS} >= 4 THEN 1 WHEN {_STARS} = 3 THEN 0 ELSE -1 END AS sentiment_label,
  {_NAME} AS sentiment, {_aspects_sql('text', _NAME)} AS absa_aspects,
  CAST(NULL AS VARCHAR) AS crawl_time
FROM rv_raw""", "rv_raw")


@register("raw_to_reviews", RAW_TO_REVIEWS_SQL)
def q_raw_to_reviews(spark, sf_dir):
    return etl.raw_to_reviews(rv_raw(spark, sf_dir))


SHOP_DIM_SQL = with_views(f""",
k AS (SELECT *, (coalesce(TRY_CAST(date AS TIMESTAMP), TIMESTAMP '9999-12-31 00:00:00'), {_RID}, name IS NULL, coalesce(name, ''), categories IS NULL, coalesce(categories, ''), city IS NULL, coalesce(city, ''), state IS NULL, coalesce(state, ''), address IS NULL, coalesce(address, ''), stars_x IS NULL, coalesce(stars_x, -1.0e0), review_count IS NULL, coalesce(review_count, -1)) AS o
      FROM rv_raw WHERE business_id IS NOT NULL),
g0 AS (SELECT business_id AS shop_id, arg_min(struct_pack(name, categories, city, state, address, stars_x, review_count), o) AS r
      FROM k GROUP BY business_id),
g AS (SELECT shop_id, r.name AS shop_name, r.categories AS categories, r.city AS city, r.state AS district,
        r.address AS address, r.stars_x AS stars_x, r.review_count AS review_count FROM g0
      )
SELECT shop_id, shop_name, 'web' AS platform, {_category_sql('categories')} AS category, city, district,
  address, 0 AS average_price, CASE WHEN stars_x IS NULL OR isnan(stars_x) THEN 0.0e0 ELSE stars_x END AS score,
  0.0e0 AS taste_score, 0.0e0 AS environment_score, 0.0e0 AS service_score,
  coalesce(review_count, 0) AS review_count, categories AS tags
FROM g""", "rv_raw")


@register("shop_dimension", SHOP_DIM_SQL)
def q_shop_dimension(spark, sf_dir):
    return etl.shop_dimension(rv_raw(spark, sf_dir))


def _align_sql() -> str:
    docs_cols = ["review_id", "shop_id", "shop_name", "platform", "review_content", "sentiment_label",
                 "sentiment", "review_score", "absa_aspects", "content_len"]
    std = [c for c, _ in STANDARD_COLUMNS]
    sel = [c if c in docs_cols else f"CAST(NULL AS {_DUCK_T[t]}) AS {c}" for c, t in STANDARD_COLUMNS]
    sel += [c for c in docs_cols if c not in std]
    return with_views("SELECT " + ", ".join(sel) + " FROM rv_docs", "rv_docs")


@register("aligned_documents", _align_sql())
def q_aligned_documents(spark, sf_dir):
    return align_columns(rv_docs(spark, sf_dir))


PROFILE_VALUES_SQL = with_views(f""",
n AS (SELECT count(*) AS n FROM rv_docs),
v AS (SELECT 'platform' AS "column", platform AS value, count(*) AS c FROM rv_docs WHERE platform IS NOT NULL GROUP BY 2
      UNION ALL
      SELECT 'sentiment', sentiment, count(*) FROM rv_docs WHERE sentiment IS NOT NULL GROUP BY 2)
SELECT "column", value, CAST(c AS BIGINT) AS count, {R('CAST(c AS DOUBLE) / n * 100.0e0', 1)} AS pct FROM v, n""", "rv_docs")


@register("profile_values", PROFILE_VALUES_SQL)
def q_profile_values(spark, sf_dir):
    return profile.value_shares(rv_docs(spark, sf_dir))


def _nulls_sql() -> str:
    cols = ["review_id", "shop_id", "shop_name", "platform", "review_content", "sentiment_label",
            "sentiment", "review_score", "absa_aspects", "content_len"]
    parts = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) - count({c}) AS nc, count(*) AS n FROM rv_docs"
        for i, c in enumerate(cols))
    return with_views(f""", p AS ({parts})
SELECT CAST(position AS INTEGER) AS position, "column", CAST(nc AS BIGINT) AS null_count,
       {R('CAST(nc AS DOUBLE) / n * 100.0e0', 1)} AS null_pct
FROM p WHERE nc > 0""", "rv_docs")


@register("profile_nulls", _nulls_sql())
def q_profile_nulls(spark, sf_dir):
    return profile.null_counts(rv_docs(spark, sf_dir))


PROFILE_SCORES_SQL = with_views(f"""
SELECT CAST(count(*) AS BIGINT) AS rows, 15 AS columns, {R('avg(review_score)', 2)} AS mean_score,
  {R('quantile_cont(review_score, 0.5)', 1)} AS median_score, {R('stddev_samp(review_score)', 2)} AS std_score
FROM rv_orders""", "rv_orders")


@register("profile_scores", PROFILE_SCORES_SQL)
def q_profile_scores(spark, sf_dir):
    return profile.score_stats(rv_orders(spark, sf_dir))


SAMPLE_SQL = with_views("""
SELECT review_id, shop_id, review_score FROM rv_orders ORDER BY md5(review_id), review_id LIMIT 500""", "rv_orders")


@register("md5_sample", SAMPLE_SQL)
def q_md5_sample(spark, sf_dir):
    from critiq.sources.readers import hash_sample
    return hash_sample(rv_orders(spark, sf_dir, only="review_id shop_id review_score"), "review_id", 500)


@register("category_of", with_views(f"""
SELECT categories, {_category_sql('categories')} AS category, CAST(count(*) AS BIGINT) AS count
FROM rv_raw GROUP BY 1, 2""", "rv_raw"))
def q_category_of(spark, sf_dir):
    from pyspark.sql import functions as F
    r = rv_raw(spark, sf_dir)
    return r.groupBy("categories", etl.category_of(F.col("categories")).alias("category")).agg(
        F.count(F.lit(1)).cast("long").alias("count"))


@register("weak_aspects", with_views(f"""
SELECT {_aspects_sql('text', _NAME)} AS absa_aspects, CAST(count(*) AS BIGINT) AS count
FROM rv_raw GROUP BY 1""", "rv_raw"))
def q_weak_aspects(spark, sf_dir):
    from pyspark.sql import functions as F
    r = rv_raw(spark, sf_dir)
    sy = F.col("stars_y")
    stars = F.when(sy.isNull() | F.isnan(sy) | (sy == 0), F.lit(etl.DEFAULT_STARS)).otherwise(sy)
    name, _ = etl.sentiment_of(stars)
    return r.groupBy(etl.weak_aspects(F.col("text"), name).alias("absa_aspects")).agg(
        F.count(F.lit(1)).cast("long").alias("count"))
