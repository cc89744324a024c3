"""Registered cleaning queries (PRE-0..10) over rv_messy and rv_docs."""

from __future__ import annotations

from critiq.functions.num import sql_rnd as R
from critiq.functions.text import WS_CLASS, ZERO_WIDTH_CLASS
from critiq.operators import prep
from critiq.plans.registry import register
from critiq.sources.fixtures import rv_docs, rv_messy, with_views


def _dbl(x: str) -> str:
    v = f"TRY_CAST({x} AS DOUBLE)"
    return f"(CASE WHEN isnan({v}) OR isinf({v}) THEN NULL ELSE {v} END)"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def _clean(x: str) -> str:
    t = f"trim(regexp_replace(coalesce({x}, ''), '{WS_CLASS}+', ' ', 'g'))"
    return f"regexp_replace({t}, '{ZERO_WIDTH_CLASS}', '', 'g')"


def _ext(x: str, key: str) -> str:
    return f"TRY_CAST(NULLIF(regexp_extract({x}, '{key}(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE)"


def _sub(name: str) -> str:
    key = prep.SUBSCORE_KEYS[name]
    return (f"CASE WHEN coalesce(contains(score_text, 'stars:'), false) THEN {_ext('score_text', 'stars:')} "
            f"ELSE {_ext('score_text', key)} END AS {name}")


LABEL_FROM_NAME = ("CASE sentiment WHEN 'positive' THEN 1.0e0 WHEN 'neutral' THEN 0.0e0 "
                   "WHEN 'negative' THEN -1.0e0 END")

MESSY_CTES = f""",
c1 AS (
  SELECT review_id, shop_id, shop_name, user_id,
    CASE WHEN {_dbl('review_score')} IS NULL THEN NULL
         ELSE least(greatest({_dbl('review_score')}, 1.0e0), 5.0e0) END AS review_score,
    score_text, review_content, dishes, images,
    coalesce(vip_status IN ('True', 'true', '1'), false) AS vip_status,
    TRY_CAST(review_time AS TIMESTAMP) AS review_time,
    coalesce({_dbl('sentiment_label')}, {LABEL_FROM_NAME}) AS sentiment_label,
    sentiment, {_dbl('like_count')} AS like_count
  FROM rv_messy),
c2 AS (SELECT *, {_sub('taste_score')}, {_sub('environment_score')}, {_sub('service_score')} FROM c1),
c3 AS (SELECT * REPLACE ({_clean('review_content')} AS review_content) FROM c2),
c4 AS (
  SELECT *, CAST(length(review_content) AS INTEGER) AS content_len,
    {_trim("coalesce(images, '')")} <> '' AS has_image,
    CAST(year(review_time) AS INTEGER) AS review_year, CAST(month(review_time) AS INTEGER) AS review_month,
    CAST(isodow(review_time) - 1 AS INTEGER) AS review_weekday, CAST(hour(review_time) AS INTEGER) AS review_hour,
    coalesce(isodow(review_time) IN (6, 7), false) AS is_weekend,
    CAST(len(list_filter(string_split(coalesce(dishes, ''), '|'), lambda x: {_trim('x')} <> '')) AS INTEGER) AS dish_count
  FROM c3),
c5 AS (SELECT *, content_len >= 20 AND coalesce(score_text, '') <> '' AS is_quality_review FROM c4),
m AS (SELECT coalesce({R('avg(taste_score)', 1)}, 0.0e0) AS mt, coalesce({R('avg(environment_score)', 1)}, 0.0e0) AS me,
             coalesce({R('avg(service_score)', 1)}, 0.0e0) AS ms FROM c5),
c6 AS (
  SELECT * EXCLUDE (mt, me, ms) REPLACE (
    coalesce(like_count, 0.0e0) AS like_count, coalesce(dishes, '') AS dishes, coalesce(images, '') AS images,
    coalesce(score_text, '') AS score_text, coalesce(taste_score, mt) AS taste_score,
    coalesce(environment_score, me) AS environment_score, coalesce(service_score, ms) AS service_score,
    CAST(coalesce(sentiment_label, 0.0e0) AS INTEGER) AS sentiment_label)
  FROM c5, m)"""

CLEAN_MESSY_SQL = with_views(MESSY_CTES + """
SELECT * FROM c6
WHERE length(review_content) >= 5 AND review_score BETWEEN 1.0e0 AND 5.0e0""", "rv_messy")


@register("clean_reviews", CLEAN_MESSY_SQL)
def q_clean_reviews(spark, sf_dir):
    return prep.preprocess(rv_messy(spark, sf_dir))


ASPECT_COUNT_SQL = ("CASE WHEN json_valid(absa_aspects) AND json_type(absa_aspects::JSON) = 'ARRAY' "
                    "THEN CAST(json_array_length(absa_aspects) AS INTEGER) ELSE 0 END")

CLEAN_DOCS_SQL = with_views(f""",
d1 AS (SELECT * REPLACE ({_clean('review_content')} AS review_content,
         CAST(coalesce(sentiment_label, 0) AS INTEGER) AS sentiment_label) FROM rv_docs),
d2 AS (SELECT * REPLACE (CAST(length(review_content) AS INTEGER) AS content_len),
         CAST(length(review_content) AS INTEGER) >= 20 AS is_quality_review,
         {ASPECT_COUNT_SQL} AS aspect_count FROM d1)
SELECT * REPLACE (substr(review_content, 1, 2000) AS review_content) FROM d2
WHERE length(review_content) >= 5 AND review_score BETWEEN 1.0e0 AND 5.0e0""", "rv_docs")


@register("clean_documents", CLEAN_DOCS_SQL)
def q_clean_documents(spark, sf_dir):
    return prep.preprocess(rv_docs(spark, sf_dir), max_content_len=2000, derive_label=False)   # PRE-10 with its cut


@register("derived_features", with_views(MESSY_CTES + "\nSELECT * FROM c5", "rv_messy"))
def q_derived_features(spark, sf_dir):
    d = prep.clean_text(prep.parse_score_text(prep.cast_types(rv_messy(spark, sf_dir))))
    return prep.add_derived(d)


@register("fill_missing", with_views(MESSY_CTES + "\nSELECT * FROM c6", "rv_messy"))
def q_fill_missing(spark, sf_dir):
    d = prep.clean_text(prep.parse_score_text(prep.cast_types(rv_messy(spark, sf_dir))))
    return prep.handle_missing(prep.add_derived(d))
