"""Cleaning: casts, packed sub-scores, text cleanup, derived columns,
missing values and row filters.

Every step is a narrow projection or filter except the fill of sub-score
means, which is one global aggregate joined back by broadcast (one row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critiq.functions.num import clip, rnd, to_double, with_scalars
from critiq.functions.text import clean_text as _clean, has_text
from critiq.operators.common import has

# Sentiment names and labels; keys of the packed sub-scores.
SENTIMENT_MAP = {"positive": 1, "neutral": 0, "negative": -1}
STARS_KEY = "stars:"
SUBSCORE_KEYS = {"taste_score": "口味", "environment_score": "环境", "service_score": "服务"}
NUM_PATTERN = r"(\d+(?:\.\d+)?)"
FILL_ZERO = ["like_count", "reply_count", "user_level", "aspect_count", "dish_count"]
FILL_EMPTY = ["username", "order_type", "dishes", "images", "score_text", "business_reply"]
FILL_MEAN = ["taste_score", "environment_score", "service_score"]


def to_timestamp(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.col(c)        # NTZ kept: no session-time-zone dependence
    if isinstance(dt, T.DateType):
        return F.col(c).cast("timestamp_ntz")
    return F.col(c).cast("string").try_cast("timestamp_ntz")


def to_bool(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.BooleanType):
        return F.coalesce(F.col(c), F.lit(False))
    if isinstance(dt, T.NumericType):
        return F.coalesce(F.col(c) == 1, F.lit(False))
    return F.coalesce(F.col(c).isin("True", "true", "1"), F.lit(False))


def label_from_sentiment(c: Column) -> Column:
    out = None
    for k, v in SENTIMENT_MAP.items():
        out = F.when(c == k, F.lit(float(v))) if out is None else out.when(c == k, F.lit(float(v)))
    return out


# ------------------------------------------------------------------ PRE-1/2
def cast_types(df: DataFrame, derive_label: bool = True) -> DataFrame:
    """Lenient casts; out-of-range scores are moved to 1 or 5 (nulls stay)."""
    out = {}
    for c in ["review_score", "like_count", "reply_count", "user_level"]:
        if has(df, c):
            out[c] = to_double(c)
    if "review_score" in out:
        out["review_score"] = clip(out["review_score"], 1.0, 5.0)
    if has(df, "vip_status"):
        out["vip_status"] = to_bool(df, "vip_status")
    for c in ["review_time", "crawl_time"]:
        if has(df, c):
            out[c] = to_timestamp(df, c)
    if has(df, "sentiment_label"):
        lab = to_double("sentiment_label")
        if derive_label and has(df, "sentiment"):
            lab = F.coalesce(lab, label_from_sentiment(F.col("sentiment")))
        out["sentiment_label"] = lab
    elif has(df, "sentiment"):
        out["sentiment_label"] = label_from_sentiment(F.col("sentiment"))
    return df.withColumns(out)


# ------------------------------------------------------------------ PRE-3
def _extract(c: Column, key: str) -> Column:
    v = F.regexp_extract(c, key + NUM_PATTERN, 1)
    return F.nullif(v, F.lit("")).try_cast("double")


def parse_score_text(df: DataFrame) -> DataFrame:
    """``stars:x`` fills all three sub-scores; otherwise three keyed numbers.
    The format is decided per row."""
    if not has(df, "score_text"):
        return df
    st = F.col("score_text")
    is_stars = F.coalesce(st.contains(STARS_KEY), F.lit(False))
    stars = _extract(st, STARS_KEY)
    return df.withColumns({
        name: F.when(is_stars, stars).otherwise(_extract(st, key))
        for name, key in SUBSCORE_KEYS.items()})


# ------------------------------------------------------------------ PRE-4
def clean_text(df: DataFrame) -> DataFrame:
    """The cleaned text is generated (a one-element explode) and not just
    projected: a later filter on it, such as the shortest length, is then not
    pushed below and does not run the whole clean-up a second time."""
    if not has(df, "review_content"):
        return df
    return df.withColumn("review_content", F.explode(F.array(_clean(F.col("review_content")))))


# ------------------------------------------------------------------ PRE-5..8
def aspect_count(c: Column) -> Column:
    """Length of a JSON array; 0 for null, empty, bad JSON or non-arrays."""
    return F.coalesce(F.when(F.trim(c).startswith("["), F.json_array_length(c)), F.lit(0))


def add_derived(df: DataFrame) -> DataFrame:
    out: dict[str, Column] = {}
    if has(df, "review_content"):
        out["content_len"] = F.length("review_content")
    if has(df, "images"):
        out["has_image"] = has_text(F.col("images"))
    if has(df, "review_time") and isinstance(df.schema["review_time"].dataType, (T.TimestampType, T.TimestampNTZType)):
        t = F.col("review_time")
        out.update(review_year=F.year(t), review_month=F.month(t),
                   review_weekday=F.weekday(t), review_hour=F.hour(t),
                   is_weekend=F.coalesce(F.weekday(t).isin(5, 6), F.lit(False)))
    if has(df, "dishes"):
        parts = F.split(F.coalesce(F.col("dishes"), F.lit("")), r"\|")
        out["dish_count"] = F.size(F.filter(parts, lambda x: has_text(x)))
    df = df.withColumns(out)
    q = F.lit(True)
    if has(df, "content_len"):
        q = q & (F.col("content_len") >= 20)
    if has(df, "score_text"):
        q = q & (F.coalesce(F.col("score_text"), F.lit("")) != "")
    df = df.withColumn("is_quality_review", q)
    if has(df, "absa_aspects"):
        df = df.withColumn("aspect_count", aspect_count(F.col("absa_aspects")))
    return df


# ------------------------------------------------------------------ PRE-9
def handle_missing(df: DataFrame) -> DataFrame:
    """Zeros, empty strings, sub-score means rounded to 1 digit, label 0."""
    fills: dict[str, Column] = {}
    for c in FILL_ZERO:
        if has(df, c):
            fills[c] = F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType))
    for c in FILL_EMPTY:
        if has(df, c):
            fills[c] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    df = df.withColumns(fills) if fills else df
    means = [c for c in FILL_MEAN if has(df, c)]
    if means:
        stats = df.agg(*[F.coalesce(rnd(F.avg(c), 1), F.lit(0.0)).alias(f"_m_{c}") for c in means])
        df = with_scalars(df, stats)
        df = df.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in means})
        df = df.drop(*[f"_m_{c}" for c in means])
    if has(df, "sentiment_label"):
        df = df.withColumn("sentiment_label", F.coalesce(F.col("sentiment_label"), F.lit(0.0)).cast("int"))
    return df


# ------------------------------------------------------------------ PRE-10
def filter_outliers(df: DataFrame, min_len: int = 5, max_len: int | None = None) -> DataFrame:
    """Drop short texts and scores outside [1, 5]; ``max_len`` cuts longer texts."""
    if has(df, "review_content"):
        df = df.where(F.length("review_content") >= min_len)
        if max_len is not None:
            df = df.withColumn("review_content", F.substring("review_content", 1, max_len))
    if has(df, "review_score"):
        df = df.where(F.col("review_score").between(1.0, 5.0))
    return df


# ------------------------------------------------------------------ PRE-0
def preprocess(df: DataFrame, min_content_len: int = 5, max_content_len: int | None = None,
               derive_label: bool = True) -> DataFrame:
    """cast -> parse -> clean -> derive -> fill -> filter (order matters:
    the length is taken before the cut, the fill before the filter)."""
    return (df.transform(lambda d: cast_types(d, derive_label))
              .transform(parse_score_text)
              .transform(clean_text)
              .transform(add_derived)
              .transform(handle_missing)
              .transform(lambda d: filter_outliers(d, min_content_len, max_content_len)))
