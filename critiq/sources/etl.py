"""Raw provider rows -> standard reviews and a shop dimension.

One projection per row (no Python loop), plus one aggregation on the shop
key for the dimension table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.functions.num import to_double

from critiq.sources.schema import SHOP_COLUMNS

# Category names tested as substrings, in priority order.
CATEGORY_PRIORITY = ["Pizza", "Sushi", "Chinese", "Mexican", "Italian", "Burgers", "Seafood",
                     "Thai", "Indian", "Japanese", "Korean", "American", "Mediterranean",
                     "Sandwiches", "Breakfast", "Coffee", "Bakeries", "Fast Food", "Bar"]
# Generic category parts that are skipped.
GENERIC_CATEGORIES = ["Restaurants", "Food", "Nightlife"]
DEFAULT_CATEGORY = "Restaurant"
# Weak aspect keywords (lower-case substrings), in output order.
ASPECT_KEYWORDS = {
    "food": ["food", "taste", "flavor", "delicious", "bland", "fresh", "stale", "portion", "dish"],
    "service": ["service", "staff", "waiter", "waitress", "server", "rude", "friendly", "slow"],
    "ambiance": ["ambiance", "atmosphere", "decor", "noise", "clean", "dirty", "cozy", "crowded"],
    "price": ["price", "expensive", "cheap", "value", "overpriced", "affordable", "worth", "bill"],
    "location": ["location", "parking", "convenient", "far", "close", "accessible"],
}
DEFAULT_STARS = 3.0
FAR_FUTURE = "9999-12-31 00:00:00"


def sentiment_of(stars: Column) -> tuple[Column, Column]:
    """>= 4 positive / 1, exactly 3 neutral / 0, everything else negative / -1."""
    label = F.when(stars >= 4, F.lit(1)).when(stars == 3, F.lit(0)).otherwise(F.lit(-1))
    name = F.when(stars >= 4, F.lit("positive")).when(stars == 3, F.lit("neutral")).otherwise(F.lit("negative"))
    return name, label


def category_of(categories: Column) -> Column:
    """First priority name contained in the text; else the first comma part
    that is not generic; else the default.  Null and empty give the default."""
    c = F.coalesce(categories, F.lit(""))
    pick = None
    for name in CATEGORY_PRIORITY:
        cond = c.contains(name)
        pick = F.when(cond, F.lit(name)) if pick is None else pick.when(cond, F.lit(name))
    parts = F.transform(F.split(c, ","), lambda p: F.trim(p))
    rest = F.filter(parts, lambda p: ~p.isin(*GENERIC_CATEGORIES))
    fallback = F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit(DEFAULT_CATEGORY))
    return F.when(c == "", F.lit(DEFAULT_CATEGORY)).otherwise(pick.otherwise(fallback))


def weak_aspects(text: Column, sentiment: Column) -> Column:
    """JSON list of {aspect, sentiment} for every aspect with a keyword
    substring in the lower-cased text, formatted as a JSON writer with
    ', ' and ': ' separators would."""
    t = F.lower(F.coalesce(text, F.lit("")))
    items = []
    for aspect, kws in ASPECT_KEYWORDS.items():
        hit = None
        for k in kws:
            hit = t.contains(k) if hit is None else (hit | t.contains(k))
        obj = F.concat(F.lit('{"aspect": "' + aspect + '", "sentiment": "'), sentiment, F.lit('"}'))
        items.append(F.when(hit, obj))
    return F.concat(F.lit("["), F.concat_ws(", ", *items), F.lit("]"))


def review_key() -> Column:
    """md5 of shop, user and date with separators; nulls count as empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("business_id", "user_id", "date")]))


def raw_to_reviews(raw: DataFrame, platform: str = "web", name_chars: int | None = None) -> DataFrame:
    """Provider rows (business_id, name, city, state, categories, text, date,
    user_id, stars_y, useful, funny, ...) -> standard review rows.

    Null, unparseable, NaN or zero stars become 3; an unparseable date becomes
    null, an unparseable count 0.  ``name_chars`` shortens the user name.
    """
    sy = to_double("stars_y")
    stars = F.when(sy.isNull() | (sy == 0), F.lit(DEFAULT_STARS)).otherwise(sy)
    name, label = sentiment_of(stars)
    ts = F.col("date").cast("string").try_cast("timestamp_ntz")
    rid = review_key()
    return raw.select(
        rid.alias("review_id"),
        F.col("business_id").cast("string").alias("shop_id"),
        F.col("name").alias("shop_name"),
        F.lit(platform).alias("platform"),
        category_of(F.col("categories")).alias("category"),
        F.col("city"), F.col("state").alias("district"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("user_id").cast("string") if name_chars is None
         else F.substring(F.col("user_id").cast("string"), 1, name_chars)).alias("username"),
        F.lit(3).alias("user_level"), F.lit(False).alias("vip_status"),
        F.col("text").alias("review_content"),
        stars.alias("review_score"),
        F.concat(F.lit("stars:"), stars.cast("string")).alias("score_text"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("review_time"),
        F.coalesce(F.col("useful").try_cast("int"), F.lit(0)).alias("like_count"),
        F.coalesce(F.col("funny").try_cast("int"), F.lit(0)).alias("reply_count"),
        F.lit("dine-in").alias("order_type"), F.lit("").alias("dishes"), F.lit("").alias("images"),
        label.alias("sentiment_label"), name.alias("sentiment"),
        weak_aspects(F.col("text"), name).alias("absa_aspects"),
        F.lit(None).cast("string").alias("crawl_time"),
    )


def shop_dimension(raw: DataFrame, platform: str = "web", tag_chars: int | None = None) -> DataFrame:
    """One row per business id: the attributes of its first review by (time,
    review id), then the least attributes.  The earliest time of a shop, a
    number, comes from a hash aggregate; the pick is made among its reviews of
    that time, and merged before the shuffle, so a shop with a huge share of the
    rows costs one partial row per task.  ``tag_chars`` shortens the tags."""
    ts = F.coalesce(F.col("date").cast("string").try_cast("timestamp_ntz"), F.lit(FAR_FUTURE).cast("timestamp_ntz"))
    fields = ["shop_name", "categories", "city", "state", "address", "stars_x", "review_count"]
    rows = raw.where(F.col("business_id").isNotNull()).select(
        F.col("business_id").cast("string").alias("shop_id"), F.col("name").alias("shop_name"), "categories", "city",
        "state", "address", to_double("stars_x").alias("stars_x"), F.col("review_count").try_cast("int").alias("review_count"),
        F.unix_micros(ts.cast("timestamp")).alias("_time"), review_key().alias("_id"))
    first = rows.groupBy(F.col("shop_id").alias("_shop")).agg(F.min("_time").alias("_first"))
    rows = rows.join(first, (F.col("shop_id") == F.col("_shop")) & (F.col("_time") == F.col("_first")), "left_semi")
    order = [F.col("_id")]
    for c in fields:  # null after every value
        order += [F.col(c).isNull(), F.coalesce(F.col(c), F.lit(-1).cast(rows.schema[c].dataType))]
    g = rows.groupBy("shop_id").agg(F.min_by(F.struct(*fields), F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])).alias("r"))
    sx = F.col("r.stars_x")
    out = g.select(
        "shop_id", F.col("r.shop_name").alias("shop_name"), F.lit(platform).alias("platform"),
        category_of(F.col("r.categories")).alias("category"), F.col("r.city").alias("city"),
        F.col("r.state").alias("district"), F.col("r.address").alias("address"),
        F.lit(0).alias("average_price"),
        F.when(sx.isNull() | F.isnan(sx), F.lit(0.0)).otherwise(sx).alias("score"),
        F.lit(0.0).alias("taste_score"), F.lit(0.0).alias("environment_score"),
        F.lit(0.0).alias("service_score"),
        F.coalesce(F.col("r.review_count"), F.lit(0)).alias("review_count"),
        (F.col("r.categories") if tag_chars is None else F.substring(F.col("r.categories"), 1, tag_chars)).alias("tags"))
    return out.select(*[F.col(c).cast(t).alias(c) for c, t in SHOP_COLUMNS])
