"""The standard review schema and column alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 21 standard review columns, in order, with their types.
STANDARD_COLUMNS = [
    ("review_id", "string"), ("shop_id", "string"), ("shop_name", "string"),
    ("platform", "string"), ("user_id", "string"), ("username", "string"),
    ("user_level", "double"), ("vip_status", "boolean"), ("review_content", "string"),
    ("review_score", "double"), ("score_text", "string"), ("review_time", "timestamp"),
    ("like_count", "double"), ("reply_count", "double"), ("order_type", "string"),
    ("dishes", "string"), ("images", "string"), ("sentiment_label", "int"),
    ("sentiment", "string"), ("absa_aspects", "string"), ("crawl_time", "timestamp"),
]
STANDARD_NAMES = [c for c, _ in STANDARD_COLUMNS]

# Shop dimension columns.
SHOP_COLUMNS = [
    ("shop_id", "string"), ("shop_name", "string"), ("platform", "string"),
    ("category", "string"), ("city", "string"), ("district", "string"),
    ("address", "string"), ("average_price", "int"), ("score", "double"),
    ("taste_score", "double"), ("environment_score", "double"),
    ("service_score", "double"), ("review_count", "int"), ("tags", "string"),
]


def standard_struct(all_strings: bool = False) -> T.StructType:
    """StructType of the standard columns (all strings for raw CSV reads)."""
    fields = []
    for c, t in STANDARD_COLUMNS:
        dt = T.StringType() if all_strings else T._parse_datatype_string(t)
        fields.append(T.StructField(c, dt, True))
    return T.StructType(fields)


def align_columns(df: DataFrame) -> DataFrame:
    """Standard columns first (missing ones as typed nulls), extra columns after.

    Pure projection: no job, no shuffle.
    """
    present = set(df.columns)
    std = [F.col(f"`{c}`") if c in present else F.lit(None).cast(t).alias(c) for c, t in STANDARD_COLUMNS]
    extras = [F.col(f"`{c}`") for c in df.columns if c not in STANDARD_NAMES]
    return df.select(*std, *extras)
