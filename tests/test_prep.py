"""Cleaning pipeline edge rows."""

from critiq.operators import prep
from critiq.sources.schema import STANDARD_NAMES, align_columns


def test_casts_and_clip(spark):
    df = spark.createDataFrame([("1", "9"), ("2", "-2"), ("3", "abc"), ("4", None), ("5", "NaN")],
                               "review_id string, review_score string")
    out = {r.review_id: r.review_score for r in prep.cast_types(df).collect()}
    assert out == {"1": 5.0, "2": 1.0, "3": None, "4": None, "5": None}


def test_text_cleanup(spark):
    txt = "\u3000 a\t\tb  c\u200b d\ufeff "
    df = spark.createDataFrame([(txt,), (None,)], "review_content string")
    out = [r.review_content for r in prep.clean_text(df).collect()]
    assert out == ["a b c d", ""]


def test_score_text_and_fill(spark):
    df = spark.createDataFrame([("stars:4.5",), ("口味4.0 | 环境3.5 | 服务5.0",), (None,), ("",)], "score_text string")
    p = prep.handle_missing(prep.parse_score_text(df)).collect()
    assert (p[0].taste_score, p[0].service_score) == (4.5, 4.5)
    assert (p[1].taste_score, p[1].environment_score, p[1].service_score) == (4.0, 3.5, 5.0)
    # means rounded to one digit: taste (4.5 + 4.0) / 2 = 4.25 -> 4.3
    assert p[2].taste_score == 4.3 and p[2].environment_score == 4.0


def test_derived_and_filter(spark):
    rows = [("a|| c |", "img", "[1,2]", "a" * 2500, "2024-01-06 10:00:00"),
            (None, " ", "{}", "tiny", "bad"),
            ("", None, "bad", "fine text here", None)]
    df = spark.createDataFrame(rows, "dishes string, images string, absa_aspects string, review_content string, review_time string")
    assert max(len(r.review_content) for r in prep.preprocess(df).collect()) == 2500   # no cut unless asked for
    out = prep.preprocess(df, max_content_len=2000).collect()
    assert len(out) == 2                     # 'tiny' (< 5 chars) dropped
    first = [r for r in out if r.content_len == 2500][0]
    assert first.dish_count == 2 and first.has_image and first.aspect_count == 2
    assert len(first.review_content) == 2000  # cut after the length was taken
    assert first.review_weekday == 5 and first.is_weekend
    other = [r for r in out if r.content_len != 2500][0]
    assert other.aspect_count == 0 and other.is_weekend is False and other.review_hour is None


def test_align(spark):
    df = spark.createDataFrame([("x", 1)], "review_id string, extra int")
    out = align_columns(df)
    assert out.columns == STANDARD_NAMES + ["extra"]
    assert dict(out.dtypes)["review_time"] == "timestamp"


def test_white_space_classes_agree_on_bmp(spark):
    """The Java form, the explicit (SQL) form and Python's isspace agree."""
    from pyspark.sql import functions as F
    from critiq.functions.text import JAVA_WS_CLASS, WS_CLASS
    cps = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    s = "".join(chr(c) for c in cps)
    df = spark.createDataFrame([(s,)], "t string")
    a, b = df.select(F.regexp_replace("t", JAVA_WS_CLASS, "#").alias("a"),
                     F.regexp_replace("t", WS_CLASS, "#").alias("b")).first()
    assert a == b
    py = "".join("#" if ch.isspace() else ch for ch in s)
    assert a == py
