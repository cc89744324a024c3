"""Review-shaped views over the driver's tables.

Each view exists twice: as a Spark DataFrame builder and as DuckDB SQL text
(used only by the correctness oracle).  The two must stay equivalent, so
both follow the same column rules; numeric literals are doubles on both
sides.

Star rule: score >= 4 -> label 1 (positive), exactly 3 -> 0 (neutral),
anything else -> -1 (negative).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def label_from_score(score: Column) -> Column:
    return (F.when(score.isNull(), F.lit(None))
            .when(score >= 4, F.lit(1)).when(score == 3, F.lit(0))
            .otherwise(F.lit(-1))).cast("int")


def sentiment_name(label: Column) -> Column:
    return (F.when(label == 1, "positive").when(label == 0, "neutral")
            .when(label == -1, "negative"))


LABEL_SQL = ("CASE WHEN {s} IS NULL THEN NULL WHEN {s} >= 4 THEN 1 "
             "WHEN {s} = 3 THEN 0 ELSE -1 END")
NAME_SQL = ("CASE WHEN {l} = 1 THEN 'positive' WHEN {l} = 0 THEN 'neutral' "
            "WHEN {l} = -1 THEN 'negative' END")


# ---------------------------------------------------------------- rv_orders
def rv_orders(spark: SparkSession, sf_dir: str, with_text: bool = False, only: str | None = None) -> DataFrame:
    """lineitem x orders x supplier x part x nation x region (+ documents).

    Inner equi-joins on the TPC-H keys; Catalyst and AQE choose broadcast
    for the tiny dimensions (nation, region) from measured sizes, and a
    shuffle join for the large ones.  ``with_text`` adds the left join to
    ``documents`` on ``doc_id = l_partkey % 200``; leave it off unless text
    is read, as it carries long strings through the shuffle.  ``only`` names
    the columns that the caller reads: every join here is on a foreign key and
    keeps each line item exactly once, so joins that none of them needs are
    left out.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_tax", "l_shipdate")
    score = (F.floor((F.col("l_quantity") - F.lit(1.0)) / F.lit(10.0)) + F.lit(1)).cast("double")
    cols = {
        "review_id": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        "shop_id": F.col("l_suppkey").cast("string"),
        "shop_name": F.col("s_name"),
        "user_id": F.col("o_custkey").cast("string"),
        "city": F.col("n_name"),
        "district": F.col("r_name"),
        "category": F.col("p_type"),
        "review_score": score,
        "review_time": F.col("l_shipdate"),
        "like_count": F.floor(F.col("l_discount") * F.lit(100.0) + F.lit(0.5)).cast("int"),
        "reply_count": F.floor(F.col("l_tax") * F.lit(100.0) + F.lit(0.5)).cast("int"),
        "aspect_count": F.col("l_linenumber").cast("int"),
        "sentiment_label": label_from_score(score),
        "sentiment": sentiment_name(label_from_score(score)),
        "review_content": F.col("text"),
        "content_len": F.col("n_chars").cast("int"),
    }
    wanted = only.split() if only else [c for c in cols if with_text or c != "review_content"]
    needs = set(wanted)
    df = li
    if needs & {"user_id"}:
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        df = df.join(o, df.l_orderkey == o.o_orderkey)
    if needs & {"shop_name", "city", "district"}:
        s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        df = df.join(s, df.l_suppkey == s.s_suppkey)
    if needs & {"category"}:
        p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
        df = df.join(p, df.l_partkey == p.p_partkey)
    if needs & {"city", "district"}:
        n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
        df = df.join(n, df.s_nationkey == n.n_nationkey)
    if needs & {"district"}:
        r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
        df = df.join(r, df.n_regionkey == r.r_regionkey)
    if needs & {"review_content", "content_len"}:
        # Only doc ids 0..199 can match ``l_partkey % 200``; doc_id is the key of
        # documents, so this slice has at most 200 rows at any scale and is
        # broadcast instead of shuffling lineitem for the join.
        d = table(spark, sf_dir, "documents").where(F.col("doc_id") < 200)
        d = d.select("doc_id", "n_chars", *(["text"] if "review_content" in needs else []))
        df = df.join(F.broadcast(d), (F.col("l_partkey") % 200) == d.doc_id, "left")
    return df.select(*[cols[c].alias(c) for c in wanted])


# columns of rv_orders that groups of queries read
ALERT_COLS = "review_id shop_id shop_name review_score review_time sentiment_label"
TREND_COLS = "review_id review_score review_time sentiment_label"
RFM_COLS = "review_id user_id review_score review_time"

RV_ORDERS_SQL = f"""
rv_orders AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS review_id,
         CAST(l_suppkey AS VARCHAR) AS shop_id, s_name AS shop_name,
         CAST(o_custkey AS VARCHAR) AS user_id, n_name AS city, r_name AS district,
         p_type AS category,
         CAST(floor((l_quantity - 1.0e0) / 10.0e0) + 1 AS DOUBLE) AS review_score,
         l_shipdate AS review_time,
         CAST(floor(l_discount * 100.0e0 + 0.5e0) AS INTEGER) AS like_count,
         CAST(floor(l_tax * 100.0e0 + 0.5e0) AS INTEGER) AS reply_count,
         CAST(l_linenumber AS INTEGER) AS aspect_count,
         {LABEL_SQL.format(s='CAST(floor((l_quantity - 1.0e0) / 10.0e0) + 1 AS DOUBLE)')} AS sentiment_label,
         {NAME_SQL.format(l=LABEL_SQL.format(s='CAST(floor((l_quantity - 1.0e0) / 10.0e0) + 1 AS DOUBLE)'))} AS sentiment,
         d.text AS review_content, CAST(d.n_chars AS INTEGER) AS content_len
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN documents d ON d.doc_id = l_partkey % 200
)"""


# ---------------------------------------------------------------- rv_events
EVENT_SCORES = {"purchase": 5.0, "signup": 5.0, "view": 4.0, "click": 3.0, "error": 1.0}


def _event_score(c: Column) -> Column:
    out = None
    for k, v in EVENT_SCORES.items():
        out = (F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v)))
    return out.cast("double")


EVENT_SCORE_SQL = ("CASE WHEN event_type IN ('purchase','signup') THEN 5.0e0 "
                   "WHEN event_type = 'view' THEN 4.0e0 WHEN event_type = 'click' THEN 3.0e0 "
                   "WHEN event_type = 'error' THEN 1.0e0 END")


def rv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as reviews: shop = JSON field ``k`` of props, score from event type."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    df = e.select(
        F.col("event_id").cast("string").alias("review_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("review_time"),
        k.cast("string").alias("shop_id"),
        F.concat(F.lit("shop-"), k.cast("string")).alias("shop_name"),
        _event_score(F.col("event_type")).alias("review_score"),
        F.col("event_type").alias("review_content"),
        F.col("value"),
    )
    df = df.withColumn("sentiment_label", label_from_score(F.col("review_score")))
    return df.withColumn("sentiment", sentiment_name(F.col("sentiment_label")))


RV_EVENTS_SQL = f"""
rv_events AS (
  SELECT CAST(event_id AS VARCHAR) AS review_id, CAST(user_id AS VARCHAR) AS user_id,
         ts AS review_time,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS shop_id,
         'shop-' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR) AS shop_name,
         {EVENT_SCORE_SQL} AS review_score,
         event_type AS review_content, value,
         {LABEL_SQL.format(s='(' + EVENT_SCORE_SQL + ')')} AS sentiment_label,
         {NAME_SQL.format(l=LABEL_SQL.format(s='(' + EVENT_SCORE_SQL + ')'))} AS sentiment
  FROM events
)"""


# ---------------------------------------------------------------- rv_docs
# The aspect objects used to fill the absa_aspects column of
# rv_docs (aspect names are the dimension names of the test lexicon).
DOC_ASPECTS = [
    '{"aspect":"Food","sentiment":"positive"}',
    '{"aspect":"Service","opinion":"slow"}',
    '{"aspect":"Price","sentiment":"negative"}',
]


def _aspects_json(doc_id: Column) -> Column:
    m = doc_id % 8
    arr = [F.lit("[" + ",".join(DOC_ASPECTS[:i]) + "]") for i in range(4)]
    return (F.when(m == 0, arr[0]).when(m == 1, arr[1]).when(m == 2, arr[2])
            .when(m == 3, arr[3]).when(m == 4, F.lit("{}")).when(m == 5, F.lit("bad"))
            .when(m == 6, F.lit("")).otherwise(F.lit(None).cast("string")))


def _aspects_sql() -> str:
    arr = ["'[" + ",".join(DOC_ASPECTS[:i]) + "]'" for i in range(4)]
    return ("CASE doc_id % 8 WHEN 0 THEN " + arr[0] + " WHEN 1 THEN " + arr[1] +
            " WHEN 2 THEN " + arr[2] + " WHEN 3 THEN " + arr[3] +
            " WHEN 4 THEN '{}' WHEN 5 THEN 'bad' WHEN 6 THEN '' ELSE NULL END")


def rv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents left-joined with labels; toxic -> -1, quality 1 -> 1, 0 -> 0."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    df = d.join(lab, "doc_id", "left")
    label = (F.when(F.col("toxic") == 1, F.lit(-1)).when(F.col("quality") == 1, F.lit(1))
             .when(F.col("quality") == 0, F.lit(0))).cast("int")
    score = (F.when(label == 1, F.lit(5.0)).when(label == 0, F.lit(3.0))
             .when(label == -1, F.lit(1.0))).cast("double")
    return df.select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.col("source").alias("shop_id"),
        F.col("source").alias("shop_name"),
        F.col("lang").alias("platform"),
        F.col("text").alias("review_content"),
        label.alias("sentiment_label"),
        sentiment_name(label).alias("sentiment"),
        score.alias("review_score"),
        _aspects_json(F.col("doc_id")).alias("absa_aspects"),
        F.col("n_chars").cast("int").alias("content_len"),
    )


_DOC_LABEL_SQL = ("CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 "
                  "WHEN quality = 0 THEN 0 END")
RV_DOCS_SQL = f"""
rv_docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS review_id, source AS shop_id, source AS shop_name,
         lang AS platform, text AS review_content,
         {_DOC_LABEL_SQL} AS sentiment_label,
         {NAME_SQL.format(l='(' + _DOC_LABEL_SQL + ')')} AS sentiment,
         CASE ({_DOC_LABEL_SQL}) WHEN 1 THEN 5.0e0 WHEN 0 THEN 3.0e0 WHEN -1 THEN 1.0e0 END AS review_score,
         {_aspects_sql().replace('doc_id', 'd.doc_id')} AS absa_aspects,
         CAST(n_chars AS INTEGER) AS content_len
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


# ---------------------------------------------------------------- rv_mixed
# The ideograph that stands for each letter in the texts of
# rv_mixed that are to look Chinese; frequent letter pairs become dimension words.
MIXED_LETTERS = "abcdefghijklmnopqrstuvwxyz"
MIXED_IDEOGRAPHS = "价情干格服便安道环礼业新净境好宜装务吃味鲜专静貌热修"


def rv_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rv_docs in two languages: every third text is written in ideographs."""
    df = rv_docs(spark, sf_dir)
    zh = F.translate(F.lower(F.col("review_content")), MIXED_LETTERS, MIXED_IDEOGRAPHS)
    text = F.when(F.col("review_id").cast("long") % 3 == 0, zh).otherwise(F.col("review_content"))
    return df.select("review_id", "shop_id", "shop_name", text.alias("review_content"), "sentiment_label", "sentiment")


RV_MIXED_SQL = f"""
rv_mixed AS (
  SELECT review_id, shop_id, shop_name,
         CASE WHEN CAST(review_id AS BIGINT) % 3 = 0 THEN translate(lower(review_content), '{MIXED_LETTERS}', '{MIXED_IDEOGRAPHS}')
              ELSE review_content END AS review_content, sentiment_label, sentiment
  FROM rv_docs
)"""


# ---------------------------------------------------------------- rv_messy
# The damaged spellings written into rv_messy.
MESSY_SCORES = {0: "", 1: "abc", 2: "9", 3: "-2"}            # event_id % 11, 4 -> null
MESSY_SCORE_TEXT = {1: "stars:4.5", 2: "stars:",
                    3: "口味4.0 | 环境3.5 | 服务5.0", 4: ""}    # event_id % 5, 0 -> null
MESSY_LISTS = {1: "", 2: "a|b", 3: "a|| c |"}                  # event_id % 4, 0 -> null
MESSY_VIP = {0: "True", 1: "False", 2: "1"}                    # event_id % 4, 3 -> null


def rv_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events again, with string-typed and damaged columns for the cleaners."""
    ev = rv_events(spark, sf_dir)
    eid = F.col("review_id").cast("long")
    m11, m5, m4, m7 = eid % 11, eid % 5, eid % 4, eid % 7
    score_txt = F.col("review_score").cast("string")
    score = (F.when(m11 == 0, F.lit(MESSY_SCORES[0])).when(m11 == 1, F.lit(MESSY_SCORES[1]))
             .when(m11 == 2, F.lit(MESSY_SCORES[2])).when(m11 == 3, F.lit(MESSY_SCORES[3]))
             .when(m11 == 4, F.lit(None).cast("string")).otherwise(score_txt))
    stext = (F.when(m5 == 1, F.lit(MESSY_SCORE_TEXT[1])).when(m5 == 2, F.lit(MESSY_SCORE_TEXT[2]))
             .when(m5 == 3, F.lit(MESSY_SCORE_TEXT[3])).when(m5 == 4, F.lit(MESSY_SCORE_TEXT[4])))
    base = F.col("review_content")
    content = (F.when(m7 == 0, F.lit(None).cast("string"))
               .when(m7 == 1, F.lit("ab"))
               .when(m7 == 2, F.concat(F.lit("  "), base, F.lit("   event \t\t text  ")))
               .when(m7 == 3, F.concat(F.lit("\u3000"), base, F.lit("\u3000wide\u3000space event")))
               .when(m7 == 4, F.concat(base, F.lit(" zero\u200bwidth\u200d event\ufeff")))
               .when(m7 == 5, F.repeat(F.concat(base, F.lit(" long review text ")), 150))
               .otherwise(F.concat(base, F.lit(" plain event text"))))
    lists = (F.when(m4 == 1, F.lit(MESSY_LISTS[1])).when(m4 == 2, F.lit(MESSY_LISTS[2]))
             .when(m4 == 3, F.lit(MESSY_LISTS[3])))
    vip = (F.when(m4 == 0, F.lit(MESSY_VIP[0])).when(m4 == 1, F.lit(MESSY_VIP[1]))
           .when(m4 == 2, F.lit(MESSY_VIP[2])))
    rtime = F.when(eid % 9 == 0, F.lit("not a date")).otherwise(F.col("review_time").cast("string"))
    label = F.when(eid % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("sentiment_label").cast("string"))
    likes = F.when(eid % 13 == 0, F.lit("n/a")).otherwise(F.floor(F.col("value")).cast("string"))
    return ev.select(
        "review_id", "shop_id", "shop_name", "user_id",
        score.alias("review_score"), stext.alias("score_text"),
        content.alias("review_content"), lists.alias("dishes"),
        lists.alias("images"),
        vip.alias("vip_status"), rtime.alias("review_time"),
        label.alias("sentiment_label"), "sentiment", likes.alias("like_count"),
    )


def _messy_sql() -> str:
    c = "CAST(event_id AS BIGINT)"
    return f"""
rv_messy AS (
  SELECT review_id, shop_id, shop_name, user_id,
    CASE CAST(review_id AS BIGINT) % 11 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '9'
      WHEN 3 THEN '-2' WHEN 4 THEN NULL ELSE CAST(review_score AS VARCHAR) END AS review_score,
    CASE CAST(review_id AS BIGINT) % 5 WHEN 1 THEN 'stars:4.5' WHEN 2 THEN 'stars:'
      WHEN 3 THEN '口味4.0 | 环境3.5 | 服务5.0' WHEN 4 THEN '' ELSE NULL END AS score_text,
    CASE CAST(review_id AS BIGINT) % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ab'
      WHEN 2 THEN '  ' || review_content || '   event ' || chr(9) || chr(9) || ' text  '
      WHEN 3 THEN chr(12288) || review_content || chr(12288) || 'wide' || chr(12288) || 'space event'
      WHEN 4 THEN review_content || ' zero' || chr(8203) || 'width' || chr(8205) || ' event' || chr(65279)
      WHEN 5 THEN repeat(review_content || ' long review text ', 150)
      ELSE review_content || ' plain event text' END AS review_content,
    CASE CAST(review_id AS BIGINT) % 4 WHEN 1 THEN '' WHEN 2 THEN 'a|b' WHEN 3 THEN 'a|| c |' ELSE NULL END AS dishes,
    CASE CAST(review_id AS BIGINT) % 4 WHEN 1 THEN '' WHEN 2 THEN 'a|b' WHEN 3 THEN 'a|| c |' ELSE NULL END AS images,
    CASE CAST(review_id AS BIGINT) % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' WHEN 2 THEN '1' ELSE NULL END AS vip_status,
    CASE WHEN CAST(review_id AS BIGINT) % 9 = 0 THEN 'not a date' ELSE CAST(review_time AS VARCHAR) END AS review_time,
    CASE WHEN CAST(review_id AS BIGINT) % 6 = 0 THEN NULL ELSE CAST(sentiment_label AS VARCHAR) END AS sentiment_label,
    sentiment,
    CASE WHEN CAST(review_id AS BIGINT) % 13 = 0 THEN 'n/a' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS like_count
  FROM rv_events
)"""


RV_MESSY_SQL = _messy_sql()

VIEW_SQL = {"rv_orders": RV_ORDERS_SQL, "rv_events": RV_EVENTS_SQL,
            "rv_docs": RV_DOCS_SQL, "rv_messy": RV_MESSY_SQL, "rv_mixed": RV_MIXED_SQL}
VIEW_DEPS = {"rv_messy": ["rv_events"], "rv_mixed": ["rv_docs"]}
BUILDERS = {"rv_orders": rv_orders, "rv_events": rv_events,
            "rv_docs": rv_docs, "rv_messy": rv_messy, "rv_mixed": rv_mixed}


def with_views(sql: str, *views: str) -> str:
    """Prefix ``sql`` with the CTEs of the named views (dependencies first)."""
    names: list[str] = []
    for v in views:
        for dep in VIEW_DEPS.get(v, []):
            if dep not in names:
                names.append(dep)
        if v not in names:
            names.append(v)
    return "WITH " + ",\n".join(VIEW_SQL[n].strip() for n in names) + "\n" + sql


# ---------------------------------------------------------------- rv_raw
# Category texts of rv_raw by doc_id % 6 (4 adds the language).
RAW_CATEGORIES = {1: "", 2: "Restaurants, Pizza, Bars", 3: "Food, Nightlife",
                  5: "Coffee & Tea, Bakeries"}


def rv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x labels shaped as raw provider rows (for the ETL operators)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    df = d.join(lab, "doc_id", "left")
    i = F.col("doc_id")
    m6 = i % 6
    cats = (F.when(m6 == 0, F.lit(None).cast("string")).when(m6 == 1, F.lit(RAW_CATEGORIES[1]))
            .when(m6 == 2, F.lit(RAW_CATEGORIES[2])).when(m6 == 3, F.lit(RAW_CATEGORIES[3]))
            .when(m6 == 4, F.concat(F.lit("Restaurants, "), F.col("lang"), F.lit(" Kitchen")))
            .otherwise(F.lit(RAW_CATEGORIES[5])))
    stars = (F.when(i % 50 == 7, F.lit(0.0)).when(F.col("toxic") == 1, F.lit(1.0))
             .when((F.col("quality") == 1) & (i % 3 == 0), F.lit(4.0))
             .when(F.col("quality") == 1, F.lit(5.0)).when(F.col("quality") == 0, F.lit(3.0)))
    ts = F.timestamp_add("HOUR", (i * 7).cast("int"), F.lit("2019-01-01 00:00:00").cast("timestamp_ntz"))
    date = F.when(i % 10 == 9, F.lit("garbage")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    return df.select(
        F.col("source").alias("business_id"), F.concat(F.lit("Shop "), F.col("source")).alias("name"),
        F.col("lang").alias("city"), F.upper(F.col("lang")).alias("state"),
        cats.alias("categories"), F.concat(F.col("source"), F.lit(" street")).alias("address"),
        F.col("text"), date.alias("date"),
        F.concat(F.lit("u"), (i % 37).cast("string")).alias("user_id"),
        stars.cast("double").alias("stars_y"),
        (F.lit(2.5) + (i % 5).cast("double") * F.lit(0.5)).alias("stars_x"),
        (i % 4).cast("int").alias("useful"), (i % 3).cast("int").alias("funny"),
        (F.lit(10) + i % 90).cast("int").alias("review_count"),
    )


RV_RAW_SQL = """
rv_raw AS (
  SELECT source AS business_id, 'Shop ' || source AS name, lang AS city, upper(lang) AS state,
    CASE d.doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Restaurants, Pizza, Bars'
      WHEN 3 THEN 'Food, Nightlife' WHEN 4 THEN 'Restaurants, ' || lang || ' Kitchen'
      ELSE 'Coffee & Tea, Bakeries' END AS categories,
    source || ' street' AS address, text,
    CASE WHEN d.doc_id % 10 = 9 THEN 'garbage'
      ELSE strftime(TIMESTAMP '2019-01-01 00:00:00' + to_hours(CAST(d.doc_id * 7 AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS date,
    'u' || CAST(d.doc_id % 37 AS VARCHAR) AS user_id,
    CASE WHEN d.doc_id % 50 = 7 THEN 0.0e0 WHEN toxic = 1 THEN 1.0e0
      WHEN quality = 1 AND d.doc_id % 3 = 0 THEN 4.0e0 WHEN quality = 1 THEN 5.0e0
      WHEN quality = 0 THEN 3.0e0 END AS stars_y,
    2.5e0 + CAST(d.doc_id % 5 AS DOUBLE) * 0.5e0 AS stars_x,
    CAST(d.doc_id % 4 AS INTEGER) AS useful, CAST(d.doc_id % 3 AS INTEGER) AS funny,
    CAST(10 + d.doc_id % 90 AS INTEGER) AS review_count
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

VIEW_SQL["rv_raw"] = RV_RAW_SQL
BUILDERS["rv_raw"] = rv_raw
