"""Registered text-mining queries over rv_docs (test lexicon of FIXTURES §4)."""

from __future__ import annotations

from critiq.functions.num import sql_rnd as R
from critiq.functions.text import word_pattern
from critiq.operators import text as tx
from critiq.plans.registry import register
from critiq.sources.fixtures import rv_docs, rv_mixed, with_views

# The test lexicon (whole lower-case words) used by the checks;
# the invented test prose contains none of the default restaurant keywords.
TEST_LEXICON = {
    "Food": ["that", "than"],
    "Service": ["with", "thed"],
    "Ambiance": ["this", "erin"],
    "Price": ["from", "thin"],
    "Location": ["tion", "ther"],
}

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.EN_STOP_WORDS)


def tok_sql(text: str = "review_content") -> str:
    return (f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z'']+'), "
            f"lambda w: length(w) >= 3 AND w NOT IN ({STOPS}))")


def _hit(i: int, words: list[str]) -> str:
    return f"CAST(regexp_matches(lower(coalesce(review_content, '')), '{word_pattern(words)}') AS INTEGER) AS h{i}"


def _hits_cte() -> str:
    hs = ", ".join(_hit(i, w) for i, w in enumerate(TEST_LEXICON.values()))
    return f"hits AS (SELECT {hs}, sentiment_label FROM rv_docs)"


def _dimcov_sql() -> str:
    parts = []
    for i, d in enumerate(TEST_LEXICON):
        parts.append(f"""SELECT '{d}' AS dimension, CAST(sum(h{i}) AS BIGINT) AS mentions,
  {R(f'CAST(sum(h{i}) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0e0', 1)} AS mention_pct,
  {R(f'CAST(sum(CASE WHEN sentiment_label = -1 THEN h{i} ELSE 0 END) AS DOUBLE) / CAST(greatest(sum(h{i}), 1) AS DOUBLE) * 100.0e0', 1)} AS neg_in_dim_pct
FROM hits""")
    return with_views(f", {_hits_cte()}\n" + "\nUNION ALL ".join(parts), "rv_docs")


@register("dimension_coverage", _dimcov_sql())
def q_dimension_coverage(spark, sf_dir):
    return tx.dimension_coverage(rv_docs(spark, sf_dir), TEST_LEXICON)


def _matrix_body() -> str:
    parts = []
    for i, d in enumerate(TEST_LEXICON):
        tot = f"CAST(greatest(sum(h{i}), 1) AS DOUBLE)"
        cols = [R(f"CAST(sum(CASE WHEN sentiment_label = {v} THEN h{i} ELSE 0 END) AS DOUBLE) / {tot} * 100.0e0", 1) + f" AS {n}"
                for v, n in ((1, "positive_pct"), (0, "neutral_pct"), (-1, "negative_pct"))]
        parts.append(f"SELECT '{d}' AS dimension, {', '.join(cols)}, CAST(sum(h{i}) AS BIGINT) AS total_mentions FROM hits")
    return f", {_hits_cte()},\nmx AS (" + "\nUNION ALL ".join(parts) + ")"


@register("aspect_matrix", with_views(_matrix_body() + "\nSELECT * FROM mx", "rv_docs"))
def q_aspect_matrix(spark, sf_dir):
    return tx.aspect_matrix(rv_docs(spark, sf_dir), TEST_LEXICON)


@register("worst_dimension", with_views(_matrix_body() + "\nSELECT * FROM mx ORDER BY negative_pct DESC, dimension LIMIT 1", "rv_docs"))
def q_worst_dimension(spark, sf_dir):
    return tx.worst_dimension(tx.aspect_matrix(rv_docs(spark, sf_dir), TEST_LEXICON))


def _wf_sql(where: str = "") -> str:
    return with_views(f""",
t AS (SELECT unnest({tok_sql()}) AS word FROM rv_docs WHERE review_content IS NOT NULL {where})
SELECT word, CAST(count(*) AS BIGINT) AS count FROM t GROUP BY word ORDER BY count DESC, word LIMIT 25""", "rv_docs")


@register("word_frequency", _wf_sql())
def q_word_frequency(spark, sf_dir):
    return tx.word_frequency(rv_docs(spark, sf_dir), top_n=25)


@register("word_frequency_negative", _wf_sql("AND sentiment = 'negative'"))
def q_word_frequency_neg(spark, sf_dir):
    return tx.word_frequency(rv_docs(spark, sf_dir), sentiment="negative", top_n=25)


def _neg_signal_sql(view: str, tokens: str) -> str:
    return with_views(f""",
d AS (SELECT CAST(sentiment_label AS DOUBLE) AS l, review_content FROM {view} WHERE sentiment_label IN (1, -1)),
n AS (SELECT greatest(sum(CASE WHEN l = -1 THEN 1 ELSE 0 END), 1) AS nn, greatest(sum(CASE WHEN l = 1 THEN 1 ELSE 0 END), 1) AS np FROM d),
t AS (SELECT l, unnest({tokens}) AS word FROM d WHERE review_content IS NOT NULL),
g AS (SELECT word, CAST(sum(CASE WHEN l = -1 THEN 1 ELSE 0 END) AS BIGINT) AS neg_count,
             sum(CASE WHEN l = 1 THEN 1 ELSE 0 END) AS pc FROM t GROUP BY word),
c AS (SELECT * FROM g WHERE neg_count > 0 ORDER BY neg_count DESC, word LIMIT 45),
s AS (SELECT word, neg_count, {R('CAST(neg_count AS DOUBLE) / CAST(nn AS DOUBLE) - CAST(pc AS DOUBLE) / CAST(np AS DOUBLE)', 4)} AS neg_score FROM c, n),
b AS (SELECT * FROM s ORDER BY neg_score DESC, neg_count DESC, word LIMIT 15)
SELECT word, neg_count, neg_score,
  CASE WHEN neg_score <= 0.0e0 THEN 'low' WHEN neg_score <= 0.02e0 THEN 'medium' WHEN neg_score <= 0.05e0 THEN 'high'
       ELSE 'critical' END AS risk FROM b""", view)


@register("neg_signal_words", _neg_signal_sql("rv_docs", tok_sql()))
def q_neg_signal(spark, sf_dir):
    return tx.neg_signal_words(rv_docs(spark, sf_dir), top_n=15)


SHOP_KW_SQL = with_views(f""",
names AS (SELECT shop_id, min(shop_name) AS shop_name
          FROM rv_docs WHERE shop_id IS NOT NULL GROUP BY shop_id),
t AS (SELECT shop_id, unnest({tok_sql()}) AS word FROM rv_docs WHERE shop_id IS NOT NULL AND review_content IS NOT NULL),
g AS (SELECT shop_id, word, CAST(count(*) AS BIGINT) AS count FROM t GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY count DESC, word) AS k FROM g)
SELECT r.shop_id, shop_name, word AS keyword, count FROM r JOIN names USING (shop_id) WHERE k <= 8""", "rv_docs")


@register("shop_keywords", SHOP_KW_SQL)
def q_shop_keywords(spark, sf_dir):
    return tx.shop_keywords(rv_docs(spark, sf_dir), top_n=8)


LEN_SQL = with_views(f""",
d AS (SELECT sentiment, CAST(length(coalesce(review_content, '')) AS DOUBLE) AS x FROM rv_docs WHERE sentiment IS NOT NULL)
SELECT sentiment, CAST(count(x) AS BIGINT) AS count, {R('avg(x)', 1)} AS mean, {R('quantile_cont(x, 0.5)', 1)} AS median,
       {R('quantile_cont(x, 0.25)', 1)} AS p25, {R('quantile_cont(x, 0.75)', 1)} AS p75
FROM d GROUP BY sentiment""", "rv_docs")


@register("length_stats", LEN_SQL)
def q_length_stats(spark, sf_dir):
    return tx.length_stats(rv_docs(spark, sf_dir))


SPLIT_CTE = """sp AS (
  SELECT review_content AS text,
    CASE WHEN sentiment_label = 1 THEN 'positive' WHEN sentiment_label = 0 THEN 'neutral' ELSE 'negative' END AS label,
    shop_id, platform,
    CASE WHEN substr(md5(review_id), 1, 4) < 'b333' THEN 'train' WHEN substr(md5(review_id), 1, 4) < 'd999' THEN 'val'
         ELSE 'test' END AS split, review_id
  FROM rv_docs WHERE length(coalesce(review_content, '')) >= 20 AND sentiment_label IN (1, 0, -1))"""


@register("training_split", with_views(f", {SPLIT_CTE}\nSELECT * FROM sp", "rv_docs"))
def q_training_split(spark, sf_dir):
    return tx.training_split(rv_docs(spark, sf_dir))


@register("label_distribution", with_views(f", {SPLIT_CTE}\n"
                                           "SELECT label, CAST(count(*) AS BIGINT) AS count FROM sp WHERE split = 'train' GROUP BY label", "rv_docs"))
def q_label_distribution(spark, sf_dir):
    return tx.label_distribution(tx.training_split(rv_docs(spark, sf_dir)))


STRAT_SQL = with_views("""
SELECT review_id, CAST(sentiment_label AS INTEGER) AS label,
       CASE WHEN substr(md5(review_id), 1, 4) < 'cccc' THEN 'train' ELSE 'test' END AS part
FROM rv_docs WHERE sentiment_label IN (1, 0, -1) AND review_content IS NOT NULL""", "rv_docs")


@register("stratified_split", STRAT_SQL)
def q_stratified_split(spark, sf_dir):
    return tx.stratified_split(rv_docs(spark, sf_dir))


@register("class_weights", with_views(f""",
g AS (SELECT CAST(sentiment_label AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS count FROM rv_docs
      WHERE sentiment_label IN (1, 0, -1) GROUP BY 1),
t AS (SELECT sum(count) AS n, count(*) AS k FROM g)
SELECT label, count, {R('CAST(n AS DOUBLE) / (CAST(k AS DOUBLE) * CAST(count AS DOUBLE))', 6)} AS weight FROM g, t""", "rv_docs"))
def q_class_weights(spark, sf_dir):
    from pyspark.sql import functions as F
    d = rv_docs(spark, sf_dir).where(F.col("sentiment_label").isin(1, 0, -1))
    return tx.class_weights(d.select(F.col("sentiment_label").alias("label")))


ASPECT_ROWS_CTE = """ar AS (
  SELECT review_content AS text, json_extract_string(e, '$.aspect') AS aspect, sentiment, shop_id, review_score AS stars
  FROM (SELECT *, unnest(json_extract(absa_aspects, '$[*]')) AS e FROM rv_docs
        WHERE coalesce(review_content, '') <> '' AND coalesce(absa_aspects, '') <> ''
          AND json_valid(absa_aspects) AND json_type(absa_aspects::JSON) = 'ARRAY')
  WHERE json_type(e) = 'OBJECT' AND coalesce(json_extract_string(e, '$.aspect'), '') <> '')"""


@register("aspect_rows", with_views(f", {ASPECT_ROWS_CTE}\nSELECT * FROM ar", "rv_docs"))
def q_aspect_rows(spark, sf_dir):
    return tx.aspect_rows(rv_docs(spark, sf_dir))


@register("aspect_pivot", with_views(f""", {ASPECT_ROWS_CTE}
SELECT aspect, CAST(sum(CASE WHEN sentiment = 'negative' THEN 1 ELSE 0 END) AS BIGINT) AS negative,
       CAST(sum(CASE WHEN sentiment = 'neutral' THEN 1 ELSE 0 END) AS BIGINT) AS neutral,
       CAST(sum(CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END) AS BIGINT) AS positive
FROM ar GROUP BY aspect""", "rv_docs"))
def q_aspect_pivot(spark, sf_dir):
    return tx.aspect_pivot(tx.aspect_rows(rv_docs(spark, sf_dir)))


TFIDF_SQL = with_views(f""",
d AS (SELECT review_id, review_content FROM rv_docs WHERE review_content IS NOT NULL),
t AS (SELECT review_id AS doc, unnest(regexp_extract_all(lower(review_content), '[a-zA-Z]{{3,}}')) AS term FROM d),
tf AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
w AS (SELECT doc, term, (1.0e0 + ln(CAST(tf AS DOUBLE))) * (ln((1.0e0 + n) / (1.0e0 + CAST(df AS DOUBLE))) + 1.0e0) AS w
      FROM tf JOIN df USING (term), n),
nm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc)
SELECT doc AS review_id, term, {R('w / norm', 6)} AS tfidf FROM w JOIN nm USING (doc)""", "rv_docs")


@register("tfidf_terms", TFIDF_SQL)
def q_tfidf(spark, sf_dir):
    return tx.tfidf_terms(rv_docs(spark, sf_dir))


COOC_CTE = f"""dt AS (SELECT DISTINCT review_id AS doc, unnest({tok_sql()}) AS word FROM rv_docs WHERE review_content IS NOT NULL),
pr AS (SELECT a.word AS word_a, b.word AS word_b, CAST(count(*) AS BIGINT) AS cooccurrence
       FROM dt a JOIN dt b ON a.doc = b.doc AND a.word < b.word GROUP BY 1, 2
       ORDER BY cooccurrence DESC, word_a, word_b LIMIT 30)"""


@register("cooccurrence", with_views(f", {COOC_CTE}\nSELECT * FROM pr", "rv_docs"))
def q_cooccurrence(spark, sf_dir):
    return tx.cooccurrence(rv_docs(spark, sf_dir), top_k=30)


@register("cooccurrence_matrix", with_views(f""", {COOC_CTE},
ws AS (SELECT w, count(*) AS c FROM (SELECT word_a AS w FROM pr UNION ALL SELECT word_b FROM pr) GROUP BY w
       ORDER BY c DESC, w LIMIT 14),
bth AS (SELECT word_a AS row_word, word_b AS col_word, cooccurrence FROM pr
         UNION ALL SELECT word_b, word_a, cooccurrence FROM pr)
SELECT row_word, col_word, CAST(sum(cooccurrence) AS BIGINT) AS cooccurrence FROM bth
WHERE row_word IN (SELECT w FROM ws) AND col_word IN (SELECT w FROM ws) GROUP BY 1, 2""", "rv_docs"))
def q_cooccurrence_matrix(spark, sf_dir):
    return tx.cooccurrence_matrix(tx.cooccurrence(rv_docs(spark, sf_dir), top_k=30))


@register("language_guess", with_views("""
SELECT platform, CASE WHEN length(regexp_replace(coalesce(review_content, ''), '[^一-龥]', '', 'g'))
                           > length(coalesce(review_content, '')) * 0.3e0 THEN 'zh' ELSE 'en' END AS lang,
       CAST(count(*) AS BIGINT) AS count
FROM rv_docs GROUP BY 1, 2""", "rv_docs"))
def q_language_guess(spark, sf_dir):
    from pyspark.sql import functions as F
    d = rv_docs(spark, sf_dir)
    return d.groupBy("platform", tx.detect_lang(F.col("review_content")).alias("lang")).agg(
        F.count(F.lit(1)).cast("long").alias("count"))


@register("training_split_exact", with_views(""",
v AS (SELECT review_content AS text,
        CASE WHEN sentiment_label = 1 THEN 'positive' WHEN sentiment_label = 0 THEN 'neutral' ELSE 'negative' END AS label,
        shop_id, platform, review_id,
        row_number() OVER (ORDER BY md5(review_id), review_id) - 1 AS i, count(*) OVER () AS n
      FROM rv_docs WHERE length(coalesce(review_content, '')) >= 20 AND sentiment_label IN (1, 0, -1))
SELECT text, label, shop_id, platform,
  CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'val' ELSE 'test' END AS split,
  review_id FROM v""", "rv_docs"))
def q_training_split_exact(spark, sf_dir):
    return tx.training_split(rv_docs(spark, sf_dir), exact=True)


def _baseline_pred_sql() -> str:
    lab = ("CASE WHEN {s} >= 4 THEN 1 WHEN {s} = 3 THEN 0 ELSE -1 END")
    stars = "(CASE WHEN stars_y IS NULL OR isnan(stars_y) OR stars_y = 0 THEN 3.0e0 ELSE stars_y END)"
    return f"""p AS (SELECT CAST({lab.format(s=stars)} AS VARCHAR) AS t,
                      CAST({lab.format(s='floor(stars_x + 0.5e0)')} AS VARCHAR) AS p FROM rv_raw)"""


CLS_REPORT_SQL = with_views(f""", {_baseline_pred_sql()},
c AS (SELECT t, p, count(*) AS n FROM p GROUP BY 1, 2),
cls AS (SELECT t AS cls FROM c UNION SELECT p FROM c),
m AS (SELECT cls,
        coalesce((SELECT sum(n) FROM c WHERE c.t = cls.cls AND c.p = cls.cls), 0) AS tp,
        coalesce((SELECT sum(n) FROM c WHERE c.t = cls.cls), 0) AS support,
        coalesce((SELECT sum(n) FROM c WHERE c.p = cls.cls), 0) AS predicted FROM cls),
m2 AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / CAST(predicted AS DOUBLE) ELSE 0.0e0 END AS precision,
                 CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / CAST(support AS DOUBLE) ELSE 0.0e0 END AS recall FROM m),
m3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0e0 * precision * recall / (precision + recall) ELSE 0.0e0 END AS f1 FROM m2),
allr AS (
  SELECT cls AS class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM m3
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM m3
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM m3
  UNION ALL SELECT 'accuracy', CAST(sum(tp) AS DOUBLE) / sum(support), CAST(sum(tp) AS DOUBLE) / sum(support),
                   CAST(sum(tp) AS DOUBLE) / sum(support), CAST(sum(support) AS BIGINT) FROM m3)
SELECT class, {R('precision', 4)} AS precision, {R('recall', 4)} AS recall, {R('f1', 4)} AS f1, support FROM allr""", "rv_raw")


@register("classification_report", CLS_REPORT_SQL)
def q_classification_report(spark, sf_dir):
    """Report of a baseline predictor derived from the data: the shop's
    stars (rounded) predict each review's sentiment label."""
    from pyspark.sql import functions as F
    from critiq.sources import etl
    from critiq.sources.fixtures import rv_raw
    r = rv_raw(spark, sf_dir)
    sy = F.col("stars_y")
    stars = F.when(sy.isNull() | F.isnan(sy) | (sy == 0), F.lit(etl.DEFAULT_STARS)).otherwise(sy)
    _, t = etl.sentiment_of(stars)
    _, p = etl.sentiment_of(F.floor(F.col("stars_x") + F.lit(0.5)))
    return tx.classification_report(r.select(t.alias("label"), p.alias("prediction")))


# ------------------------------------------------------------------ two languages in one table
ZH_STOPS = ", ".join(f"'{w}'" for w in tx.ZH_STOP_WORDS)
ZH_TOKENS = ("list_filter(string_split_regex(trim(regexp_replace(coalesce(review_content, ''), '[^一-龥a-zA-Z]', ' ', 'g')), ' +'), "
             f"lambda w: length(w) >= 2 AND w NOT IN ({ZH_STOPS}))")
IS_ZH = ("length(regexp_replace(coalesce(review_content, ''), '[^一-龥]', '', 'g')) "
         "> CAST(length(coalesce(review_content, '')) AS DOUBLE) * 0.3e0")
MIXED_TOKENS = f"CASE WHEN {IS_ZH} THEN {ZH_TOKENS} ELSE {tok_sql()} END"
MIXED_LEXICON = {"en": TEST_LEXICON, "zh": tx.ZH_DIMENSIONS}


def _frequency_sql(tokens: str) -> str:
    return with_views(f""",
t AS (SELECT unnest({tokens}) AS word FROM rv_mixed WHERE review_content IS NOT NULL)
SELECT word, CAST(count(*) AS BIGINT) AS count FROM t GROUP BY word ORDER BY count DESC, word LIMIT 40""", "rv_mixed")


@register("word_frequency_mixed", _frequency_sql(MIXED_TOKENS))
def q_word_frequency_mixed(spark, sf_dir):
    return tx.word_frequency(rv_mixed(spark, sf_dir), top_n=40)


@register("word_frequency_zh", _frequency_sql(ZH_TOKENS))
def q_word_frequency_zh(spark, sf_dir):
    return tx.word_frequency(rv_mixed(spark, sf_dir), top_n=40, lang="zh")


@register("word_frequency_given", _frequency_sql(
    "list_filter(string_split_regex(lower(coalesce(review_content, '')), '[ \\n\\t.,]+'), lambda w: CASE WHEN "
    f"{IS_ZH} THEN length(w) >= 2 AND w NOT IN ({ZH_STOPS}) ELSE length(w) >= 3 AND w NOT IN ({STOPS}) END)"))
def q_word_frequency_given(spark, sf_dir):
    """Tokens made by the caller (here by a plain split) in place of the tokenizer's."""
    from pyspark.sql import functions as F
    given = F.split(F.lower(F.coalesce(F.col("review_content"), F.lit(""))), "[ \n\t.,]+")
    return tx.word_frequency(rv_mixed(spark, sf_dir).withColumn("own_tokens", given), top_n=40, token_col="own_tokens")


@register("neg_signal_words_mixed", _neg_signal_sql("rv_mixed", MIXED_TOKENS))
def q_neg_signal_mixed(spark, sf_dir):
    return tx.neg_signal_words(rv_mixed(spark, sf_dir), top_n=15)


@register("shop_keywords_mixed", with_views(f""",
t AS (SELECT shop_id, shop_name, unnest({MIXED_TOKENS}) AS word FROM rv_mixed WHERE shop_id IS NOT NULL AND review_content IS NOT NULL),
g AS (SELECT shop_id, min(shop_name) AS shop_name, word, CAST(count(*) AS BIGINT) AS count FROM t GROUP BY shop_id, word),
r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY count DESC, word) AS k FROM g)
SELECT shop_id, shop_name, word AS keyword, count FROM r WHERE k <= 8""", "rv_mixed"))
def q_shop_keywords_mixed(spark, sf_dir):
    return tx.shop_keywords(rv_mixed(spark, sf_dir), top_n=8)


def _mixed_hits() -> str:
    """CTE long(dimension, zh, hit, sentiment_label): a row per text and dimension of its language."""
    parts = [f"SELECT '{d}' AS dimension, zh, regexp_matches(low, '{word_pattern(w)}') AS hit, sentiment_label FROM m WHERE NOT zh"
             for d, w in TEST_LEXICON.items()]
    parts += [f"SELECT '{d}', zh, regexp_matches(low, '{'|'.join(w)}'), sentiment_label FROM m WHERE zh" for d, w in tx.ZH_DIMENSIONS.items()]
    return (f", m AS (SELECT lower(coalesce(review_content, '')) AS low, {IS_ZH} AS zh, sentiment_label FROM rv_mixed),\n"
            "lg AS (" + "\nUNION ALL ".join(parts) + ")")


@register("dimension_coverage_mixed", with_views(f"""{_mixed_hits()}
SELECT dimension, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS mentions,
  {R('CAST(sum(CAST(hit AS INT)) AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100.0e0', 1)} AS mention_pct,
  {R('CAST(sum(CASE WHEN hit AND sentiment_label = -1 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(greatest(sum(CAST(hit AS INT)), 1) AS DOUBLE) * 100.0e0', 1)} AS neg_in_dim_pct
FROM lg GROUP BY dimension""", "rv_mixed"))
def q_dimension_coverage_mixed(spark, sf_dir):
    return tx.dimension_coverage(rv_mixed(spark, sf_dir), MIXED_LEXICON)


@register("aspect_matrix_mixed", with_views(f"""{_mixed_hits()},
s AS (SELECT dimension, sum(CAST(hit AS INT)) AS n, sum(CASE WHEN hit AND sentiment_label = 1 THEN 1 ELSE 0 END) AS p,
  sum(CASE WHEN hit AND sentiment_label = 0 THEN 1 ELSE 0 END) AS z, sum(CASE WHEN hit AND sentiment_label = -1 THEN 1 ELSE 0 END) AS x FROM lg GROUP BY dimension)
SELECT dimension, {R('CAST(p AS DOUBLE) / CAST(greatest(n, 1) AS DOUBLE) * 100.0e0', 1)} AS positive_pct,
  {R('CAST(z AS DOUBLE) / CAST(greatest(n, 1) AS DOUBLE) * 100.0e0', 1)} AS neutral_pct,
  {R('CAST(x AS DOUBLE) / CAST(greatest(n, 1) AS DOUBLE) * 100.0e0', 1)} AS negative_pct, CAST(n AS BIGINT) AS total_mentions FROM s""", "rv_mixed"))
def q_aspect_matrix_mixed(spark, sf_dir):
    return tx.aspect_matrix(rv_mixed(spark, sf_dir), MIXED_LEXICON)


@register("cooccurrence_mixed", with_views(f""",
dt AS (SELECT DISTINCT review_id AS doc, unnest({MIXED_TOKENS}) AS word FROM rv_mixed WHERE review_content IS NOT NULL)
SELECT a.word AS word_a, b.word AS word_b, CAST(count(*) AS BIGINT) AS cooccurrence
FROM dt a JOIN dt b ON a.doc = b.doc AND a.word < b.word GROUP BY 1, 2 ORDER BY cooccurrence DESC, word_a, word_b LIMIT 50""", "rv_mixed"))
def q_cooccurrence_mixed(spark, sf_dir):
    return tx.cooccurrence(rv_mixed(spark, sf_dir), top_k=50)
