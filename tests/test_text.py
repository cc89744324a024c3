"""Text operators on hand-made documents."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from critiq.operators import text as tx

DOCS = [
    ("1", "s1", "S1", "The food was cold and the service slow. Food!", -1, "en", '[{"aspect":"food","sentiment":"negative"}, 5, {"opinion":"x"}]'),
    ("2", "s1", "S1", "Lovely food, friendly staff, great value.", 1, "en", '{"aspect":"food"}'),
    ("3", "s2", "S2", "Seafood platter was overpriced; noisy room.", -1, "en", "bad"),
    ("4", "s2", "S2", "Great great great place", 1, "en", '[{"aspect":"price","sentiment":"x"}]'),
    ("5", "s2", "S2", None, 0, "en", None),
]
SCHEMA = "review_id string, shop_id string, shop_name string, review_content string, sentiment_label int, platform string, absa_aspects string"


def _df(spark):
    df = spark.createDataFrame(DOCS, SCHEMA)
    return df.selectExpr("*", "CASE sentiment_label WHEN 1 THEN 'positive' WHEN 0 THEN 'neutral' ELSE 'negative' END AS sentiment",
                         "CAST(sentiment_label + 3 AS DOUBLE) AS review_score")


def _tok(t):
    return [w for w in re.findall(r"[a-z']+", (t or "").lower()) if len(w) >= 3 and w not in tx.EN_STOP_WORDS]


def test_word_frequency(spark):
    out = tx.word_frequency(_df(spark), top_n=50).collect()
    exp = Counter(w for d in DOCS for w in _tok(d[3]))
    assert {r.word: r["count"] for r in out} == dict(exp)
    assert out[0].word == "great" and out[0]["count"] == 4


def test_dimension_whole_words(spark):
    lex = {"Food": ["food"], "Price": ["overpriced", "value"]}
    out = {r.dimension: r for r in tx.dimension_coverage(_df(spark), lex).collect()}
    assert out["Food"].mentions == 2            # 'Seafood' is not a whole-word hit
    assert out["Food"].neg_in_dim_pct == 50.0
    assert out["Price"].mentions == 2 and out["Price"].mention_pct == 40.0
    m = {r.dimension: r for r in tx.aspect_matrix(_df(spark), lex).collect()}
    assert m["Food"].negative_pct == 50.0 and m["Food"].positive_pct == 50.0


def test_neg_signal_and_keywords(spark):
    out = tx.neg_signal_words(_df(spark), top_n=3).collect()
    assert out[0].neg_score > 0 and out[0].risk == "critical"
    kw = tx.shop_keywords(_df(spark), top_n=2).toPandas()
    assert kw.groupby("shop_id").size().max() <= 2
    assert kw[kw.shop_id == "s2"].iloc[0].keyword == "great"


def test_aspect_rows_skip_rules(spark):
    rows = tx.aspect_rows(_df(spark)).collect()
    # doc 1: one good object (5 and an object without aspect are skipped);
    # doc 2: a bare object is not an array; doc 3: bad JSON; doc 4: one row
    assert sorted((r.text[:5], r.aspect) for r in rows) == [("Great", "price"), ("The f", "food")]


def test_splits_are_stable(spark):
    a = tx.training_split(_df(spark), min_len=5).toPandas().sort_values("review_id")
    b = tx.training_split(_df(spark).repartition(3), min_len=5).toPandas().sort_values("review_id")
    assert a.split.tolist() == b.split.tolist()


def test_classification_report(spark):
    pred = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (-1, -1), (-1, 1)], "label int, prediction int")
    rep = {r["class"]: r for r in tx.classification_report(pred).collect()}
    assert rep["accuracy"].precision == 0.6
    assert rep["1"].precision == 0.5 and rep["1"].recall == 0.5 and rep["0"].recall == 1.0


def test_tfidf_norm(spark):
    out = tx.tfidf_terms(_df(spark), digits=12).toPandas()
    norms = out.groupby("review_id").tfidf.apply(lambda s: (s ** 2).sum())
    assert ((norms - 1).abs() < 1e-9).all()


def _pairs(docs):
    exp = Counter()
    for ws in docs:
        ws = sorted(set(ws))
        exp.update((a, b) for i, a in enumerate(ws) for b in ws[i + 1:])
    return exp


def test_cooccurrence_brute_force(spark):
    out = {(r.word_a, r.word_b): r.cooccurrence for r in tx.cooccurrence(_df(spark), top_k=1000).collect()}
    assert out == dict(_pairs(_tok(d[3]) for d in DOCS))
    assert tx.cooccurrence(_df(spark).limit(0), top_k=5).collect() == []


def test_cooccurrence_over_all_words_in_blocks(spark):
    """Rare words that always meet are found behind frequent words that seldom do, whatever the blocks."""
    rng = random.Random(3)
    docs = [[f"common{rng.randint(0, 25):02d}".replace("0", "o").replace("1", "l") + "abcdefghij"[rng.randint(0, 9)] for _ in range(3)] for _ in range(300)]
    docs += [["zebra", "quagga", "okapi"]] * 40 + [["lonely"]] * 9 + [[]]
    df = spark.createDataFrame([(str(k), " ".join(d)) for k, d in enumerate(docs)], "review_id string, review_content string")
    want = sorted(_pairs(_tok(" ".join(d)) for d in docs).items(), key=lambda x: (-x[1], x[0]))
    for top_k, block, strip in ((3, 4, 1), (3, 512, 16), (12, 7, 2), (60, 16, 3)):
        got = tx.cooccurrence(df.repartition(3), top_k=top_k, block=block, strip=strip)
        assert [((r.word_a, r.word_b), r.cooccurrence) for r in got.orderBy(F.desc("cooccurrence"), "word_a", "word_b").collect()] == want[:top_k]


def test_mixed_languages(spark):
    rows = [("1", "s", "S", "味道 很好 服务 服务 热情", 1), ("2", "s", "S", "The service was slow and the food cold", -1), ("3", "s", "S", None, 0), ("4", "s", "S", "味道 一般 ok", -1)]
    df = spark.createDataFrame(rows, "review_id string, shop_id string, shop_name string, review_content string, sentiment_label int")
    words = {r.word: r["count"] for r in tx.word_frequency(df).collect()}
    assert words == {"味道": 2, "很好": 1, "服务": 2, "热情": 1, "一般": 1, "ok": 1, "service": 1, "slow": 1, "food": 1, "cold": 1}
    cover = {r.dimension: (r.mentions, r.mention_pct) for r in tx.dimension_coverage(df).collect()}
    assert cover["Food"] == (1, 50.0) and cover["Service"] == (1, 50.0)  # of the two texts that count as en
    assert cover["口味"] == (2, 100.0) and cover["服务"] == (1, 50.0)
    assert set(cover) == {*tx.EN_DIMENSIONS, *tx.ZH_DIMENSIONS}
    only = {r.dimension for r in tx.dimension_coverage(df.where("review_id = '2'")).collect()}
    assert only == set(tx.EN_DIMENSIONS)  # as a table of one language gives
    pairs = {(r.word_a, r.word_b) for r in tx.cooccurrence(df, top_k=100).collect()}
    assert ("味道", "很好") in pairs and ("food", "slow") in pairs
    assert {r.keyword for r in tx.shop_keywords(df, top_n=2).collect()} == {"味道", "服务"}


def test_tokens_made_by_the_caller(spark):
    df = spark.createDataFrame([("1", "s", "S", "味道很好", ["味道", "很好", "的"], 1), ("2", "s", "S", "good food", ["good_food", "an"], -1), ("3", "s", "S", "x", None, 1)],
                               "review_id string, shop_id string, shop_name string, review_content string, own array<string>, sentiment_label int")
    assert {r.word for r in tx.word_frequency(df, token_col="own").collect()} == {"味道", "很好", "good_food"}
    assert {r.keyword for r in tx.shop_keywords(df, token_col="own").collect()} == {"味道", "很好", "good_food"}
    assert {r.word for r in tx.neg_signal_words(df, token_col="own").collect()} == {"good_food"}
    assert [(r.word_a, r.word_b) for r in tx.cooccurrence(df, token_col="own").collect()] == [("味道", "很好")]


def test_zh_tokens_and_language(spark):
    df = spark.createDataFrame([("味道 很好，服务 热情 的 ok",), ("plain english words",)], "t string")
    toks = [r[0] for r in df.select(tx.tokens(F.col("t"), "zh")).collect()]
    assert toks[0] == ["味道", "很好", "服务", "热情", "ok"]
    lang = [r[0] for r in df.select(tx.detect_lang(F.col("t"))).collect()]
    assert lang == ["zh", "en"]


def test_zh_dimension_substring(spark):
    df = spark.createDataFrame([("1", "味道好极了", -1), ("2", "环境一般", 1)], "review_id string, review_content string, sentiment_label int")
    out = {r.dimension: r.mentions for r in tx.dimension_coverage(df, lang="zh").collect()}
    assert out["口味"] == 1 and out["环境"] == 1 and out["服务"] == 0


def test_hash_cuts_and_exact_split(spark):
    from critiq.operators.common import hash_cuts
    ids = [str(i) for i in range(3000)]
    order = sorted(ids, key=lambda i: (hashlib.md5(i.encode()).hexdigest(), i))
    df = spark.createDataFrame([(i,) for i in ids], "k string").repartition(7)
    ranks = [1, 2, 700, 2999, 3000, 9999, 0]
    cuts = hash_cuts(df, "k", [F.lit(r) for r in ranks]).first().cuts
    assert [c and c.id for c in cuts] == [order[0], order[1], order[699], order[2998], order[2999], order[2999], None]
    assert hash_cuts(df.limit(0), "k", [F.lit(3)]).first().cuts == [None]
    rows = [(str(i), "x" * 25, [1, 0, -1][i % 3], "s", "p") for i in range(101)]
    d = spark.createDataFrame(rows, "review_id string, review_content string, sentiment_label int, shop_id string, platform string")
    sp = tx.training_split(d, exact=True).groupBy("split").count().toPandas().set_index("split")["count"]
    assert (sp["train"], sp["val"], sp["test"]) == (int(101 * 0.7), int(101 * 0.15), 101 - 70 - 15)
    none = tx.training_split(d, train=0.0, val=0.0, exact=True)
    assert {r.split for r in none.select("split").distinct().collect()} == {"test"}


def test_hash_sample_of_any_size(spark):
    from critiq.sources.readers import hash_sample
    ids = [str(i) for i in range(500)] + [None]
    df = spark.createDataFrame([(i,) for i in ids], "k string").repartition(5)
    order = sorted(ids, key=lambda i: (hashlib.md5(i.encode()).hexdigest() if i else "0" * 32, i or ""))
    for n in (0, 1, 17, 400, 501, 1000):
        assert {r.k for r in hash_sample(df, "k", n).collect()} == set(order[:n])
        assert hash_sample(df, "k", n).count() == min(n, 501)


def test_exact_split_shuffles_no_text(spark):
    rows = [(str(i), "x" * 25, 1, "s", "p") for i in range(50)]
    d = spark.createDataFrame(rows, "review_id string, review_content string, sentiment_label int, shop_id string, platform string")
    top = tx.training_split(d, exact=True)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in top


def test_tfidf_with_heavy_terms(spark):
    """A term of every document is broadcast, not joined; both ways give the same weights."""
    import math
    docs = [["every"] * (k % 3 + 1) + [f"rare{'abcdefghij'[k % 10]}", "some" if k % 2 else "other"] for k in range(40)]
    df = spark.createDataFrame([(str(k), " ".join(d)) for k, d in enumerate(docs)], "review_id string, review_content string")
    seen = Counter(t for d in docs for t in set(d))
    want = {}
    for k, d in enumerate(docs):
        w = {t: (1 + math.log(c)) * (math.log(41 / (1 + seen[t])) + 1) for t, c in Counter(d).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        want.update({(str(k), t): round(x / norm, 6) for t, x in w.items()})
    for share in (0.0, 0.3, 2.0):
        got = {(r.review_id, r.term): r.tfidf for r in tx.tfidf_terms(df, heavy_share=share).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_tfidf_deals_texts_by_document(spark):
    import re
    rows = [(str(i), "shared words and " + "word" * (i % 7 + 1)) for i in range(300)]
    out = tx.tfidf_terms(spark.createDataFrame(rows, "review_id string, review_content string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc#\d+, term#\d+", plan)  # counts per document and term stay where the text is
    norm = out.groupBy("review_id").agg({"tfidf": "count"}).collect()
    assert len(norm) == 300 and all(r[1] == 4 for r in norm)
