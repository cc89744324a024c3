"""Text mining on review content.

Tokens stay JVM-side: ``regexp_extract_all`` + ``filter`` build the token
array, ``explode`` + ``groupBy`` count them with partial aggregation.  Only
(key, token) columns are kept before an ``explode``, and every top-k is an
ordered limit (bounded) or the two-stage exact top-k per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from critiq.functions.num import rnd, with_scalars
from critiq.functions.tables import materialize
from critiq.functions.text import word_pattern
from critiq.operators.common import grouped_with_first, has, hash_cuts, hash_key, top_k_per_group

# English stop words of the tokenizer.
EN_STOP_WORDS = sorted({
    "i", "me", "my", "we", "our", "you", "your", "he", "she", "they", "them",
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "at", "in", "on", "to", "of", "for", "with", "from", "by", "about", "as",
    "this", "that", "these", "those", "it", "its", "and", "or", "but", "not",
    "so", "if", "there", "here", "what", "when", "where", "how", "which", "who",
    "just", "also", "very", "really", "quite", "more", "most", "much", "many",
    "some", "any", "all", "both", "each", "few", "same", "other", "than", "only",
    "then", "now", "too", "well", "back", "still", "even", "get", "got",
    "one", "two", "time", "go", "going", "came", "come", "went", "said", "say",
})
# Chinese stop words.
ZH_STOP_WORDS = sorted({
    "的", "了", "是", "在", "我", "有", "和", "就", "都", "而", "着", "或", "没有",
    "感觉", "觉得", "非常", "真的", "一个", "这", "那", "也", "太", "挺", "比较",
    "有点", "下次", "来", "不错", "还是", "就是", "这里", "这家", "一些", "大家",
})
# English restaurant dimensions and their keywords.
EN_DIMENSIONS = {
    "Food": ["food", "taste", "flavor", "delicious", "bland", "fresh", "stale", "portion",
             "dish", "meal", "menu", "cuisine", "cooking", "seasoning", "ingredient"],
    "Service": ["service", "staff", "waiter", "waitress", "server", "host", "rude", "friendly",
                "slow", "attentive", "helpful", "professional", "courtesy", "recommend"],
    "Ambiance": ["ambiance", "atmosphere", "decor", "noise", "noisy", "clean", "dirty", "cozy",
                 "crowded", "busy", "quiet", "comfortable", "dark", "bright", "interior", "setting"],
    "Price": ["price", "expensive", "cheap", "value", "overpriced", "affordable", "worth",
              "bill", "cost", "money", "reasonable", "pricey", "deal", "tip"],
    "Location": ["location", "parking", "convenient", "far", "close", "accessible", "neighborhood",
                 "drive", "walk", "distance", "downtown", "area"],
}
# Chinese dimensions (substring match).
ZH_DIMENSIONS = {
    "口味": ["味道", "口味", "好吃", "香", "辣", "甜", "咸", "鲜", "嫩", "脆", "腻", "淡", "正宗", "新鲜"],
    "环境": ["环境", "装修", "氛围", "卫生", "干净", "整洁", "嘈杂", "安静", "舒适", "拥挤", "座位"],
    "服务": ["服务", "态度", "速度", "等待", "上菜", "热情", "周到", "冷漠", "慢", "专业", "礼貌"],
    "价格": ["价格", "消费", "性价比", "便宜", "贵", "实惠", "划算", "值", "优惠", "人均"],
    "食材": ["食材", "新鲜", "质量", "分量", "份量", "大", "小"],
}
EN_TOKEN = "[a-z']+"
CJK = "一-龥"
RISK_BINS = [(0.0, "low"), (0.02, "medium"), (0.05, "high")]   # upper edges; above -> critical
LABEL_NAMES = {1: "positive", 0: "neutral", -1: "negative"}


LANGS = ("en", "zh")
MIN_LEN = {"en": 3, "zh": 2}


def detect_lang(text: Column) -> Column:
    """Per-row language guess: more than 30 % CJK ideographs -> zh, else en.
    Texts without any ideograph are told by one scan and not counted."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.length(F.regexp_replace(t, f"[^{CJK}]", ""))
    return F.when(t.rlike(f"[{CJK}]") & (cjk > F.length(t) * F.lit(0.3)), F.lit("zh")).otherwise(F.lit("en"))


def by_lang(lang: str | None, row_lang: Column, choice) -> Column:
    """``choice(lang)``; with ``lang`` None the choice of each row's own language."""
    if lang is not None:
        return choice(lang)
    return F.when(row_lang == "zh", choice("zh")).otherwise(choice("en"))


def _en_runs(text: Column, min_len: int) -> Column:
    """Maximal runs of [a-z'] with at least ``min_len`` characters.  A run
    shorter than that can never match, and matching is greedy, so this is
    the same as extracting every run and dropping the short ones."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z']{{{min_len},}}"), 0)


def _zh_runs(text: Column, min_len: int) -> Column:
    cleaned = F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{CJK}a-zA-Z]", " ")
    return F.filter(F.split(F.trim(cleaned), " +"), lambda w: F.length(w) >= min_len)


def _raw_tokens(text: Column, lang: str | None, row_lang: Column, given: Column | None = None,
                min_len: int | None = None) -> Column:
    """Tokens before the stop words go.  ``given``: tokens that the caller made
    (say, with a word segmenter); the language's least length holds for them too."""
    def of(name: str) -> Column:
        n = MIN_LEN[name] if min_len is None else min_len
        if given is not None:
            return F.filter(F.coalesce(given, F.array().cast("array<string>")), lambda w: F.length(w) >= n)
        return _en_runs(text, n) if name == "en" else _zh_runs(text, n)

    return by_lang(lang, row_lang, of)


def _stops(lang: str, stop_words) -> list[str]:
    if stop_words is not None:
        return list(stop_words)
    return EN_STOP_WORDS if lang == "en" else ZH_STOP_WORDS


def tokens(text: Column, lang: str | None = None, stop_words: list[str] | None = None,
           min_len: int | None = None, given: Column | None = None) -> Column:
    """Token array of one text (duplicates kept).  en: lower-case ``[a-z']``
    runs of at least 3 characters, minus stop words.  zh: non-CJK-non-letter
    -> space, split on white space, at least 2 characters, minus stop words.
    ``lang`` None: the row's own language picks tokenizer and stop words.
    ``given``: an array of caller-made tokens to use in place of the tokenizer's."""
    row_lang = detect_lang(text)
    return by_lang(lang, row_lang, lambda name: F.filter(
        _raw_tokens(text, name, row_lang, given, min_len), lambda w: ~w.isin(*_stops(name, stop_words))))


def distinct_tokens(text: Column, lang: str | None = None, stop_words=None, min_len: int | None = None,
                    given: Column | None = None) -> Column:
    """Distinct tokens of one text; ``array_except`` drops stop words and
    duplicates with a hash set, no lambda."""
    row_lang = detect_lang(text)
    return by_lang(lang, row_lang, lambda name: F.array_except(
        _raw_tokens(text, name, row_lang, given, min_len),
        F.array(*[F.lit(w) for w in _stops(name, stop_words)]).cast("array<string>")))


def token_rows(df: DataFrame, keys: list[str], lang: str | None = None, stop_words=None,
               token_col: str | None = None) -> DataFrame:
    """(keys..., word) rows; only the key columns travel with the tokens.
    The stop-word test runs after the explode as a plain (code-generated)
    ``NOT IN`` filter, by the row's language where ``lang`` is None."""
    text = F.col("review_content")
    row_lang = F.lit(lang) if lang is not None else detect_lang(text)
    given = F.col(token_col) if token_col else None
    if lang is not None:
        out = df.select(*keys, F.explode(_raw_tokens(text, lang, row_lang, given)).alias("word"))
        return out.where(~F.col("word").isin(*_stops(lang, stop_words)))
    raw = _raw_tokens(text, None, F.col("_lang"), given)
    out = df.select("*", row_lang.alias("_lang")).select(*keys, "_lang", F.explode(raw).alias("word"))
    keep = by_lang(None, F.col("_lang"), lambda name: ~F.col("word").isin(*_stops(name, stop_words)))
    return out.where(keep).drop("_lang")


def _dims(lang: str, lexicon: dict | None) -> dict:
    if lexicon is not None:
        return lexicon.get(lang, {}) if all(isinstance(v, dict) for v in lexicon.values()) else lexicon
    return EN_DIMENSIONS if lang == "en" else ZH_DIMENSIONS


def dimension_hit(text: Column, words: list[str], lang: str = "en") -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    pat = word_pattern(words) if lang == "en" else "|".join(words)
    return t.rlike(pat)


def _dimension_hits(df: DataFrame, lexicon: dict | None, lang: str | None, extra: list[Column]) -> tuple[DataFrame, list[tuple[str, list[str]]]]:
    """(hit columns ``_h0``, ..., ``_en``, ``_zh``, extra...) of every text, and
    for each dimension its name and the languages that have it.

    With ``lang`` None a text is matched with its own language's words: whole
    words for en, substrings for zh.  A lexicon {dimension: words} holds for
    both languages, {"en": {...}, "zh": {...}} for each its own.
    """
    text, langs = F.col("review_content"), LANGS if lang is None else (lang,)
    dims = {name: _dims(name, lexicon) for name in langs}
    names = list(dict.fromkeys(d for name in langs for d in dims[name]))
    # lower-cased once: inside the branches below it would be done again for every dimension
    src = df.select(F.lower(F.coalesce(text, F.lit(""))).alias("_low"), (detect_lang(text) if lang is None else F.lit(lang)).alias("_lang"), *extra)
    rest = [c for c in src.columns if c not in ("_low", "_lang")]
    hits = []
    for i, d in enumerate(names):
        hit = F.lit(False)
        for name in reversed(langs):
            if d in dims[name]:
                own = F.col("_low").rlike(word_pattern(dims[name][d]) if name == "en" else "|".join(dims[name][d]))
                hit = own if lang is not None else F.when(F.col("_lang") == name, own).otherwise(hit)
            elif lang is None:
                hit = F.when(F.col("_lang") == name, F.lit(False)).otherwise(hit)
        hits.append(hit.cast("int").alias(f"_h{i}"))
    marks = [(F.col("_lang") == name).cast("int").alias(f"_{name}") for name in langs]
    return src.select(*hits, *marks, *rest), [(d, [name for name in langs if d in dims[name]]) for d in names]


def _texts_of(dims: list[tuple[str, list[str]]], lang: str | None) -> list[str]:
    """SQL for each dimension: the number of texts in the languages that have it."""
    return [" + ".join(f"_n_{name}" for name in langs) for _, langs in dims]


def _neg(c: Column) -> Column:
    return F.when(c.try_cast("double") == -1, 1).otherwise(0)


# ------------------------------------------------------------------ TXT-1
def dimension_coverage(df: DataFrame, lexicon: dict | None = None, lang: str | None = None) -> DataFrame:
    """dimension, mentions, mention_pct, neg_in_dim_pct: one scan for all
    dimensions (one conditional sum per dimension), unpivoted by stack.

    ``lang`` None: each text is matched with its own language's dimensions,
    and mention_pct is the share of that language's texts; dimensions of a
    language without any text are left out.
    """
    label = F.col("sentiment_label") if has(df, "sentiment_label") else F.lit(None)
    hits, dims = _dimension_hits(df, lexicon, lang, [_neg(label).alias("_neg")])
    aggs = [F.sum(c).alias(f"_n{c}") for c in hits.columns if c in ("_en", "_zh")]
    for i in range(len(dims)):
        aggs += [F.sum(f"_h{i}").alias(f"_m{i}"), F.sum(F.col(f"_h{i}") * F.col("_neg")).alias(f"_x{i}")]
    one = hits.agg(*aggs)
    parts = ", ".join(f"'{d}', {n}, _m{i}, _x{i}" for i, ((d, _), n) in enumerate(zip(dims, _texts_of(dims, lang))))
    long = one.selectExpr(f"stack({len(dims)}, {parts}) as (dimension, _n, _m, _x)")
    if lang is None:
        long = long.where(F.col("_n") > 0)
    return long.select("dimension", F.col("_m").cast("long").alias("mentions"),
                       rnd(F.col("_m") / F.col("_n") * F.lit(100.0), 1).alias("mention_pct"),
                       rnd(F.col("_x") / F.greatest(F.col("_m"), F.lit(1)) * F.lit(100.0), 1).alias("neg_in_dim_pct"))


# ------------------------------------------------------------------ TXT-9 / RUN-1
def aspect_matrix(df: DataFrame, lexicon: dict | None = None, lang: str | None = None) -> DataFrame:
    """dimension, positive_pct, neutral_pct, negative_pct, total_mentions
    (shares among the texts that hit the dimension; null labels count in
    the denominator).  Languages as in ``dimension_coverage``."""
    lab = F.col("sentiment_label").try_cast("double") if has(df, "sentiment_label") else F.lit(None).cast("double")
    signs = {"p": 1, "z": 0, "n": -1}
    hits, dims = _dimension_hits(df, lexicon, lang, [F.coalesce((lab == v).cast("int"), F.lit(0)).alias(f"_{k}") for k, v in signs.items()])
    aggs = [F.sum(c).alias(f"_n{c}") for c in hits.columns if c in ("_en", "_zh")]
    for i in range(len(dims)):
        h = F.col(f"_h{i}")
        aggs += [F.sum(h).alias(f"_m{i}"), *[F.sum(h * F.col(f"_{k}")).alias(f"_{k}{i}") for k in signs]]
    one = hits.agg(*aggs)
    parts = ", ".join(f"'{d}', {n}, _m{i}, _p{i}, _z{i}, _n{i}" for i, ((d, _), n) in enumerate(zip(dims, _texts_of(dims, lang))))
    long = one.selectExpr(f"stack({len(dims)}, {parts}) as (dimension, _t, _m, _p, _z, _n)")
    if lang is None:
        long = long.where(F.col("_t") > 0)
    tot = F.greatest(F.col("_m"), F.lit(1))
    return long.select("dimension",
                       rnd(F.col("_p") / tot * F.lit(100.0), 1).alias("positive_pct"),
                       rnd(F.col("_z") / tot * F.lit(100.0), 1).alias("neutral_pct"),
                       rnd(F.col("_n") / tot * F.lit(100.0), 1).alias("negative_pct"),
                       F.col("_m").cast("long").alias("total_mentions"))


def worst_dimension(matrix: DataFrame) -> DataFrame:
    return matrix.orderBy(F.col("negative_pct").desc(), F.col("dimension")).limit(1)


# ------------------------------------------------------------------ TXT-2
def word_frequency(df: DataFrame, sentiment: str | None = None, top_n: int = 25,
                   lang: str | None = None, stop_words=None, token_col: str | None = None) -> DataFrame:
    d = df.where(F.col("sentiment") == sentiment) if sentiment and has(df, "sentiment") else df
    d = d.where(F.col("review_content").isNotNull())
    g = token_rows(d, [], lang, stop_words, token_col).groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("count"))
    return g.orderBy(F.col("count").desc(), F.col("word")).limit(top_n)


# ------------------------------------------------------------------ TXT-3
def risk_of(score: Column) -> Column:
    out = None
    for edge, name in RISK_BINS:
        out = F.when(score <= edge, name) if out is None else out.when(score <= edge, name)
    return out.otherwise("critical")


def neg_signal_words(df: DataFrame, top_n: int = 15, lang: str | None = None, stop_words=None,
                     token_col: str | None = None) -> DataFrame:
    """Words over-represented in negative reviews: among the 3n most frequent
    negative words, score = c_neg / N_neg - c_pos / N_pos (N = review counts,
    at least 1), top n by score, with a risk band."""
    lab = F.col("sentiment_label").try_cast("double")
    given = [token_col] if token_col else []
    d = df.select(lab.alias("_l"), "review_content", *given).where(F.col("_l").isin(1.0, -1.0))
    n = d.agg(F.greatest(F.sum((F.col("_l") == -1).cast("long")), F.lit(1)).alias("_nn"),
              F.greatest(F.sum((F.col("_l") == 1).cast("long")), F.lit(1)).alias("_np"))
    t = token_rows(d.where(F.col("review_content").isNotNull()), ["_l"], lang, stop_words, token_col)
    g = t.groupBy("word").agg(F.sum((F.col("_l") == -1).cast("long")).alias("neg_count"),
                              F.sum((F.col("_l") == 1).cast("long")).alias("_pc"))
    cand = g.where(F.col("neg_count") > 0).orderBy(F.col("neg_count").desc(), F.col("word")).limit(3 * top_n)
    s = with_scalars(cand, n).withColumn(
        "neg_score", rnd(F.col("neg_count") / F.col("_nn") - F.col("_pc") / F.col("_np"), 4))
    best = s.orderBy(F.col("neg_score").desc(), F.col("neg_count").desc(), F.col("word")).limit(top_n)
    return best.select("word", "neg_count", "neg_score", risk_of(F.col("neg_score")).alias("risk"))


# ------------------------------------------------------------------ TXT-4
def shop_keywords(df: DataFrame, top_n: int = 8, lang: str | None = None, stop_words=None,
                  token_col: str | None = None, salt_buckets: int = 64) -> DataFrame:
    """The top n tokens of every shop (ties by word).  Counts are partially
    aggregated per (shop, word); the per-shop top-k is the two-stage exact
    form, so one shop with a third of all reviews does not land in one task."""
    d = df.where(F.col("shop_id").isNotNull())
    names = grouped_with_first(d, ["shop_id"], ["shop_name"], {})
    g = (token_rows(d.where(F.col("review_content").isNotNull()), ["shop_id"], lang, stop_words, token_col)
         .groupBy("shop_id", "word").agg(F.count(F.lit(1)).cast("long").alias("count")))
    top = top_k_per_group(g, ["shop_id"], [F.col("count").desc(), F.col("word")], top_n,
                          salt_col="word", salt_buckets=salt_buckets)
    return top.join(names, "shop_id").select("shop_id", "shop_name", F.col("word").alias("keyword"), "count")


# ------------------------------------------------------------------ TXT-5
def length_stats(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per sentiment: count, mean, median, p25, p75 of the text length (1 d)."""
    ln = F.length(F.coalesce(F.col("review_content"), F.lit(""))).cast("double")
    d = df.where(F.col("sentiment").isNotNull()).select("sentiment", ln.alias("_len"))
    probs = F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))
    q = F.percentile("_len", probs) if exact else F.percentile_approx("_len", probs, 10000).cast("array<double>")
    g = d.groupBy("sentiment").agg(F.count("_len").cast("long").alias("count"), F.avg("_len").alias("_mean"), q.alias("_q"))
    return g.select("sentiment", "count", rnd(F.col("_mean"), 1).alias("mean"),
                    rnd(F.col("_q")[0], 1).alias("median"), rnd(F.col("_q")[1], 1).alias("p25"),
                    rnd(F.col("_q")[2], 1).alias("p75"))


# ------------------------------------------------------------------ TXT-6 / TXT-8b / NBK-18
def hash_bucket(id_col: Column) -> Column:
    """First four hex digits of md5(id): a uniform, partitioning-independent
    position in [0000, ffff] used for every split."""
    return F.substring(F.md5(id_col.cast("string")), 1, 4)


def training_split(df: DataFrame, train: float = 0.7, val: float = 0.15, min_len: int = 20,
                   exact: bool = False) -> DataFrame:
    """text, label, shop_id, platform, split: rows with text of at least
    ``min_len`` characters and a label in {1, 0, -1}.

    Default: the split comes from the md5 of the review id (train below 0.7,
    val below 0.85), row by row, no shuffle.  ``exact=True``: rows in the order
    of (md5, review id) are cut at int(n * train) and int(n * train) +
    int(n * val), so the part sizes are exact where review ids are unique (a
    repeated id stays in one part).  The two borders are order statistics of
    the hash, found from counts; the rows themselves are only compared with
    them, so no text is shuffled here either."""
    lab = F.col("sentiment_label").try_cast("double")
    d = df.where((F.length(F.coalesce(F.col("review_content"), F.lit(""))) >= min_len) & lab.isin(1.0, 0.0, -1.0))
    name = F.when(lab == 1, "positive").when(lab == 0, "neutral").otherwise("negative")
    plat = F.col("platform") if has(df, "platform") else F.lit(None).cast("string")
    if exact:
        n_tr = F.floor(F.col("_n") * F.lit(float(train)))
        n_va = F.floor(F.col("_n") * F.lit(float(val)))
        d = with_scalars(d, hash_cuts(d, "review_id", [n_tr, n_tr + n_va]))
        own = hash_key("review_id")  # a part of no rows has no border
        split = F.when(own <= F.col("cuts")[0], "train").when(own <= F.col("cuts")[1], "val").otherwise("test")
    else:
        h = hash_bucket(F.col("review_id"))
        cut1, cut2 = "%04x" % int(train * 0x10000), "%04x" % int((train + val) * 0x10000)
        split = F.when(h < cut1, "train").when(h < cut2, "val").otherwise("test")
    return d.select(F.col("review_content").alias("text"), name.alias("label"), "shop_id",
                    plat.alias("platform"), split.alias("split"), F.col("review_id"))


def label_distribution(split_df: DataFrame, split: str = "train") -> DataFrame:
    return split_df.where(F.col("split") == split).groupBy("label").agg(F.count(F.lit(1)).cast("long").alias("count"))


def stratified_split(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """review_id, label, part: md5 threshold inside each label, so both parts
    keep the label mix (up to sampling noise)."""
    lab = F.col("sentiment_label").try_cast("double")
    cut = "%04x" % int((1.0 - test_size) * 0x10000)
    d = df.where(lab.isin(1.0, 0.0, -1.0) & F.col("review_content").isNotNull())
    return d.select("review_id", lab.cast("int").alias("label"),
                    F.when(hash_bucket(F.col("review_id")) < cut, "train").otherwise("test").alias("part"))


# ------------------------------------------------------------------ TXT-8c
def class_weights(labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights n / (k * n_class), one row per class (k rows)."""
    g = labels.groupBy(label_col).agg(F.count(F.lit(1)).cast("long").alias("count"))
    tot = g.agg(F.sum("count").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return with_scalars(g, tot).select(label_col, "count",
                                       rnd(F.col("_n") / (F.col("_k") * F.col("count")), 6).alias("weight"))


# ------------------------------------------------------------------ TXT-8d
def classification_report(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Per class precision, recall, f1, support from confusion counts, plus
    'macro avg', 'weighted avg' and 'accuracy' rows (4 digits)."""
    c = pred.groupBy(F.col(label_col).cast("string").alias("t"), F.col(pred_col).cast("string").alias("p")).count()
    classes = c.select(F.col("t").alias("cls")).union(c.select(F.col("p").alias("cls"))).distinct()
    tp = c.where(F.col("t") == F.col("p")).select(F.col("t").alias("cls"), F.col("count").alias("tp"))
    sup = c.groupBy(F.col("t").alias("cls")).agg(F.sum("count").alias("support"))
    prd = c.groupBy(F.col("p").alias("cls")).agg(F.sum("count").alias("predicted"))
    m = (classes.join(tp, "cls", "left").join(sup, "cls", "left").join(prd, "cls", "left")
         .fillna(0, ["tp", "support", "predicted"]))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    m = m.withColumn("precision", prec).withColumn("recall", rec)
    m = m.withColumn("f1", F.when((F.col("precision") + F.col("recall")) > 0,
                                  F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(F.lit(0.0)))
    tot = m.agg(F.sum("support").alias("_n"), F.sum("tp").alias("_tp"))
    per = m.select("cls", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    macro = m.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                  F.avg("f1").alias("f1"), F.sum("support").cast("long").alias("support"))
    weighted = m.agg(F.lit("weighted avg").alias("cls"),
                     (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                     (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
                     F.sum("support").cast("long").alias("support"))
    acc = tot.select(F.lit("accuracy").alias("cls"), (F.col("_tp") / F.col("_n")).alias("precision"),
                     (F.col("_tp") / F.col("_n")).alias("recall"), (F.col("_tp") / F.col("_n")).alias("f1"),
                     F.col("_n").cast("long").alias("support"))
    out = per.unionByName(macro).unionByName(weighted).unionByName(acc)
    return out.select(F.col("cls").alias("class"), rnd(F.col("precision"), 4).alias("precision"),
                      rnd(F.col("recall"), 4).alias("recall"), rnd(F.col("f1"), 4).alias("f1"), "support")


# ------------------------------------------------------------------ TXT-10 / NBK-17
ASPECT_SCHEMA = "struct<aspect:string,sentiment:string,opinion:string>"


def aspect_rows(df: DataFrame) -> DataFrame:
    """text, aspect, sentiment, shop_id, stars: one row per object of the
    JSON array in ``absa_aspects`` that has a non-empty aspect.  Empty text,
    empty / bad / non-array JSON are skipped; a non-object element skips
    only itself (elements are parsed one by one)."""
    raw = F.col("absa_aspects")
    text = F.col("review_content")
    is_arr = F.trim(raw).startswith("[") & F.json_array_length(raw).isNotNull()
    d = df.where((F.coalesce(text, F.lit("")) != "") & (F.coalesce(raw, F.lit("")) != "") & is_arr)
    sent = F.col("sentiment") if has(df, "sentiment") else F.lit("neutral")
    stars = F.col("review_score") if has(df, "review_score") else F.lit(3.0)
    e = d.select(text.alias("text"), sent.alias("sentiment"), F.col("shop_id"), stars.alias("stars"),
                 F.explode(F.from_json(raw, "array<string>")).alias("_e"))
    e = e.where(F.trim(F.col("_e")).startswith("{")).withColumn("_o", F.from_json(F.col("_e"), ASPECT_SCHEMA))
    return e.where(F.coalesce(F.col("_o.aspect"), F.lit("")) != "").select(
        "text", F.col("_o.aspect").alias("aspect"), "sentiment", "shop_id", "stars")


def aspect_pivot(rows: DataFrame) -> DataFrame:
    """aspect x sentiment counts with 0 fill (fixed pivot values, so no
    extra job to discover them)."""
    return (rows.groupBy("aspect").pivot("sentiment", ["negative", "neutral", "positive"])
                .agg(F.count(F.lit(1)).cast("long")).fillna(0))


# ------------------------------------------------------------------ TXT-8a
TFIDF_TOKEN = "[a-zA-Z]{3,}"
HEAVY_SHARE = 0.01


def tfidf_terms(df: DataFrame, id_col: str = "review_id", min_df: int = 1, digits: int = 6,
                heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Relational TF-IDF: sublinear tf (1 + ln tf) times smoothed idf
    (ln((1 + n) / (1 + df)) + 1), L2-normalised per document.

    The texts are dealt by document once, and every branch below reuses that
    shuffle: the counts per (document, term) and all sums over a document then
    need none.  Terms in more than ``heavy_share`` of the documents get their idf
    by a broadcast: there are at most (mean number of different terms in a
    document) / heavy_share of them.  Only the rows of the other terms move, to
    their idf and back; no term of that join has more rows than heavy_share of
    the documents.  The norm is made of the two parts' sums of squares.
    """
    # the id filter is explicit so that every branch below has the same
    # canonical plan (a join would otherwise add it to one branch only and
    # defeat exchange reuse)
    d = df.where(F.col("review_content").isNotNull() & F.col(id_col).isNotNull())
    # a given number of partitions: texts grow as they are split, so tasks
    # merged by the size of the texts would have to spill
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = d.select(F.col(id_col).alias("doc"), "review_content").repartition(parts, "doc")
    t = texts.select("doc", F.explode(F.regexp_extract_all(F.lower(F.col("review_content")), F.lit(TFIDF_TOKEN), 0)).alias("term"))
    tf = t.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = tf.groupBy("term").agg(F.count("tf").alias("df")).where(F.col("df") >= min_df)
    n = d.agg(F.count(F.lit(1)).alias("_n"))
    idf = with_scalars(dfreq, n).select(
        "term", (F.col("df") > F.lit(heavy_share) * F.col("_n")).alias("_heavy"),
        (F.log((F.lit(1.0) + F.col("_n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))
    heavy = F.broadcast(idf.where("_heavy").drop("_heavy"))
    weight = ((F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")).alias("w")
    often = tf.join(heavy, "term").select("doc", "term", weight)
    rare = tf.join(heavy, "term", "left_anti").join(idf.where("not _heavy").drop("_heavy"), "term").select("doc", "term", weight)
    square = F.sum(F.col("w") * F.col("w"))

    def normed(part: DataFrame, other: DataFrame) -> DataFrame:
        rest = other.groupBy("doc").agg(square.alias("_rest"))
        own = part.withColumn("_own", square.over(Window.partitionBy("doc")))
        norm = F.sqrt(F.col("_own") + F.coalesce(F.col("_rest"), F.lit(0.0)))
        return own.join(rest, "doc", "left").select(F.col("doc").alias(id_col), "term", rnd(F.col("w") / norm, digits).alias("tfidf"))

    return normed(often, rare).unionByName(normed(rare, often))


# ------------------------------------------------------------------ NBK-11/12
BLOCK_WORDS = 512
STRIP_BLOCKS = 16   # a task holds STRIP_BLOCKS * BLOCK_WORDS ** 2 counts: 32 MB
CELLS = 1 << 22     # of an indicator matrix


def _pair_counter(left: list[str], right: list[str]):
    """Arrow batches of token arrays -> (i, j, c): how many of them hold the
    words i < j of all, one of ``left`` and one of ``right``.  Words are numbered
    in their order, so that numbers sort as words do."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    words = sorted({*left, *right})
    known = pa.array(words, pa.string())
    number = {w: k for k, w in enumerate(words)}
    of_left, of_right = (np.array([number[w] for w in side]) for side in (left, right))

    def count(batches):
        total = np.zeros((len(left), len(right)), np.int64)
        place = np.full((2, len(words)), -1)
        place[0, of_left], place[1, of_right] = np.arange(len(left)), np.arange(len(right))
        step = max(1, CELLS // (len(left) + len(right)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.column(0).slice(at, step)
                owner = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
                word = pc.fill_null(pc.index_in(part.flatten(), known), -1).to_numpy(zero_copy_only=False)
                sides = []
                for k, side in enumerate((left, right)):
                    x = np.zeros((len(part), len(side)), np.float32)
                    to = np.where(word >= 0, place[k][word], -1)
                    x[owner[to >= 0], to[to >= 0]] = 1
                    sides.append(x)
                total += (sides[0].T @ sides[1]).astype(np.int64)  # a part has few rows: exact in float32
        i, j = np.nonzero(total)
        a, b, c = of_left[i], of_right[j], total[i, j]
        # inside the right block both orders of a pair are counted
        keep = (a < b) | ((a > b) & (place[1][a] < 0))
        lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(c[keep])], ["i", "j", "c"])

    return words, count


def cooccurrence(df: DataFrame, top_k: int = 30, lang: str | None = None, stop_words=None,
                 token_col: str | None = None, block: int = BLOCK_WORDS, strip: int = STRIP_BLOCKS) -> DataFrame:
    """word_a, word_b, cooccurrence: the ``top_k`` unordered pairs of tokens that
    occur together in the most reviews, over all words (our definition; ties by
    the words).

    Threshold pruning.  The texts are tokenised once, to a table in the shared
    folder.  The pairs of the ``block`` most frequent words are counted first;
    the count of the ``top_k``-th is a lower bound, and a pair that reaches it
    consists of words found in at least that many reviews.  Further blocks of
    words are counted, each with all blocks before it, as long as their words
    are that frequent; the bound rises on the way.  A task adds up X^T X of
    its reviews' indicator rows, so no pair is emitted per review; the driver
    holds the words of at most ``strip`` + 1 blocks.  Needs jobs of its own to
    find the bound.
    """
    spark = df.sparkSession
    d = df.where(F.col("review_content").isNotNull())
    toks = distinct_tokens(F.col("review_content"), lang, stop_words, given=F.col(token_col) if token_col else None)
    toks = materialize(d.select(toks.alias("t")).where(F.size("t") >= 2), "tokens")
    freq = materialize(toks.select(F.explode("t").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    order = F.struct((-F.col("n")).alias("n"), "word")  # frequent words first

    def words_of(after, upto=None, least: int = 1):
        """At most ``block`` (n, word), in order, behind ``after``; with ``upto`` all up to it."""
        rows = freq.where(F.col("n") >= least)
        for bound, keep in ((after, lambda b: order > b), (upto, lambda b: order <= b)):
            if bound is not None:
                rows = rows.where(keep(F.struct(F.lit(-bound[0]).cast("long").alias("n"), F.lit(bound[1]).alias("word"))))
        return [(r.n, r.word) for r in rows.orderBy(order).limit(block).collect()]

    best = spark.createDataFrame([], "word_a string, word_b string, cooccurrence long")
    least, ends = 1, []  # ends: the last word of each block
    while now := words_of(ends[-1] if ends else None, least=least):
        right = [w for _, w in now]
        ends.append(now[-1])
        borders = [None, *ends]
        for first in range(0, len(ends), strip):
            mine = range(first, min(first + strip, len(ends)))
            left = [w for b in mine for _, w in (now if b == len(ends) - 1 else words_of(borders[b], borders[b + 1]))]
            words, count = _pair_counter(left, right)
            pairs = toks.mapInArrow(count, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("cooccurrence"))
            pairs = pairs.orderBy(F.col("cooccurrence").desc(), "i", "j").limit(top_k)
            names = spark.createDataFrame(list(enumerate(words)), "k int, word string")  # some blocks of words
            for side, k in (("word_a", "i"), ("word_b", "j")):
                pairs = pairs.join(names.select(F.col("k").alias(k), F.col("word").alias(side)), k)
            best = best.unionByName(pairs.select("word_a", "word_b", "cooccurrence"))
            best = materialize(best.orderBy(F.col("cooccurrence").desc(), "word_a", "word_b").limit(top_k), "pairs")
            n, bound = best.agg(F.count(F.lit(1)), F.min("cooccurrence")).first()
            least = max(least, bound) if n == top_k else least
    return best


def cooccurrence_matrix(pairs: DataFrame, top_words: int = 14) -> DataFrame:
    """Symmetric matrix (long form: row_word, col_word, cooccurrence) over
    the words that appear most often in the top pairs."""
    words = pairs.select(F.col("word_a").alias("w")).unionAll(pairs.select(F.col("word_b").alias("w")))
    top = (words.groupBy("w").count().orderBy(F.col("count").desc(), F.col("w")).limit(top_words).select("w"))
    both = pairs.select(F.col("word_a").alias("row_word"), F.col("word_b").alias("col_word"), "cooccurrence") \
        .unionAll(pairs.select(F.col("word_b").alias("row_word"), F.col("word_a").alias("col_word"), "cooccurrence"))
    # top has at most top_words rows
    both = both.join(F.broadcast(top.withColumnRenamed("w", "row_word")), "row_word", "left_semi") \
               .join(F.broadcast(top.withColumnRenamed("w", "col_word")), "col_word", "left_semi")
    return both.groupBy("row_word", "col_word").agg(F.sum("cooccurrence").cast("long").alias("cooccurrence"))
