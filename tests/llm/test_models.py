"""Toxicity and language ID: held-out accuracy, and what the models do with odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from critiq.llm import language_id, toxicity
from critiq.llm.queries import QUERIES

SF01 = "/root/testdata/sf0.01"
RUDE = ["blockhead", "nincompoop", "scoundrel"]


def sentences(rng, n, rude):
    for _ in range(n):
        words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 8))) for _ in range(rng.randint(20, 200))]
        for k in range(len(words) if rude else 0):
            if rng.random() < 0.03 or k == 5:
                words[k] = rng.choice(RUDE)
        yield " ".join(words)


def test_toxicity_learns_and_meets_misspellings():
    rng = random.Random(4)
    texts = [*sentences(rng, 150, True), *sentences(rng, 300, False)]
    model = toxicity.fit(texts, [1] * 150 + [0] * 300)
    score = lambda t: model.score(t, {})
    fresh = [score(t) for t in sentences(rng, 60, True)], [score(t) for t in sentences(rng, 60, False)]
    assert np.mean(np.array(fresh[0]) >= 0.7) > 0.9 and np.mean(np.array(fresh[1]) >= 0.7) < 0.05
    assert score("you blokhead nincompooop") > 0.7 > score("you fine person")
    long = " ".join(sentences(rng, 60, False))
    assert score(long) < 0.7 <= score(long + " what a blockhead, a scoundrel and nincompoop")
    assert score(None) == score("") == score("?!") < 0.7
    assert score("x" * 100_000) <= 0.7


def test_toxicity_without_two_labels():
    assert 0 < toxicity.fit([], []).score("a", {}) < 1
    assert toxicity.fit(["a b"], [1]).score("a", {}) > 0.5 > toxicity.fit(["a b"], [0]).score("a", {})


def test_toxicity_frame(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (1, None, "s"), (None, "", "t")], "doc_id long, text string, score string")
    got = toxicity.toxicity_scores(docs, toxicity.fit(["a b"], [0]))
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 3 and dict(got.dtypes)["score"] == "double"
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    sample = toxicity.training_sample(texts, labels, "doc_id", "text", "toxic", 10).collect()
    assert [(r.id, r.y) for r in sample] == [(1, 1)]
    assert toxicity.toxicity_scores(docs.limit(0), toxicity.train(docs.limit(0).drop("score"), labels.limit(0))).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    got = QUERIES["op1_toxicity"](spark, SF01).toPandas().set_index("doc_id")
    assert len(got) == pq.read_metadata(f"{SF01}/documents.parquet").num_rows
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index])
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    labels = pq.read_table(f"{SF01}/labels.parquet").to_pandas().set_index("doc_id").join(got)
    held = labels[labels.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.6 and held[held.toxic == 0].predicted.mean() < 0.03


def test_language_query_on_held_out_rows(spark):
    got = QUERIES["op6_language_id"](spark, SF01).toPandas().set_index("doc_id")
    docs = pq.read_table(f"{SF01}/documents.parquet", columns=["doc_id", "lang"]).to_pandas().set_index("doc_id").join(got)
    assert all(docs.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.index])
    assert (docs.lang == docs.lang_pred)[docs.held_out].mean() > 0.98


def test_language_model_is_sparse_and_calibrated():
    rng = random.Random(5)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    texts, langs = [], []
    for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "дежзик")):
        texts += [make(letters) for _ in range(60)]
        langs += [lang] * 60
    model = language_id.fit(texts, langs)
    assert (model.weights == 0).mean() > 0.5
    fresh = [(make("abcdefgh"), "aa"), (make("efghijkl"), "bb"), (make("дежзик"), "cc")]
    assert [model.predict(t)[0] for t, _ in fresh] == [v for _, v in fresh]
    assert all(0 <= model.predict(t)[1] <= 1 for t, _ in fresh)


def test_language_odd_texts(spark):
    model = language_id.fit(["abc abc", "xyz xyz"] * 20, ["aa", "xx"] * 20)
    docs = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (3, "12 !?", "q"), (None, "abc", "q"), (5, "xyz " * 300_000, "q")], "doc_id long, text string, score string")
    got = sorted((str(r.doc_id), r.lang_pred) for r in language_id.languages(docs, model).collect())
    assert got == [("1", "und"), ("2", "und"), ("3", "und"), ("5", "xx"), ("None", "aa")]
    assert language_id.fit([], []).predict("abc") == ("und", 0.0)
    none = language_id.train(docs.limit(0).withColumnRenamed("score", "lang"))
    assert language_id.languages(docs.limit(0), none).count() == 0


def test_counts_of_pieces_add_up(monkeypatch):
    text = "Ünïcode text — " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "PIECE", 37)
    assert np.array_equal(whole, language_id.counts(text))
    assert whole.sum() == sum(len(text) - n + 1 for n in range(1, 5))


def plain_features(text):
    """Hashed n-grams of a text, one by one, in whole numbers of 32 bits."""
    low, seen = (1 << 32) - 1, {}
    points = [ord(c) for c in text.lower()]
    for k in range(len(points)):
        h = 0
        for n in range(1, 5):
            if k + n > len(points):
                break
            h = (h * 0x01000193 & low) ^ (points[k + n - 1] * 0x9E3779B1 & low)
            m = ((h ^ h >> 15) * 0x85EBCA6B & low) >> 17
            seen[m] = seen.get(m, 0) + 1
    return seen


def test_language_query_equals_a_plain_reading_of_its_model(spark):
    """The registered query's predictions, from the model's weights by loops over each text's n-grams."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    model = language_id.train(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op6_language_id"](spark, SF01).collect()}
    rows = docs.filter("length(text) < 1500").orderBy("doc_id").limit(60).collect()
    assert len(rows) == 60
    for r in rows:
        x = {f: n * model.idf[f] for f, n in plain_features(r.text).items()}
        size = sum(v * v for v in x.values()) ** 0.5
        logits = [(sum(v * model.weights[f, k] for f, v in x.items()) / size + model.bias[k]) / model.temperature for k in range(len(model.languages))]
        p = np.exp(np.array(logits) - max(logits))
        best = int(np.argmax(p))
        assert got[r.doc_id][0] == model.languages[best] and abs(got[r.doc_id][1] - p[best] / p.sum()) < 1e-9


def test_language_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    rows = [(k, f"text number {k} of the big one", "big") for k in range(4000)] + [(k, f"text {k}", lang) for lang in ("mid", "low") for k in range(60)]
    rows += [(k, "rare text", "rare") for k in range(9)] + [(1, "the same row", "mid")] * 500 + [(None, "x", "mid"), (5, "x", None), (6, "", "mid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = Counter(r.lang for r in language_id.training_sample(docs, "doc_id", "text", "lang", 100).collect())
    assert set(sizes) == {"big", "mid", "low"} and 120 < sizes["big"] < 240 and sizes["low"] == 60 and sizes["mid"] <= 61


def test_twenty_languages_in_little_memory():
    import tracemalloc

    rng = random.Random(9)
    texts, langs = [], []
    for k in range(20):
        letters = "".join(chr(0x400 + 11 * k + j) for j in range(14))
        texts += [" ".join("".join(rng.choices(letters, k=6)) for _ in range(150)) for _ in range(40)]
        langs += [f"l{k:02d}"] * 40
    tracemalloc.start()
    model = language_id.fit(texts, langs, passes=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(model.languages) == 20
    assert all(model.predict(texts[40 * k])[0] == f"l{k:02d}" for k in range(20))


def plain_score(model, text):
    """Chance of label 1, window by window and subword by subword."""
    import math
    import re

    words = re.findall(r"\w+", (text or "").lower())
    logit = model.bias
    if words:
        value = []
        for w in words:
            m = f"<{w}>"
            grams = {m[i : i + n] for n in (3, 4, 5) for i in range(len(m) - n + 1)} | {m}
            value.append(sum(model.value[zlib.crc32(g.encode()) % toxicity.BUCKETS] for g in grams) / len(grams))
        w = toxicity.WINDOW
        starts = [0] if len(words) <= w else [*range(0, len(words) - w, w // 2), len(words) - w]
        logit += max(sum(value[s : s + w]) / len(value[s : s + w]) for s in starts)
    return 1 / (1 + math.exp(-max(-50, min(50, logit))))


def test_toxicity_query_equals_a_plain_reading_of_its_model(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    model = toxicity.train(docs, labels.filter("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"))
    got = {r.doc_id: r.score for r in QUERIES["op1_toxicity"](spark, SF01).collect()}
    rows = docs.orderBy("doc_id").limit(150).collect()
    assert max(abs(got[r.doc_id] - plain_score(model, r.text)) for r in rows) < 1e-9
    assert sum(got[r.doc_id] >= 0.7 for r in rows) > 0
