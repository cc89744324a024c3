"""Decontamination against a plain search for substituted passages."""

import random

from critiq.llm import decontaminate
from critiq.llm.decontaminate import MASKS, SPAN, contamination, overlaps

rng = random.Random(6)
WORDS = ["".join(rng.choices("abcdefghiklmnoprst", k=rng.randint(2, 7))) for _ in range(3000)]


def passage(n):
    return rng.choices(WORDS, k=n)


def test_passages_with_substitutions(spark):
    items = {k: passage(n) for k, n in enumerate([9, 12, 15, 20, 30, 60])}
    docs, want = [], {}
    for k, item in items.items():
        for every in (0, 4, 5, 6, 8, 11):
            for before in (0, 3, 50):
                copy = [w if not every or (j + 2) % every else "changed" for j, w in enumerate(item)]
                equal = sum(a == b for a, b in zip(copy, item))
                docs.append((len(docs), " ".join([*passage(before), *copy, *passage(30)]).title().replace(" ", ", ")))
                if len(item) >= 15 and equal / len(item) >= 0.75 or not every:  # shorter ones may miss every mask
                    want[len(docs) - 1] = k
        docs.append((len(docs), " ".join(passage(200))))
    bench = spark.createDataFrame([(k, " ".join(v), "x") for k, v in items.items()], "item_id long, text string, id string")
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string")
    found = {(r.doc_id, r.item_id) for r in overlaps(frame, bench).collect()}
    assert {(d, k) for d, k in want.items()} <= found
    assert all(docs[d][0] == d and d % 19 != 18 for d, _ in found)


def test_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, None), (3, "too short"), (None, "a b c d e f g h i j")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "A b, c d e f g h i j"), (1, "other"), (None, "a b c d e f g h i j"), (3, None), (4, ""), (5, "z " * 200_000 + "a b c d e f g h i j")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.contaminated, r.n_items, r.best_share) for r in contamination(docs, bench).collect())
    assert got == [("1", True, 1, 1.0), ("1", True, 1, 1.0), ("3", False, 0, 0.0), ("4", False, 0, 0.0), ("5", True, 1, 1.0), ("None", False, 0, 0.0)]
    assert contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "one two three four five six seven eight."), (3, "中国的首都是哪里？"), (4, "東京タワーの高さは何メートルですか"), (5, "กรุงเทพ"), (6, " ... "), (7, "yes")]
    docs = [
        (1, "He asked: who WROTE hamlet, and left"), (2, "who wrote the Hamlet"), (3, "zero one two three four five six seven eight nine"), (4, "one two three four five six seven nine"),
        (5, "问题：中国的首都是哪里？答案"), (6, "昨日友人が東京タワーの高さは何メートルですかと聞いた"), (7, "ไปกรุงเทพวันนี้"), (8, "中国的首都"), (9, "yesterday ... "), (10, "who wrote hamlet"), (11, "Yes"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.share) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert got == [(1, 1, 1.0), (3, 2, 1.0), (5, 3, 1.0), (6, 4, 1.0), (7, 5, 1.0), (10, 1, 1.0), (11, 7, 1.0)]
    plan = overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_masks_and_plan(spark):
    assert all(len(m) == SPAN and m[0] == m[-1] == "1" for m in MASKS)
    for every in (4, 5, 6):  # one substitution in so many leaves a mask without any
        assert any(all(m[j] == "0" for j in range(SPAN) if (j + shift) % every == 0) for m in MASKS for shift in range(every))
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = contamination(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _found(spark, items, docs):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r.doc_id, r.item_id, round(r.share, 6)) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())


def test_word_for_word_copies_have_the_share_one(spark):
    items = [(k, " ".join(passage(n)) + ".") for k, n in enumerate([9, 10, 13, 20, 40])]
    docs = [(k, f"Start: {' '.join(passage(5))} {t} {' '.join(passage(7))}!") for k, t in items] + [(10 + k, t) for k, t in items]
    assert _found(spark, items, docs) == sorted([(k, k, 1.0) for k, _ in items] + [(10 + k, k, 1.0) for k, _ in items])


def test_a_large_benchmark_is_joined_by_its_seeds(spark, monkeypatch):
    items = [(k % 30, " ".join(passage(rng.choice([9, 14, 25, 60])))) for k in range(40)] + [(99, "too short")]
    docs = [(k, " ".join([*passage(20), *(w if rng.random() > 0.08 else "changed" for w in items[k % 40][1].split()), *passage(20)])) for k in range(80)]
    docs += [(200, items[0][1]), (200, "other words"), (201, "it was too short")]
    want = _found(spark, items, docs)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert _found(spark, items, docs) == want and len(want) > 60


def test_recall_of_items_of_nine_to_fourteen_tokens(spark):
    """One changed token at each place: the masks' gaps let most of them through; measured, and none is found wrongly."""
    found = tried = 0
    items, docs, truth = [], [], {}
    for n in range(9, 15):
        item = passage(n)
        items.append((n, " ".join(item)))
        for j in range(n):
            copy = [w if k != j else "changed" for k, w in enumerate(item)]
            truth[len(docs)] = n
            docs.append((len(docs), " ".join([*passage(10), *copy, *passage(10)])))
    got = {(d, i) for d, i, _ in _found(spark, items, docs)}
    assert all(truth[d] == i for d, i in got)
    share = {n: sum((d, n) in got for d, i in truth.items() if i == n) / n for n in range(9, 15)}
    assert share[9] >= 4 / 9 - 1e-9 and share[14] >= 0.9 and sum(share.values()) / 6 > 0.65, share
