"""Rankings, summary and correlation on hand-made tables."""

import math
from datetime import datetime

import numpy as np
import pandas as pd

from critiq.operators import tabular as tab


def _reviews(spark, rows):
    schema = "review_id string, shop_id string, shop_name string, review_score double, sentiment_label int, " \
             "review_time timestamp, city string, category string, content_len int"
    return spark.createDataFrame(rows, schema)


def _rows():
    t = datetime(2024, 1, 1)
    rows = []
    for i in range(6):
        rows.append((f"a{i}", "S1", "One", 5.0, 1, t, "X" if i else None, "cafe", 100))
    for i in range(5):
        rows.append((f"b{i}", "S2", "Two", [1.0, 2.0, 1.0, 3.0, 1.0][i], -1, t, "Y", "bar", 30))
    for i in range(3):
        rows.append((f"c{i}", "S3", "Three", 4.0, 1, t, "Z", "pub", 10))
    return rows


def test_bayes_against_pandas(spark):
    df = _reviews(spark, _rows())
    out = tab.bayesian_ranking(df, min_reviews=5).toPandas().set_index("shop_id")
    pdf = pd.DataFrame(_rows(), columns=["review_id", "shop_id", "shop_name", "review_score", "lab", "t", "city", "cat", "len"])
    mu = pdf.review_score.mean()
    g = pdf.groupby("shop_id").review_score.agg(["count", "mean"])
    g = g[g["count"] >= 5]
    exp = (mu * 30 + g["mean"] * g["count"]) / (30 + g["count"])
    assert set(out.index) == {"S1", "S2"}
    for s in out.index:
        assert abs(out.loc[s, "bayes_score"] - exp[s]) < 5e-4
    assert out.loc["S1", "bayes_rank"] == 1 and out.loc["S2", "bayes_rank"] == 2
    assert out.loc["S2", "neg_rate"] == 100.0
    # "first" skips the null city of the earliest row
    assert out.loc["S1", "city"] == "X"


def test_wilson_formula(spark):
    df = _reviews(spark, _rows())
    out = tab.wilson_ranking(df, min_reviews=3).toPandas().set_index("shop_id")
    z = 1.96
    for s, n, avg in [("S1", 6, 5.0), ("S3", 3, 4.0)]:
        p = min(max((avg - 1) / 4, 0), 1)
        lo = ((p + z * z / (2 * n)) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        assert abs(out.loc[s, "wilson_lower"] - round(lo, 4)) < 1e-9
    assert (out["rank_drift"] == out["bayes_rank"] - out["wilson_rank"]).all()
    assert out["wilson_rank"].min() == 1


def test_two_names_one_shop_no_row_multiplication(spark):
    rows = _rows() + [("d0", "S1", "Uno", 5.0, 1, datetime(2024, 1, 2), "X", "cafe", 1)] * 1
    df = _reviews(spark, rows)
    out = tab.wilson_ranking(df, min_reviews=1).toPandas()
    assert len(out) == len(out[["shop_id", "shop_name"]].drop_duplicates())


def test_dense_rank_ties(spark):
    rows = [(f"x{i}", f"S{i % 4}", f"N{i % 4}", 4.0 if i % 4 < 2 else 3.0, 1, datetime(2024, 1, 1), "c", "k", 1)
            for i in range(40)]
    out = tab.bayesian_ranking(_reviews(spark, rows), 5).toPandas()
    assert sorted(out.bayes_rank.unique().tolist()) == [1, 2]


def test_eda_summary(spark):
    df = _reviews(spark, _rows())
    out = dict(tab.eda_summary(df).collect())
    assert out["reviews"] == 14 and out["shops"] == 3
    sc = np.array([r[3] for r in _rows()])
    assert abs(out["mean_score"] - round(sc.mean(), 3)) < 1e-9
    assert abs(out["score_std"] - round(sc.std(ddof=1), 3)) < 1e-9


def test_correlation_constant_column_is_null(spark):
    rows = [(float(i), 1.0, float(i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "review_score double, like_count double, reply_count double")
    out = {(r.row, r.col): r.r for r in tab.correlation(df).collect()}
    assert out[("review_score", "like_count")] is None
    exp = np.corrcoef([r[0] for r in rows], [r[2] for r in rows])[0, 1]
    assert abs(out[("review_score", "reply_count")] - round(exp, 3)) < 1e-9
    assert out[("review_score", "review_score")] == 1.0


def test_first_attributes_by_time_and_review_id(spark):
    t = datetime(2024, 1, 1)
    rows = [("r2", "S1", "One", 4.0, 1, t, "B", "bar", 1), ("r1", "S1", "One", 4.0, 1, t, "C", None, 1),
            ("r3", "S1", "One", 4.0, 1, t, "A", "cafe", 1), ("r0", "S1", "One", 4.0, 1, datetime(2024, 1, 2), "D", "aaa", 1)]
    for ranking in (tab.bayesian_ranking, tab.wilson_ranking):
        out = ranking(_reviews(spark, rows), min_reviews=1).collect()
        assert [(r.review_count, r.city, r.category) for r in out] == [(4, "C", "bar")]


def test_ranking_sql_orders_by_review_id():
    from critiq.plans.catalog import ORACLES
    for name in ("bayesian_ranking", "wilson_ranking", "top_ranking"):
        assert "arg_min(category, ((review_time, review_id), category))" in ORACLES[name]
