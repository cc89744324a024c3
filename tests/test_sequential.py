"""Time series and RFM against small pandas computations."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from critiq.operators import sequential as seq
from critiq.operators.stl import stl


def test_burst_by_hand(spark):
    """Negative reviews of nine days; z of the last day from its own seven-day frame."""
    negatives = [1, 1, 1, 1, 1, 1, 1, 1, 4]
    rows = [(f"{d}-{i}", datetime(2024, 1, 1 + d, i), -1 if i < n else 1) for d, n in enumerate(negatives) for i in range(4)]
    out = seq.burst_detection(spark.createDataFrame(rows, "review_id string, review_time timestamp, sentiment_label int"))
    got = [(r.date, r.total, r.neg, r.z_score, r.alert) for r in out.orderBy("date").collect()]
    assert [g[1:3] for g in got] == [(4, n) for n in negatives] and got[0][0] == "2024-01-01"
    # one day alone has the stand-in deviation; equal days have none, so no z
    assert got[0][3] == 0.0 and all(g[3] is None for g in got[1:8])
    # frame 6 x 0.25 and 1.0: mean 2.5 / 7, deviation sqrt(0.0803571...)
    assert got[8][3] == 2.27 and [g[4] for g in got] == [False] * 8 + [True]


def test_rfm_quartiles_by_hand(spark):
    """Eight users with 1..8 reviews, the last one k days before the end, mean scores 1.0, 1.5 .. 4.5."""
    end = datetime(2024, 6, 30)
    rows = [(f"u{k}-{i}", f"u{k}", end - timedelta(days=8 - k + i), 0.5 + 0.5 * k) for k in range(1, 9) for i in range(k)]
    df = spark.createDataFrame(rows, "review_id string, user_id string, review_time timestamp, review_score double")
    out = {r.user_id: r for r in seq.rfm_segmentation(df).collect()}
    assert [out[f"u{k}"].R for k in range(1, 9)] == [7, 6, 5, 4, 3, 2, 1, 0]
    # edges of 1..8 are 2.75, 4.5, 6.25: two users in each quarter
    want = [1, 1, 2, 2, 3, 3, 4, 4]
    for score in ("R_score", "F_score", "M_score"):
        assert [out[f"u{k}"][score] for k in range(1, 9)] == want, score


def test_exact_quantiles(spark):
    from critiq.functions.num import exact_quantiles
    values = [0.1, 0.1, 0.3, 0.7, 0.7, 0.7, 5.0, 1e9, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "x", probs, "q", zoom=3).first().q
    assert np.allclose(got, np.quantile([v for v in values if v is not None], probs))
    assert exact_quantiles(df.limit(0), "x", [0.5], "q").first().q == [None]


def test_exact_quantiles_of_odd_values(spark):
    from critiq.functions.num import exact_quantiles
    rng = np.random.default_rng(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    cases = [rng.normal(size=500), np.append(rng.normal(3, 1, 400), [1e300, -1e300, 1e-300, 0.0, -0.0]),
             np.exp(rng.normal(0, 60, 300)), 1 + np.arange(300) * 2.0 ** -52, np.full(9, 2.5), -np.arange(100.0), [7.25]]
    for values in cases:
        values = [float(v) for v in values]
        df = spark.createDataFrame([(v,) for v in values * 2], "x double")
        for zoom in (5, 1 << 21):
            got = exact_quantiles(df, "x", probs, "q", zoom=zoom).first().q
            assert np.allclose(got, np.quantile(values * 2, probs), rtol=1e-12, atol=0)


def test_an_outlier_leaves_small_buckets(spark):
    """With one value of 1e300 the others still spread over many buckets."""
    from critiq.functions.num import _magnitude
    df = spark.range(20_000).select((F.col("id") / 4000.0).alias("x")).union(spark.createDataFrame([(1e300,)], "x double"))
    sizes = df.groupBy(_magnitude(F.col("x")).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 20  # ln(2) / 1024 of a value's size at most
    got = df.groupBy(_magnitude(F.col("x")).alias("b")).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))


def test_rfm_collapsed_edges(spark):
    rows = [(f"r{i}", f"u{i}", datetime(2024, 1, 1), 5.0, 1, "s", "S") for i in range(8)]
    df = spark.createDataFrame(rows, "review_id string, user_id string, review_time timestamp, review_score double, sentiment_label int, shop_id string, shop_name string")
    out = seq.rfm_segmentation(df).collect()
    assert {r.R_score for r in out} == {2.0} and {r.F_score for r in out} == {2.0}


def test_whole_days_not_calendar_days(spark):
    rows = [("a", "u1", datetime(2024, 1, 1, 23)), ("b", "u2", datetime(2024, 1, 3, 1))]
    df = spark.createDataFrame(rows, "review_id string, user_id string, review_time timestamp")
    df = df.selectExpr("*", "3.0 as review_score")
    r = {x.user_id: x.R for x in seq.rfm_table(df).collect()}
    assert r == {"u1": 1, "u2": 0}


def test_cma_matches_pandas(spark):
    months = [f"2020-{m:02d}" for m in range(1, 13)] + [f"2021-{m:02d}" for m in range(1, 5)]
    counts = [5, 7, 9, 4, 6, 8, 10, 12, 3, 5, 7, 9, 11, 2, 4, 6]
    m = spark.createDataFrame(list(zip(months, counts, [3.0] * 16)), "year_month string, count long, avg_score double")
    out = seq.cma_decomposition(m).toPandas().sort_values("year_month")
    s = pd.Series(counts, dtype=float)
    trend = s.rolling(12, center=True, min_periods=6).mean()
    assert np.allclose(out.trend.to_numpy(dtype=float), trend.to_numpy(), equal_nan=True)
    assert np.allclose(out.seasonal, s - trend.fillna(s.mean()))


def test_forecast_line(spark):
    months = [f"2020-{m:02d}" for m in range(1, 11)]
    d = spark.createDataFrame([(ym, 1, 1.0, 2.0 * i + 1.0, 0.0, 0.0, "CMA-12") for i, ym in enumerate(months)],
                              "year_month string, count long, avg_score double, trend double, seasonal double, residual double, method string")
    out = seq.forecast_trend(d, steps=3).toPandas().sort_values("year_month")
    fc = out[out.type == "forecast"]
    assert fc.year_month.tolist() == ["2020-11", "2020-12", "2021-01"]
    assert np.allclose(fc.trend, [21.0, 23.0, 25.0]) and fc["count"].tolist() == [21, 23, 25]


def test_stl_properties():
    n = 96
    t = np.arange(n)
    y = 50 + 0.5 * t + 10 * np.sin(2 * np.pi * t / 12)
    y_out = y.copy()
    y_out[40] += 80
    tr, se, re = stl(y)
    assert np.allclose(tr + se + re, y)
    assert np.max(np.abs(tr[12:-12] - (50 + 0.5 * t[12:-12]))) < 1.0
    tr2, se2, re2 = stl(y_out)
    assert re2[40] > 60                        # the outlier lands in the residual
    assert np.max(np.abs(np.delete(tr2 - tr, 40))) < 3.0


def test_stl_grouped_parallel_series(spark):
    from critiq.operators.stl import stl_grouped
    rows = []
    for key in ("a", "b"):
        for i in range(36):
            rows.append((key, f"{2019 + i // 12}-{i % 12 + 1:02d}", int(100 + 10 * np.sin(i / 12 * 2 * np.pi) + i), 3.0))
    m = spark.createDataFrame(rows, "k string, year_month string, count long, avg_score double")
    out = stl_grouped(m, "k").toPandas()
    assert len(out) == 72 and set(out.method) == {"STL"}
    assert np.allclose(out.trend + out.seasonal + out.residual, out["count"])
