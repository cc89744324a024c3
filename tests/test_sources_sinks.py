"""Readers, ETL, sinks and the batch job."""

import hashlib
import json
import os

from critiq.sinks import aspect_lines, write_jsonl_splits
from critiq.sources import etl
from critiq.sources.readers import from_json, hash_sample, load
from critiq.sources.schema import STANDARD_NAMES


def test_category_rules(spark):
    df = spark.createDataFrame([(None,), ("",), ("Restaurants, Pizza",), ("Food, Nightlife",), ("Bars, Thai",),
                                ("Restaurants, Vegan, Food",)], "c string")
    out = [r[0] for r in df.select(etl.category_of(df.c)).collect()]
    assert out == ["Restaurant", "Restaurant", "Pizza", "Restaurant", "Thai", "Vegan"]


def test_raw_to_reviews(spark):
    raw = spark.createDataFrame([("b1", "N", "c", "s", "Pizza", "Rude staff, cold food", "2020-01-02 10:00:00", "user12345", None, 1, 2),
                                 ("b1", "N", "c", "s", "Pizza", "fine", "nonsense", "u2", 0.0, None, None),
                                 ("b2", "M", "c", "s", None, "ok", "2020-01-03", "u3", 2.0, 0, 0)],
                                "business_id string, name string, city string, state string, categories string, text string, "
                                "date string, user_id string, stars_y double, useful int, funny int")
    out = etl.raw_to_reviews(raw).collect()
    assert out[0].review_score == 3.0 and out[0].sentiment == "neutral" and out[0].username == "user12345"
    assert out[0].absa_aspects == '[{"aspect": "food", "sentiment": "neutral"}, {"aspect": "service", "sentiment": "neutral"}]'
    assert out[1].review_time is None and out[1].review_score == 3.0
    assert out[2].sentiment_label == -1 and out[2].category == "Restaurant" and out[2].absa_aspects == "[]"
    assert len(out[0].review_id) == 32


def test_csv_with_bom_and_multiline(spark, tmp_out):
    p = os.path.join(tmp_out, "r.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write('review_id,review_content,review_score\n1,"line one\nline ""two""",4\n2,plain,5\n')
    df = load(spark, p)  # line breaks in quoted fields belong to the text unless the caller says otherwise
    assert df.columns[: len(STANDARD_NAMES)] == STANDARD_NAMES
    rows = {r.review_id: r for r in df.collect()}
    assert len(rows) == 2 and rows["2"].review_content == "plain"
    assert rows["1"].review_content == 'line one\nline "two"'
    flat = os.path.join(tmp_out, "flat.csv")
    with open(flat, "w") as f:
        f.write("review_id,review_content,review_score\n1,one,4\n2,two,5\n")
    assert load(spark, flat, multiline=False).count() == 2


def test_lenient_csv_keeps_texts_with_line_breaks(spark, tmp_out):
    from critiq.sources.readers import from_csv_lenient
    p = os.path.join(tmp_out, "lines.csv")
    with open(p, "w") as f:
        f.write('text,stars_y,useful\n"first\nsecond, third",4.0,1\nfine,3.0,2\nbad row,notanumber,x\n')
    schema = spark.createDataFrame([], "text string, stars_y double, useful int").schema
    assert sorted(r.text for r in from_csv_lenient(spark, p, schema=schema).collect()) == ["fine", "first\nsecond, third"]


def test_json_wrappers(spark, tmp_out):
    for i, doc in enumerate([[{"review_id": "a", "user": {"id": "u"}}], {"reviews": [{"review_id": "b"}]},
                             {"data": [{"review_id": "c"}]}]):
        p = os.path.join(tmp_out, f"j{i}.json")
        with open(p, "w") as f:
            json.dump(doc, f)
        df = from_json(spark, p)
        assert df.count() == 1 and df.first().review_id in "abc"
    assert "user.id" in from_json(spark, os.path.join(tmp_out, "j0.json")).columns


def test_hash_sample_is_deterministic(spark):
    df = spark.range(1000).selectExpr("CAST(id AS STRING) AS review_id")
    a = sorted(r.review_id for r in hash_sample(df, "review_id", 10).collect())
    b = sorted(r.review_id for r in hash_sample(df.repartition(7), "review_id", 10).collect())
    assert a == b and len(a) == 10


def test_sinks(spark, tmp_out):
    rows = spark.createDataFrame([("t1", "food", "positive", "train"), ("t2", "x", "weird", "test")],
                                 "text string, aspect string, sentiment string, split string")
    lines = [r.line for r in aspect_lines(rows).collect()]
    assert lines == ["t1$Positive$food", "t2$Neutral$x"]
    write_jsonl_splits(rows, os.path.join(tmp_out, "ds"))
    assert {"split=test", "split=train"} <= set(os.listdir(os.path.join(tmp_out, "ds")))


def test_job_run(spark, tmp_out):
    from conftest import SF
    from critiq.plans.job import run
    from critiq.sources.fixtures import rv_orders
    src = os.path.join(tmp_out, "src.parquet")
    rv_orders(spark, SF, with_text=True).write.parquet(src)
    man = run(spark, src, os.path.join(tmp_out, "out"), modules=("tabular", "sequential", "strategy"), with_models=False)
    names = {r.name for r in man.collect()}
    assert {"eda", "wilson_ranking", "burst", "rfm", "alerts"} <= names
    md = open([os.path.join(tmp_out, "out", "report_md", f) for f in os.listdir(os.path.join(tmp_out, "out", "report_md"))
               if f.startswith("part-")][0]).read()
    assert md.startswith("# Review Analysis Report")


def test_lenient_csv(spark, tmp_out):
    from critiq.sources.readers import from_csv_lenient
    p = os.path.join(tmp_out, "raw.csv")
    with open(p, "w") as f:
        f.write("text,stars_y,useful\nfine,4.0,1\n,5.0,2\nno stars,,3\nbad row,notanumber,x\n")
    schema = "text string, stars_y double, useful int"
    df = from_csv_lenient(spark, p, schema=spark.createDataFrame([], schema).schema)
    assert [r.text for r in df.collect()] == ["fine"]


def test_profile(spark):
    from critiq.sources import profile
    df = spark.createDataFrame([("a", "x", 1.0), ("b", None, 3.0), ("a", None, None)],
                               "platform string, sentiment string, review_score double")
    v = {(r.column, r.value): (r["count"], r.pct) for r in profile.value_shares(df).collect()}
    assert v[("platform", "a")] == (2, 66.7) and v[("sentiment", "x")] == (1, 33.3)
    n = {r.column: r.null_count for r in profile.null_counts(df).collect()}
    assert n == {"sentiment": 2, "review_score": 1}
    s = profile.score_stats(df).first()
    assert (s.rows, s.columns, s.mean_score, s.median_score) == (3, 3, 2.0, 2.0)


def test_dispatch_errors_and_fraction_sample(spark):
    import pytest
    from critiq.sources.readers import fraction_sample
    with pytest.raises(ValueError):
        load(spark, "reviews.xlsx")
    df = spark.range(20000).selectExpr("CAST(id AS STRING) AS review_id")
    a = fraction_sample(df, 0.1, "review_id")
    b = fraction_sample(df.repartition(5), 0.1, "review_id")
    ids_a = sorted(r.review_id for r in a.collect())
    assert ids_a == sorted(r.review_id for r in b.collect())
    assert 1600 < len(ids_a) < 2400


def test_shop_dimension_takes_the_first_review_by_time_and_id(spark):
    rows = [("b", "N", f"c{u}", "Food", f"a{u}", d, u, 4.0, 7) for u, d in
            [("u1", "2020-01-01 00:00:00"), ("u2", "2020-01-01 00:00:00"), ("u3", "2020-01-01 00:00:00"), ("u4", "2020-01-02 00:00:00"), ("u5", "bad")]]
    raw = spark.createDataFrame(rows, "business_id string, name string, city string, categories string, address string, date string, "
                                      "user_id string, stars_x double, review_count int").selectExpr("*", "'S' AS state")
    key = {u: hashlib.md5(f"b|{u}|2020-01-01 00:00:00".encode()).hexdigest() for u in ("u1", "u2", "u3")}
    first = min(key, key=key.get)
    assert first != "u1"  # the least attributes are those of another review
    assert [(r.shop_id, r.city, r.address) for r in etl.shop_dimension(raw).collect()] == [("b", f"c{first}", f"a{first}")]
