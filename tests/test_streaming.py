"""Streaming alert windows agree with the same windows computed in batch."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import SF01
from critiq.sources.fixtures import rv_events
from critiq.streaming.alerts import windowed_negative_rates


def test_stream_windows_match_batch(spark, tmp_out):
    src = os.path.join(tmp_out, "events")
    ev = rv_events(spark, SF01).select("review_id", "shop_id", "review_time", "sentiment_label")
    ev.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (windowed_negative_rates(stream, days=3, watermark="365 days").writeStream.outputMode("complete")
         .format("memory").queryName("neg_windows").option("checkpointLocation", os.path.join(tmp_out, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM neg_windows")
    exp = windowed_negative_rates(ev, days=3, watermark="365 days")
    key = ["shop_id", "window_start"]
    a = got.orderBy(*key).collect()
    b = exp.orderBy(*key).collect()
    assert len(a) == len(b) > 0
    assert all(x.reviews == y.reviews and x.negatives == y.negatives for x, y in zip(a, b))


def test_stream_scoring_matches_batch(spark, tmp_out):
    from critiq.operators import ml
    from critiq.sources.fixtures import rv_docs
    from critiq.streaming.scoring import score
    docs = rv_docs(spark, SF01).select("review_id", "review_content", "sentiment_label")
    m = ml.sentiment_classifier(docs, max_iter=20)
    src = os.path.join(tmp_out, "docs")
    docs.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (score(stream, m.model).select("review_id", "predicted_label").writeStream.format("memory")
         .queryName("scored").option("checkpointLocation", os.path.join(tmp_out, "ck2")).start())
    q.processAllAvailable()
    q.stop()
    got = {r.review_id: r.predicted_label for r in spark.sql("SELECT * FROM scored").collect()}
    exp = {r.review_id: r.predicted_label for r in score(docs, m.model).collect()}
    assert got == exp and len(got) == 1000


def test_tier_alert_stream_append(spark, tmp_out):
    from critiq.streaming.alerts import start
    src = os.path.join(tmp_out, "events3")
    ev = rv_events(spark, SF01).select("review_id", "shop_id", "review_time", "sentiment_label")
    ev.repartition(6).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = start(stream, os.path.join(tmp_out, "ck3"), "tier_p3", level="P3", path=os.path.join(tmp_out, "tier_p3"))
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(os.path.join(tmp_out, "tier_p3")).collect()
    assert out, "closed windows past the watermark are emitted"
    assert all(r.neg_rate >= 0.20 and r.reviews >= 2 and r.level == "P3-Track" for r in out)


def _latest(rows):
    """The newest row of each shop among those that a stream has emitted."""
    out = {}
    for r in sorted(rows, key=lambda r: r.evaluated_at):
        out[r.shop_id] = r
    return out


COLUMNS = ("level", "shop_name", "score", "neg_rate", "message", "action", "severity")


def _streamed(spark, files, schema, tmp_out, name, delay):
    """latest_alerts over the files, one a batch, in order; what it has emitted."""
    from critiq.streaming.alerts import latest_alerts
    src = os.path.join(tmp_out, name)
    os.makedirs(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = (latest_alerts(stream, delay=delay).writeStream.outputMode("update").format("memory").queryName(name)
         .option("checkpointLocation", os.path.join(tmp_out, f"ck_{name}")).start())
    for k, df in enumerate(files):
        df.coalesce(1).write.parquet(f"{src}/{k:03d}")
        q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_latest_alerts_equal_the_batch_alerts(spark, tmp_out):
    from critiq.operators.alerts import alerts
    ev = rv_events(spark, SF01).select("review_id", "shop_id", "shop_name", "review_time", "review_score", "sentiment_label")
    ev = ev.withColumn("review_time", F.date_trunc("second", F.col("review_time").cast("timestamp")))
    parts = []
    bounds = [r.t for r in ev.agg(F.expr("percentile_approx(review_time, array(0.25, 0.5, 0.9)) t")).collect()][0]
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        d = ev if lo is None else ev.where(F.col("review_time") > F.lit(lo))
        parts.append(d if hi is None else d.where(F.col("review_time") <= F.lit(hi)))
    out = _streamed(spark, parts, ev.schema, tmp_out, "latest_events", timedelta(0))
    got = {s: tuple(r[c] for c in COLUMNS) for s, r in _latest(out).items() if r.level}
    want = {r.shop_id: tuple(r[c] for c in COLUMNS) for r in alerts(ev).collect()}
    assert got == want and len(want) > 10


def test_latest_alerts_rise_and_clear(spark, tmp_out):
    t0 = datetime(2024, 5, 1, 12)
    schema = "review_id string, shop_id string, shop_name string, review_time timestamp, review_score double, sentiment_label int"

    def batch(*rows):
        return spark.createDataFrame([(f"{s}{d}{k}", s, s and s.upper(), t0 + timedelta(days=d), 3.0, lab) for k, (s, d, lab) in enumerate(rows)], schema)

    files = [batch(("a", 0, 1), ("a", 0, 1), ("a", 0, -1), ("b", 0, -1)),
             batch(("a", 1, -1), ("a", 1, -1), ("b", 1, 1)),
             batch((None, 6, 1), ("b", 5.5, 1)),   # out of order, within the delay
             batch((None, 40, 1))]
    out = _streamed(spark, files, spark.createDataFrame([], schema).schema, tmp_out, "rise", timedelta(days=1))
    rows = {s: [r.level for r in sorted(out, key=lambda r: r.evaluated_at) if r.shop_id == s] for s in "ab"}
    # a: 1 of 3 within a week, then 2 of 2 within a day, then 3 of 5 within a week, then nothing recent
    assert rows == {"a": ["P2-Watch", "P0-Crisis", "P2-Watch", None], "b": ["P2-Watch", None]}
