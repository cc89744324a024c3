"""Alert tiers, boundaries and the first-tier-wins rule."""

from datetime import datetime, timedelta

from critiq.operators import alerts as al

REF = datetime(2024, 3, 31, 12)
SCHEMA = "review_id string, shop_id string, shop_name string, review_time timestamp, sentiment_label int, review_score double"


def _rows(shop, spec):
    return [(f"{shop}{i}", shop, shop.upper(), REF - timedelta(days=d), lab, sc) for i, (d, lab, sc) in enumerate(spec)]


def test_tiers(spark):
    rows = []
    rows += _rows("p0", [(0, -1, 1.0), (0.5, -1, 1.0), (20, 1, 5.0)])                 # 1 d: 2/2
    rows += _rows("p3", [(14, -1, 1.0), (10, 1, 5.0), (9, 1, 5.0), (8, 1, 5.0), (13, -1, 2.0)])  # exact 14-day edge
    rows += _rows("ok", [(0, 1, 5.0), (1, 1, 5.0), (2, 1, 5.0)])
    rows += _rows("few", [(0, -1, 1.0), (0, -1, 1.0)])                               # < 3 dated reviews
    out = {r.shop_id: r for r in al.alerts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {"p0", "p3"}
    assert out["p0"].level == "P0-Crisis" and out["p0"].neg_rate == 100.0
    assert out["p0"].message == "1d negative rate 100% >= threshold"
    assert out["p3"].level == "P3-Track" and out["p3"].neg_rate == 40.0
    assert out["p0"].score == round((1 + 1 + 5) / 3, 2)


def test_levels_and_histogram(spark):
    rows = _rows("a", [(0, -1, 1.0), (0, -1, 1.0), (3, 1, 5.0)]) + _rows("b", [(5, -1, 1.0), (6, 1, 5.0), (6, 1, 4.0), (0, 1, 4.0)])
    a = al.alerts(spark.createDataFrame(rows, SCHEMA))
    lv = {r.level: r.shop_count for r in al.alert_levels(a).collect()}
    assert sum(lv.values()) == a.count()
    h = al.alert_histogram(a).collect()
    assert sum(r.shop_count for r in h) == a.count() and max(r.bin for r in h) <= 20
