"""One key holding a third of all rows: results stay exact and whole, and
the per-group top-k spreads the hot group over salted partitions."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from conftest import SF01
from critiq.operators import alerts as al
from critiq.operators import tabular as tab
from critiq.operators import text as tx
from critiq.sources.fixtures import rv_docs, rv_orders


def _hot_docs(spark):
    d = rv_docs(spark, SF01)
    hot = F.when(F.col("review_id").cast("long") % 3 == 0, F.lit("hot")).otherwise(F.col("shop_id"))
    return d.withColumn("shop_id", hot).withColumn("shop_name", hot)


def _tok(t):
    return [w for w in re.findall(r"[a-z']+", (t or "").lower()) if len(w) >= 3 and w not in tx.EN_STOP_WORDS]


def test_hot_shop_keywords_exact(spark):
    df = _hot_docs(spark)
    rows = df.select("shop_id", "review_content").collect()
    assert sum(r.shop_id == "hot" for r in rows) >= len(rows) // 3
    counts = defaultdict(Counter)
    for r in rows:
        counts[r.shop_id].update(_tok(r.review_content))
    exp = {s: sorted(c.items(), key=lambda kv: (-kv[1], kv[0]))[:8] for s, c in counts.items()}
    out = tx.shop_keywords(df, top_n=8, salt_buckets=16)
    got = defaultdict(list)
    for r in out.collect():
        got[r.shop_id].append((r.keyword, r["count"]))
    assert {k: sorted(v, key=lambda kv: (-kv[1], kv[0])) for k, v in got.items()} == exp
    plan = out._jdf.queryExecution().executedPlan().toString()
    # stage 1 ranks inside (shop, bucket): the hot shop is split over buckets
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(shop_id#\d+, _w0#\d+", plan)


def test_hot_shop_rankings_and_alerts_whole(spark):
    o = rv_orders(spark, SF01)
    hot = o.withColumn("shop_id", F.when(F.col("user_id").cast("long") % 3 == 0, F.lit("hot")).otherwise(F.col("shop_id"))) \
           .withColumn("shop_name", F.when(F.col("shop_id") == "hot", F.lit("HOT")).otherwise(F.col("shop_name")))
    r = {x.shop_id: x for x in tab.bayesian_ranking(hot, 1).collect()}
    n_hot = hot.where(F.col("shop_id") == "hot").count()
    assert r["hot"].review_count == n_hot and n_hot > hot.count() // 4
    assert sum(x.review_count for x in r.values()) == hot.count()
    a = al.alerts(hot)
    assert a.where(F.col("shop_id").isNull()).count() == 0
