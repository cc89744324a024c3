"""Results do not depend on partitioning: every query
with an oracle gives the same rows with 3 and with 11 shuffle partitions."""

import math

import __spark_entry__ as ent
from conftest import SF


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def _rows(df):
    return sorted(tuple(_norm(x) for x in r) for r in df.collect())


def test_partition_count_does_not_change_results(spark):
    qs, orc = ent.queries(), [n for n in ent.oracle_sql() if not n.startswith("op")]   # op queries: tests of their own
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        res = {}
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.catalog.clearCache()
            res[parts] = {n: _rows(qs[n](spark, SF)) for n in orc}
        diff = [n for n in orc if res["3"][n] != res["11"][n]]
        assert not diff, diff
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
