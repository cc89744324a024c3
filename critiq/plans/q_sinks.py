"""Registered sink-side queries: aspect text lines, the Markdown summary,
and CSV / JSON round trips through the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from critiq.functions.tables import materialize
from critiq.operators import alerts as al
from critiq.operators import tabular as tab
from critiq.operators import text as tx
from critiq.plans.q_alerts import alerts_sql
from critiq.plans.q_sources import _align_sql
from critiq.plans.q_tabular import EDA_SQL, bayes_sql
from critiq.plans.q_text import ASPECT_ROWS_CTE, SPLIT_CTE
from critiq.plans.registry import register
from critiq.session import checkpoint_dir
from critiq.sinks import aspect_lines, markdown_lines
from critiq.sources.fixtures import rv_docs, rv_orders, with_views
from critiq.sources.readers import from_csv, from_json, load
from critiq.sources.schema import align_columns


@register("aspect_lines", with_views(f""", {ASPECT_ROWS_CTE}
SELECT concat_ws('$', text, CASE sentiment WHEN 'positive' THEN 'Positive' WHEN 'neutral' THEN 'Neutral'
       WHEN 'negative' THEN 'Negative' ELSE 'Neutral' END, aspect) AS line FROM ar""", "rv_docs"))
def q_aspect_lines(spark, sf_dir):
    return aspect_lines(tx.aspect_rows(rv_docs(spark, sf_dir)))


def _markdown_sql() -> str:
    num = "CASE WHEN value = floor(value) THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
    metrics = ", ".join(f"'{m}'" for m in tab.EDA_METRICS)
    cols = ["shop_name", "city", "review_count", "avg_score", "bayes_score"]
    cells = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    fixed = [(0, 0, "# Review Analysis Report"), (0, 2, ""), (1, 0, "## Overview"), (1, 1, ""), (1, 10 ** 6, ""),
             (2, 0, "## Top Shops (Bayesian)"), (2, 1, ""), (2, 2, "| " + " | ".join(cols) + " |"),
             (2, 3, "| " + " | ".join(["---"] * len(cols)) + " |"), (2, 10 ** 6, ""), (3, 0, "## Alerts"), (3, 1, ""), (3, 10 ** 6, "")]
    values = ", ".join(f"({s}, {k}, '{line}')" for s, k, line in fixed)
    return f"""
WITH lines(sec, k, line) AS (
  SELECT * FROM (VALUES {values})
  UNION ALL SELECT 1, list_position([{metrics}], metric) + 1, '- **' || metric || '**: ' || {num} FROM ({with_views(EDA_SQL, "rv_orders")})
  UNION ALL SELECT 2, row_number() OVER (ORDER BY bayes_rank, shop_id) + 3, '| ' || concat_ws(' | ', {cells}) || ' |'
    FROM (SELECT * FROM ({bayes_sql("rv_orders", by_id=False)}) ORDER BY bayes_rank, shop_id LIMIT 10)
  UNION ALL SELECT 3, row_number() OVER (ORDER BY severity, shop_id) + 1,
      '- **[' || level || ']** ' || coalesce(shop_name, '') || ': ' || message || ' → ' || action
    FROM (SELECT * FROM ({alerts_sql("rv_orders")} SELECT * FROM alerts) ORDER BY severity, shop_id LIMIT 10))
SELECT CAST(row_number() OVER (ORDER BY sec, k) - 1 AS INTEGER) AS line_no, line FROM lines"""


REPORT_COLS = "review_id shop_id shop_name user_id city review_score review_time sentiment_label sentiment content_len"


@register("markdown_lines", _markdown_sql())
def q_markdown_lines(spark, sf_dir):
    # three operators read the joined reviews six times: joined once, with the columns they read
    df = materialize(rv_orders(spark, sf_dir).select(REPORT_COLS.split()), "reviews")
    return markdown_lines(tab.eda_summary(df), tab.bayesian_ranking(df), al.alerts(df))


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


@register("csv_roundtrip", _align_sql())
def q_csv_roundtrip(spark, sf_dir):
    src = align_columns(rv_docs(spark, sf_dir))
    path = _scratch(spark, "csv")
    src.write.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    return from_csv(spark, path, schema=src.schema, multiline=True, null_value="\\N")


@register("json_roundtrip", _align_sql())
def q_json_roundtrip(spark, sf_dir):
    src = align_columns(rv_docs(spark, sf_dir))
    path = _scratch(spark, "jsonl")
    src.write.json(path)
    back = from_json(spark, path, lines=True)
    return back.select(*[back[c].cast(src.schema[c].dataType).alias(c) for c in src.columns])


@register("json_wrappers", _align_sql())
def q_json_wrappers(spark, sf_dir):
    """All rows through JSON documents of some 500 reviews each: half of them wrap
    ``reviews``, the others ``data``."""
    src = align_columns(rv_docs(spark, sf_dir))
    buckets = 2 * max(1, src.count() // 1000)
    d = src.select(F.pmod(F.xxhash64("review_id"), F.lit(buckets)).alias("bucket"), F.struct(*src.columns).alias("row"))
    d = d.groupBy("bucket").agg(F.collect_list("row").alias("rows"))
    back = None
    for key, odd in (("reviews", 0), ("data", 1)):
        path = _scratch(spark, key)
        half = d.where(F.col("bucket") % 2 == odd).select(F.to_json(F.struct(F.col("rows").alias(key))).alias("value"), "bucket")
        half.write.partitionBy("bucket").text(path)
        part = from_json(spark, path)
        part = part.select(*[part[c].cast(src.schema[c].dataType).alias(c) for c in src.columns])
        back = part if back is None else back.unionByName(part)
    return back


DISPATCH_KINDS = ("csv", "jsonl", "json", "parquet")


@register("dispatched_sources", with_views("""
SELECT kind, review_id, shop_id, platform, sentiment, review_content FROM rv_docs, (VALUES ('csv'), ('jsonl'), ('json'), ('parquet')) k(kind)""", "rv_docs"))
def q_dispatched_sources(spark, sf_dir):
    """All rows through every file format that the dispatcher tells by its name."""
    cols = ["review_id", "shop_id", "platform", "sentiment", "review_content"]
    src = rv_docs(spark, sf_dir).select(*cols)
    out = None
    for kind in DISPATCH_KINDS:
        path = f"{_scratch(spark, 'source')}.{kind}"
        if kind == "csv":
            src.write.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
            back = load(spark, path, null_value="\\N")
        elif kind == "json":  # documents that wrap about 500 reviews each
            bucket = F.pmod(F.xxhash64("review_id"), F.lit(max(1, src.count() // 500)))
            whole = src.groupBy(bucket.alias("bucket")).agg(F.to_json(F.struct(F.collect_list(F.struct(*cols)).alias("reviews"))).alias("value"))
            whole.write.partitionBy("bucket").text(path)
            back = load(spark, path)
        elif kind == "jsonl":
            src.write.json(path)
            back = load(spark, path)
        else:
            src.write.parquet(path)
            back = load(spark, path)
        back = back.select(F.lit(kind).alias("kind"), *cols)
        out = back if out is None else out.unionByName(back)
    return out


@register("jsonl_export", with_views(f", {SPLIT_CTE}\nSELECT * FROM sp", "rv_docs"))
def q_jsonl_export(spark, sf_dir):
    from critiq.sinks import write_jsonl_splits
    ds = tx.training_split(rv_docs(spark, sf_dir))
    path = _scratch(spark, "splits")
    write_jsonl_splits(ds, path)
    back = spark.read.schema(ds.drop("split").schema).json(path)   # split comes from the folder names
    return back.select(*ds.columns)


@register("report_manifest", with_views(f""", {ASPECT_ROWS_CTE}
SELECT 'aspect_rows' AS name, CAST(count(*) AS BIGINT) AS rows, 5 AS columns FROM ar
UNION ALL SELECT 'documents', CAST(count(*) AS BIGINT), 10 FROM rv_docs""", "rv_docs"))
def q_report_manifest(spark, sf_dir):
    from critiq.sinks import write_report
    docs = rv_docs(spark, sf_dir)
    return write_report({"aspect_rows": tx.aspect_rows(docs), "documents": docs}, _scratch(spark, "report"))


@register("lenient_csv", with_views("""
SELECT * FROM rv_raw WHERE text IS NOT NULL AND stars_y IS NOT NULL""", "rv_raw"))
def q_lenient_csv(spark, sf_dir):
    from critiq.sources.fixtures import rv_raw
    from critiq.sources.readers import from_csv_lenient
    src = rv_raw(spark, sf_dir)
    path = _scratch(spark, "rawcsv")
    src.write.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    df = from_csv_lenient(spark, path, required=("text", "stars_y"), schema=src.schema, null_value="\\N", multiline=True)
    return df
