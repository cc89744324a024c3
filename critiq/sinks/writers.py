"""Sinks.  Every writer is distributed (one file per partition) except the
Markdown summary, which is built from at most a few dozen rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from critiq.operators.tabular import EDA_METRICS as _EDA_ORDER  # noqa: E402

# Aspect line labels; anything else is written as Neutral.
ASPECT_LINE_LABELS = {"positive": "Positive", "neutral": "Neutral", "negative": "Negative"}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write a result table (parquet by default, or CSV with a header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def write_jsonl_splits(dataset: DataFrame, path: str, split_col: str = "split") -> str:
    """One JSON object per row, one directory per split (split=train/...)."""
    dataset.write.mode("overwrite").partitionBy(split_col).json(path)
    return path


def aspect_lines(rows: DataFrame) -> DataFrame:
    """``text$Label$aspect`` lines of an aspect training set."""
    lab = None
    for k, v in ASPECT_LINE_LABELS.items():
        lab = F.when(F.col("sentiment") == k, v) if lab is None else lab.when(F.col("sentiment") == k, v)
    return rows.select(F.concat_ws("$", F.col("text"), lab.otherwise("Neutral"), F.col("aspect")).alias("line"))


def write_text_lines(lines: DataFrame, path: str) -> str:
    lines.write.mode("overwrite").text(path)
    return path


def write_report(results: dict, out_dir: str, fmt: str = "parquet") -> DataFrame:
    """Write every result table to ``out_dir/<name>`` and return a manifest
    (name, rows, columns) of the non-empty ones, itself written to
    ``out_dir/_manifest``.  Rows are counted while they are written."""
    spark = SparkSession.getActiveSession()
    rows = []
    for name, df in results.items():
        if df is None:
            continue
        seen = Observation(name)
        write_table(df.observe(seen, F.count(F.lit(1)).alias("n")), os.path.join(out_dir, name), fmt)
        if seen.get["n"]:
            rows.append((name, int(seen.get["n"]), len(df.columns)))
    manifest = spark.createDataFrame(rows, "name string, rows long, columns int")
    write_table(manifest.coalesce(1), os.path.join(out_dir, "_manifest"), "csv")
    return manifest


def _num_text(v):
    """Integral values print without a decimal part (60000, not 60000.0)."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def _section_end(spark, sec: int):
    return spark.createDataFrame([(sec, 10 ** 6, "")], "sec int, k int, line string")


def markdown_lines(eda: DataFrame | None = None, ranking: DataFrame | None = None,
                   alerts: DataFrame | None = None, title: str = "Review Analysis Report",
                   generated: str | None = None, top: int = 10) -> DataFrame:
    """(line_no, line) of a Markdown summary: overview bullets, the top
    ``top`` shops by Bayes score, the first ``top`` alerts.  Inputs are
    already small; each part is limited before it is formatted."""
    spark = SparkSession.getActiveSession()
    parts = [spark.createDataFrame([(0, 0, f"# {title}")] + ([(0, 1, f"> Generated: {generated}")] if generated else [])
                                   + [(0, 2, "")], "sec int, k int, line string")]
    if eda is not None:
        head = spark.createDataFrame([(1, 0, "## Overview"), (1, 1, "")], "sec int, k int, line string")
        order = F.array_position(F.array(*[F.lit(m) for m in _EDA_ORDER]), F.col("metric"))
        body = eda.select(F.lit(1).alias("sec"), (order + 1).cast("int").alias("k"),
                          F.concat(F.lit("- **"), F.col("metric"), F.lit("**: "), _num_text(F.col("value"))).alias("line"))
        parts += [head, body, _section_end(spark, 1)]
    if ranking is not None:
        cols = [c for c in ["shop_name", "city", "review_count", "avg_score", "bayes_score"] if c in ranking.columns]
        head = spark.createDataFrame([(2, 0, "## Top Shops (Bayesian)"), (2, 1, ""),
                                      (2, 2, "| " + " | ".join(cols) + " |"),
                                      (2, 3, "| " + " | ".join(["---"] * len(cols)) + " |")], "sec int, k int, line string")
        r = ranking.orderBy("bayes_rank", "shop_id").limit(top)
        place = F.row_number().over(Window.orderBy("bayes_rank", "shop_id"))   # at most ``top`` rows
        body = r.select(F.lit(2).alias("sec"), (place + 3).cast("int").alias("k"),
                        F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in cols]), F.lit(" |")).alias("line"))
        parts += [head, body, _section_end(spark, 2)]
    if alerts is not None:
        head = spark.createDataFrame([(3, 0, "## Alerts"), (3, 1, "")], "sec int, k int, line string")
        a = alerts.orderBy("severity", "shop_id").limit(top)
        body = a.select(F.lit(3).alias("sec"), F.lit(2).alias("k"),
                        F.concat(F.lit("- **["), F.col("level"), F.lit("]** "), F.coalesce(F.col("shop_name"), F.lit("")),
                                 F.lit(": "), F.col("message"), F.lit(" → "), F.col("action")).alias("line"),
                        "severity", "shop_id")
        body = body.select("sec", (F.row_number().over(Window.orderBy("severity", "shop_id")) + 1).cast("int").alias("k"), "line")
        parts += [head, body, _section_end(spark, 3)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select((F.row_number().over(Window.orderBy("sec", "k")) - 1).cast("int").alias("line_no"), "line")
