"""The batch job: load -> clean -> (persisted once) -> analyses -> sinks.

The cleaned table is written once as parquet under the shared checkpoint
folder (``spark.checkpoint.dir``) and read back, so every analysis starts
from a short lineage that survives lost executors.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from critiq.functions.num import sharing
from critiq.functions.tables import materialize
from critiq.operators import alerts as al
from critiq.operators import ml, prep, sequential as seq, tabular as tab, text as tx
from critiq.sinks import markdown_lines, write_report, write_text_lines
from critiq.sources.readers import load

MODULES = ("tabular", "sequential", "text", "strategy")


def analyses(df: DataFrame, modules=MODULES, lexicon: dict | None = None, lang: str | None = None,
             with_models: bool = True) -> dict:
    """Lazy result tables by name (models are fitted when asked for).  ``lang``
    None: every text operator and model picks the language row by row."""
    r: dict[str, DataFrame] = {}
    if "tabular" in modules:
        r["eda"] = tab.eda_summary(df)
        r["correlation"] = tab.correlation(df)
        r["wilson_ranking"] = tab.wilson_ranking(df)
        r["ranking"] = tab.bayesian_ranking(df)
        if with_models:
            c = ml.shop_clusters(df)
            r["shop_clusters"], r["cluster_summary"] = c.detail, c.summary
    if "sequential" in modules:
        r["hourly"] = seq.hourly_pattern(df)
        r["burst"] = seq.burst_detection(df)
        decomp = seq.trend_decomposition(df)
        r["trend_decomp"] = decomp
        r["forecast"] = seq.forecast_trend(decomp)
        rfm = seq.rfm_segmentation(df)
        r["rfm"] = rfm
        if with_models:
            k = ml.rfm_clusters(rfm)
            r["rfm_kmeans"], r["rfm_kmeans_summary"] = k.detail, k.summary
    if "text" in modules:
        r["dimension"] = tx.dimension_coverage(df, lexicon, lang)
        r["aspect_matrix"] = tx.aspect_matrix(df, lexicon, lang)
        r["neg_signals"] = tx.neg_signal_words(df, lang=lang)
        r["training_set"] = tx.training_split(df)
        r["absa_rows"] = tx.aspect_rows(df) if "absa_aspects" in df.columns else None
        if with_models:
            r["topics"] = ml.topic_model(df, lang=lang).topics
            r["classifier_report"] = ml.sentiment_classifier(df, lang=lang).report
    if "strategy" in modules:
        r["alerts"] = al.alerts(df)
    return r


def run(spark: SparkSession, source: str, out_dir: str, modules=MODULES, lexicon: dict | None = None,
        lang: str | None = None, with_models: bool = True, fmt: str = "parquet", **load_kwargs) -> DataFrame:
    """Run the whole analysis on ``source`` and write every table under
    ``out_dir``; returns the manifest (name, rows, columns)."""
    raw = load(spark, source, **load_kwargs)
    clean = materialize(prep.preprocess(raw), "cleaned")
    # the manifest is built while writing, so the aggregates that this run
    # shares between its plans can go at the end; those of other runs stay
    with sharing():
        res = analyses(clean, modules, lexicon, lang, with_models)
        manifest = write_report(res, out_dir, fmt)
        md = markdown_lines(res.get("eda"), res.get("ranking"), res.get("alerts"))
        write_text_lines(md.orderBy("line_no").select("line").coalesce(1), os.path.join(out_dir, "report_md"))
    return manifest
