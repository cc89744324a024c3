"""Plan-shape checks: pruning and pushdown reach the scan, no Python in the
hot path of relational queries, no global single-partition window over
review-sized input."""

import __spark_entry__ as ent
from conftest import SF

PY_ALLOWED = {"stl_decomposition", "stl_by_city", "stl_forecast", "cma_decomposition_events", "cooccurrence", "cooccurrence_matrix",
              "sentiment_model", "topics", "topic_sentiment", "shop_clusters", "shop_cluster_summary",
              "rfm_clusters", "rfm_cluster_summary"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_relational_queries(spark):
    for name, fn in ent.queries().items():
        if name in PY_ALLOWED or name in ("csv_roundtrip", "json_roundtrip"):
            continue
        p = _plan(fn(spark, SF))
        for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
            assert node not in p, f"{name} runs Python ({node})"


def test_column_pruning_reaches_scan(spark):
    p = _plan(ent.queries()["hourly_pattern"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz" in p
    assert "props" not in p.split("ReadSchema:")[1].split(">")[0]
    p = _plan(ent.queries()["monthly_trend"](spark, SF))
    scan = [s for s in p.split("\n") if "lineitem" in s and "FileScan" in s][0]
    assert "l_extendedprice" not in scan and "l_returnflag" not in scan


def test_document_slice_filter_pushed(spark):
    p = _plan(ent.queries()["correlation"](spark, SF))
    assert "PushedFilters: [IsNotNull(doc_id), LessThan(doc_id,200)]" in p


def test_order_view_reads_what_is_asked_for(spark):
    def tables(name):
        p = _plan(ent.queries()[name](spark, SF))
        return {t for t in ("lineitem", "orders", "supplier", "part", "nation", "region", "documents") if f"/{t}.parquet" in p}

    assert tables("monthly_trend") == {"lineitem"}
    assert tables("city_summary") == {"lineitem", "supplier", "nation"}
    assert tables("wilson_ranking") == {"lineitem", "supplier", "part", "nation"}


def _tree(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sort_aggregate_and_no_expand_on_facts(spark):
    for name in ("eda_summary", "coverage"):
        assert "Expand" not in _tree(ent.queries()[name](spark, SF))
    # the first values are picked from rows that a hash aggregate has merged before
    for name in ("wilson_ranking", "bayesian_ranking", "shop_keywords", "alerts", "shop_dimension"):
        p = _plan(ent.queries()[name](spark, SF))
        for leaf in [l for l in p.split("\n") if "SortAggregate" in l]:
            assert "min_by" in leaf, leaf
        assert p.count("HashAggregate") >= 2


def test_single_partition_windows_only_on_small_tables(spark):
    # the ranking window runs over distinct rounded scores, not over shops
    p = _plan(ent.queries()["bayesian_ranking"](spark, SF))
    win = [l for l in p.split("\n") if "Window [dense_rank" in l]
    assert win and all("bayes_score" in l for l in win)


def test_building_text_queries_starts_no_job(spark):
    from critiq.operators import text as tx
    from critiq.sources.fixtures import rv_docs
    docs = rv_docs(spark, SF)          # reading a schema may start a job
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = set(jobs(None))
    for build in (tx.dimension_coverage, tx.aspect_matrix, tx.word_frequency, tx.neg_signal_words, tx.shop_keywords,
                  tx.tfidf_terms):  # cooccurrence looks for its bound with jobs of its own
        build(docs)
    assert set(jobs(None)) == before


def test_shared_keeps_adaptive_execution(spark):
    from critiq.functions.num import CACHED_AQE_FLAG, shared, sharing
    other = shared(spark.range(7).groupBy("id").count())
    with sharing() as tables:
        g = shared(spark.range(100).selectExpr("id % 3 AS k").groupBy("k").count())
        assert spark.conf.get(CACHED_AQE_FLAG) == "true"
        assert g.is_cached and len(tables) == 1
    assert not g.is_cached
    assert other.is_cached  # a block drops its own tables only
    other.unpersist()


def test_report_joins_the_reviews_once(spark):
    p = _plan(ent.queries()["markdown_lines"](spark, SF))
    assert "lineitem.parquet" not in p and "/reviews-" in p
