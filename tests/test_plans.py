"""What the physical plans must look like at scale: no pairings, no wide scans, hot keys cut early."""

import pytest

from newswatch.operators import robots
from newswatch.plans import registry

STREAMING = {"rate_limiter", "rate_limiter_late", "continuous_load"}
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@pytest.fixture(scope="module")
def plans(spark):
    """Plans without any broadcast, as for inputs beyond the broadcast threshold."""
    before = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for key, value in NO_BROADCAST.items():
        spark.conf.set(key, value)
    out = {}
    for name, query in registry.queries().items():
        if name not in STREAMING:
            out[name] = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return out


def test_no_query_pairs_rows_without_keys(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p]
    assert not bad


def test_no_row_at_a_time_python(plans):
    assert not [n for n, p in plans.items() if "BatchEvalPython" in p]


@pytest.mark.parametrize("name", ["validate", "merge_new", "staging_dedup", "legacy_merge", "listing_links", "crawl_candidates"])
def test_hot_keys_are_cut_before_the_shuffle(plans, name):
    assert "Partial" in plans[name] and "WindowGroupLimit" in plans[name]


@pytest.mark.parametrize("name", ["news_all", "company_intelligence", "kpi_overview", "topic_signal_heatmap", "executive_feed"])
def test_reporting_never_reads_bodies(plans, name):
    scans = [line for line in plans[name].splitlines() if "documents.parquet" in line]
    assert scans and all("text:" not in line for line in scans)


def test_marts_read_each_input_once(plans):
    for name in ("company_intelligence", "kpi_overview", "topic_signal_heatmap"):
        assert plans[name].count("FileScan parquet") == 4  # articles, summaries, and the two of the exclusion list


def test_embedded_items_are_parsed_once(plans):
    assert plans["jsonld_items"].count("get_json_object") < 60


def test_load_moves_bodies_once(spark, plans):
    """With broadcasting off, only the join that brings bodies to the inserted rows exchanges them."""
    from newswatch.operators.validate import validate
    from newswatch.plans.jobs import _bodies
    from newswatch.sources.driver_tables import adapted

    records = adapted(spark, "/root/testdata/sf0.001", "records")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        narrow = validate(records.drop("article_content"))
        joined = narrow.select("url", "seq").join(_bodies(records), ["url", "seq"])
        decided, moved = (x._jdf.queryExecution().executedPlan().toString() for x in (narrow, joined))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "article_content" not in decided
    exchanges = [block for block in moved.split("Exchange hashpartitioning")[1:] if "article_content" in block.split("Exchange")[0]]
    assert len(exchanges) == 1


def test_robots_rules_are_not_patterns(spark):
    files = spark.createDataFrame([("https://h.com", "User-agent: *\nDisallow: /a\nAllow: /a/*.html$")], "site string, text string")
    urls = spark.createDataFrame([("https://h.com/a/x.html",), ("https://h.com/a/x.htm",), ("https://h.com/b",)], "url string")
    decided = robots.fetch_decisions(urls, robots.site_rules(files, "Bot/1.0"))
    assert "RLIKE" not in decided._jdf.queryExecution().optimizedPlan().toString().upper()
    assert [r.allowed for r in decided.orderBy("url").collect()] == [False, True, True]
