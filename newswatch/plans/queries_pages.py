"""Registered page queries: stored pages, and listing pages made from every article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswatch.functions.markup import page_title, without_code
from newswatch.functions.urls import normalize
from newswatch.operators import extract, load, robots
from newswatch.plans.jobs import written
from newswatch.plans.queries_load import Inputs
from newswatch.sources.driver_tables import FLOW, adapted, read
from newswatch.sources.pages import fetch_log

AGENT = "NewsBot/1.0"
MAX_ITEMS = 3
FETCHED_AT = "2024-02-20T00:00:00+00:00"


class PageInputs(Inputs):
    """The adapted tables and the driver's pages."""

    def __init__(self, spark, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.pages = read(spark, sf_dir, "pages")
        self.listings = adapted(spark, sf_dir, "listings")


def on_pages(fn):
    return lambda spark, sf_dir: fn(PageInputs(spark, sf_dir))


def texts(t: PageInputs) -> DataFrame:
    return extract.page_fields(t.pages).select("page_id", "page_text")


def anchors(t: PageInputs) -> DataFrame:
    return extract.page_anchors(t.pages)


def links(t: PageInputs) -> DataFrame:
    return anchors(t).select(
        F.col("url").alias("page_url"), "pos", normalize(F.col("url"), F.col("href")).alias("url")
    )


def listing_html(t: PageInputs) -> DataFrame:
    return t.listings.select("url", "html")


def chosen(t: PageInputs) -> DataFrame:
    pages = t.listings.select("company_name", F.col("url").alias("source_url"), F.lit(0).alias("page_no"), F.col("url").alias("page_url"))
    reads = written(extract.page_reads(listing_html(t)), "listing-reads")
    found = extract.candidates(pages, listing_html(t), MAX_ITEMS, reads)
    return extract.chosen_candidates(found, load.last_success(t.monitoring, FLOW), MAX_ITEMS)


def crawl_records(t: PageInputs) -> DataFrame:
    rows = extract.records(extract.article_visits(chosen(t), t.snapshots), FETCHED_AT)
    return rows.select(
        "company_name",
        "id",
        "source_url",
        "url",
        "title",
        F.sha2("article_content", 256).alias("content_hash"),
        "published_date",
        "s_created_ts",
        "response_time_ms",
    )


def crawl_metrics(t: PageInputs) -> DataFrame:
    visits = extract.article_visits(chosen(t), t.snapshots)
    return load.fetch_metrics(extract.visit_log(visits))


def decisions(t: PageInputs) -> DataFrame:
    rules = robots.site_rules(t.robots_files, AGENT)
    return robots.fetch_decisions(t.pages.select("page_id", "url"), rules)


def queries() -> dict:
    recipes = {
        "page_title": lambda t: t.pages.select("page_id", page_title(without_code(F.col("html"))).alias("title")),
        "page_text": texts,
        "page_anchors": anchors,
        "page_links": links,
        "page_dates": lambda t: extract.page_fields(listing_html(t)).select("url", "page_title", "page_date"),
        "jsonld_items": lambda t: extract.jsonld_items(listing_html(t)).select("page_url", "url", "title", "published_date"),
        "listing_links": lambda t: extract.listing_links(extract.page_anchors(listing_html(t))),
        "extra_listing_pages": lambda t: extract.extra_listing_pages(extract.page_anchors(listing_html(t))),
        "crawl_candidates": lambda t: chosen(t).select("company_name", "source_url", "n", "url", "item.title"),
        "crawl_records": crawl_records,
        "crawl_metrics": crawl_metrics,
        "usable_pages": lambda t: fetch_log(t.snapshots),
        "robots_groups": lambda t: robots.robots_groups(t.robots_files),
        "robots_decision": decisions,
    }
    return {name: on_pages(fn) for name, fn in recipes.items()}


