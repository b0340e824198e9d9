"""Registered reporting queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newswatch.operators import feed, marts, report, warehouse
from newswatch.sources.driver_tables import AS_OF, adapted


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse.news_all(*(adapted(spark, sf_dir, t) for t in ("articles", "summaries", "exclusions")))


def _window(period: str, top: bool, export: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pick = warehouse.top_news if top else warehouse.news_window
        rows = pick(news(spark, sf_dir), AS_OF, period)
        return warehouse.export_view(rows) if export else rows

    return query


def _mart(fn):
    return lambda spark, sf_dir: fn(news(spark, sf_dir), AS_OF)


def _on_news(fn):
    return lambda spark, sf_dir: fn(news(spark, sf_dir))


def _on_feed(fn, **filters):
    """A summary of the filtered, limited feed."""
    return lambda spark, sf_dir: fn(feed.feed(news(spark, sf_dir), AS_OF, **filters))


def _on_chat(fn):
    return lambda spark, sf_dir: fn(feed.chat_feed(news(spark, sf_dir), AS_OF, period="month"))


QUESTION = "  What is new?  "


def _answer(company: str | None, period: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = feed.chat_feed(news(spark, sf_dir), AS_OF, company=company, period=period)
        return feed.chat_answer(rows, QUESTION, company, period)

    return query


def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard's rows with a known sector and an unknown company and topic, which fall back to all."""
    board = feed.dashboard(news(spark, sf_dir), AS_OF, "BANKING", "NOBODY", "6_months", "no topic")
    chosen = board["selected"]
    return board["rows"].select("*", *[F.lit(chosen[k]).alias(f"chosen_{k}") for k in ("industry_sector", "company", "topic")])


def _sheet(name: str):
    return lambda spark, sf_dir: report.report_sheets(news(spark, sf_dir), AS_OF)[name]


def queries() -> dict:
    out = {}
    for export in (False, True):
        suffix = "_export" if export else ""
        for period in ("all", "week", "month", "6_months"):
            out[f"news_{period}{suffix}"] = _window(period, False, export)
        for period in ("week", "month"):
            out[f"top_news_{period}{suffix}"] = _window(period, True, export)
    out |= {
        "kpi_overview": _mart(marts.kpi_overview),
        "company_intelligence": _mart(marts.company_intelligence),
        "company_tag_counts": _mart(
            lambda n, as_of: marts.company_totals(marts.tag_counts(n, as_of))
            .where("kind <> 'company'")
            .select("industry_sector", "company_name", "kind", "tag", "n_month")
        ),
        "topic_signal_heatmap": _mart(marts.topic_signal_heatmap),
        "executive_feed": _mart(marts.executive_feed),
        "sectors": _mart(feed.sectors),
        "companies": _on_news(lambda n: feed.companies(n, AS_OF, "6_months", "LIFESCIENCE")),
        "topics": _on_news(lambda n: feed.topics(n, AS_OF, "6_months", "LIFESCIENCE", "SRC0")),
        "feed_filtered": _on_feed(lambda rows: rows, sector="BANKING", period="6_months", topic="m&a"),
        "feed_ranked": _on_feed(lambda rows: rows, period="all"),
        "feed_display": _on_feed(feed.display_rows, period="all"),
        "feed_summary": _on_feed(feed.feed_summary, period="all"),
        "top_topics": _on_feed(feed.top_topics, period="all"),
        "topic_pulse": _on_feed(feed.topic_pulse, period="all"),
        "company_bars": _on_feed(feed.company_bars, period="all"),
        "chat_sources": _on_chat(feed.chat_sources),
        "chat_context": _on_chat(feed.chat_context),
        "chat_digest": _on_chat(feed.chat_digest),
        "chat_answer": _answer(None, "month"),
        "chat_answer_empty": _answer("NOBODY", "week"),
        "dashboard_rows": dashboard_rows,
        "report_overview": _mart(report.report_overview),
        "company_counts": _mart(report.company_counts),
        "topic_counts": _on_news(report.topic_counts),
        "signal_counts": _on_news(report.signal_counts),
        "report_news_month": _sheet("news_month"),
        "report_companies": _sheet("dea_company"),
        "report_sheet_counts": _mart(report.sheet_counts),
    }
    return out
