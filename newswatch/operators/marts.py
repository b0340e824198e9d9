"""Executive marts: KPIs, company intelligence, topic heatmap, executive feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.functions.text import (
    HIGH_PRIORITY,
    attention_level,
    moment,
    or_uncategorized,
    priority_band,
    round_half_up,
)
from newswatch.operators.warehouse import news_window, since

# ---- fixed values: metric name, label ----
KPI_LABELS = [
    ("total_articles", "All articles in the reporting warehouse"),
    ("articles_last_7_days", "Articles published in the rolling last 7 days"),
    ("articles_last_30_days", "Articles published in the rolling last month"),
    ("high_priority_last_30_days", "High-priority articles in the rolling last month"),
    ("active_companies_last_30_days", "Companies with at least one article in the rolling last month"),
    ("articles_missing_summary", "Articles still missing a completed AI summary"),
]
DONE_STATUSES = ["ai", "fallback"]
NO_TOPIC = "no recent topic"
NO_SIGNAL = "no recent signal"
# ---- end of fixed values ----


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def kpi_overview(news: DataFrame, as_of) -> DataFrame:
    """Six headline metrics in long form from one scan.

    Counting per company first makes the distinct count a plain count of small
    rows: one shuffle of partial sums, no row expansion.
    """
    month = since(as_of, "month")
    missing = F.col("article_summary").isNull() | ~F.col("summary_status").isin(DONE_STATUSES)
    per_company = news.groupBy("company_name").agg(
        F.count("*").alias("total"),
        _count(since(as_of, "week")).alias("week"),
        _count(month).alias("month"),
        _count(month & (F.col("priority_score") >= HIGH_PRIORITY)).alias("high"),
        _count(missing).alias("missing"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    active = _count((F.col("month") > 0) & F.col("company_name").isNotNull()).alias("active")
    values = per_company.agg(total("total"), total("week"), total("month"), total("high"), active, total("missing"))
    pairs = zip(KPI_LABELS, ["total", "week", "month", "high", "active", "missing"], strict=True)
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(label).alias("metric_label"))
            for (m, label), c in pairs
        ]
    )
    return values.select(F.inline(rows)).select(
        "metric",
        F.col("value").cast("double").alias("numeric_value"),
        F.col("value").cast("string").alias("metric_value"),
        "metric_label",
        moment(as_of).alias("generated_at"),
    )


def tag_counts(news: DataFrame, as_of) -> DataFrame:
    """Counts by (sector, company, topic, signal): the first step of the company mart.

    Partial sums before the shuffle reduce a company that holds a third of all
    rows to a few rows per task.
    """
    month = since(as_of, "month")
    high = month & (F.col("priority_score") >= HIGH_PRIORITY)
    return news.groupBy(
        "industry_sector",
        "company_name",
        or_uncategorized(F.col("key_topic")).alias("key_topic"),
        or_uncategorized(F.col("signal_type")).alias("signal_type"),
    ).agg(
        F.count("*").alias("n_all"),
        _count(since(as_of, "week")).alias("n_week"),
        _count(month).alias("n_month"),
        _count(since(as_of, "6_months")).alias("n_6_months"),
        _count(high).alias("n_high"),
        F.sum(F.when(month, F.col("priority_score"))).alias("score_sum"),
        F.max(F.when(month, F.col("priority_score"))).alias("score_max"),
        F.max("published_date").alias("latest"),
    )


def company_totals(counts: DataFrame) -> DataFrame:
    """Totals per company and, within the month, per topic and per signal (A3, A4).

    ``kind`` is company, topic or signal; ``tag`` the topic or signal. The few
    rows of ``tag_counts`` are tripled and summed, so one scan serves all three.
    """
    kinds = F.array(
        F.struct(F.lit("company").alias("kind"), F.lit(None).cast("string").alias("tag")),
        F.struct(F.lit("topic").alias("kind"), F.col("key_topic").alias("tag")),
        F.struct(F.lit("signal").alias("kind"), F.col("signal_type").alias("tag")),
    )
    sums = [F.sum(c).alias(c) for c in ("n_all", "n_week", "n_month", "n_6_months", "n_high", "score_sum")]
    return (
        counts.select("*", F.inline(kinds))
        .groupBy("industry_sector", "company_name", "kind", "tag")
        .agg(*sums, F.max("score_max").alias("score_max"), F.max("latest").alias("latest"))
        .where("kind = 'company' OR n_month > 0")
    )


def leading_tag(kind: str) -> Column:
    """Aggregate over ``company_totals``: the most frequent tag, ties by name.

    The top-ranked row is taken by an aggregate; no company's rows are sorted.
    """
    rank = F.when(F.col("kind") == kind, F.struct(-F.col("n_month"), F.col("tag")))
    return F.min_by("tag", rank)


def company_intelligence(news: DataFrame, as_of) -> DataFrame:
    """Company mart: rollup, leading topic and signal, attention level.

    A company without name or sector has no leading tags, as NULL keys match
    nothing.
    """
    totals = company_totals(tag_counts(news, as_of))
    company = F.col("kind") == "company"

    def total(name: str) -> Column:
        return F.sum(F.when(company, F.col(name)))

    named = F.col("industry_sector").isNotNull() & F.col("company_name").isNotNull()
    mart = totals.groupBy("industry_sector", "company_name").agg(
        total("n_week").alias("articles_last_7_days"),
        total("n_month").alias("articles_last_30_days"),
        total("n_6_months").alias("articles_last_6_months"),
        total("n_all").alias("articles_all"),
        total("n_high").alias("high_priority_last_30_days"),
        round_half_up(F.try_divide(total("score_sum"), total("n_month"))).alias("avg_priority_last_30_days"),
        F.max(F.when(company, F.col("score_max"))).alias("top_priority_score_30_days"),
        leading_tag("topic").alias("topic"),
        leading_tag("signal").alias("signal"),
        F.max("latest").alias("latest_published_date"),
    )
    return mart.select(
        "industry_sector",
        "company_name",
        "articles_last_7_days",
        "articles_last_30_days",
        "articles_last_6_months",
        "articles_all",
        "high_priority_last_30_days",
        "avg_priority_last_30_days",
        "top_priority_score_30_days",
        F.coalesce(F.when(named, F.col("topic")), F.lit(NO_TOPIC)).alias("leading_topic_last_30_days"),
        F.coalesce(F.when(named, F.col("signal")), F.lit(NO_SIGNAL)).alias("leading_signal_last_30_days"),
        "latest_published_date",
        attention_level(F.col("high_priority_last_30_days")).alias("attention_level"),
    )


def topic_signal_heatmap(news: DataFrame, as_of) -> DataFrame:
    """Topic by signal per sector over the month (A6), distinct companies counted in two steps."""
    per_company = (
        news_window(news, as_of, "month")
        .groupBy(
            "industry_sector",
            or_uncategorized(F.col("key_topic")).alias("key_topic"),
            or_uncategorized(F.col("signal_type")).alias("signal_type"),
            "company_name",
        )
        .agg(
            F.count("*").alias("n"),
            _count(F.col("priority_score") >= HIGH_PRIORITY).alias("high"),
            F.sum("priority_score").alias("score_sum"),
            F.max("published_date").alias("latest"),
        )
    )
    return per_company.groupBy("industry_sector", "key_topic", "signal_type").agg(
        F.sum("n").alias("articles_last_30_days"),
        F.sum("high").alias("high_priority_last_30_days"),
        F.count("company_name").alias("companies_last_30_days"),
        round_half_up(F.sum("score_sum") / F.sum("n")).alias("avg_priority_score"),
        F.max("latest").alias("latest_published_date"),
    )


def executive_feed(news: DataFrame, as_of) -> DataFrame:
    """Month rows that are high priority or of the last week, with a band."""
    rows = news_window(news, as_of, "month").where((F.col("priority_score") >= HIGH_PRIORITY) | since(as_of, "week"))
    return rows.select(
        "industry_sector",
        "company_name",
        "published_date",
        "priority_score",
        priority_band(F.col("priority_score")).alias("priority_band"),
        "title",
        "article_summary",
        "key_topic",
        "business_impact",
        "geography",
        "signal_type",
        "url",
    )
