"""The reporting base view, its rolling windows and the export projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswatch.functions.text import moment, priority_score

# ---- fixed values ----
WINDOWS = {"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "6_months": "INTERVAL 6 MONTHS"}
TOP_WEEK_SCORE = 72
TOP_MONTH_SCORE = 75
EXPORT_COLUMNS = [
    "company_name",
    "industry_sector",
    "published_date",
    "priority_score",
    "title",
    "article_summary",
    "key_topic",
    "business_impact",
    "geography",
    "signal_type",
    "url",
    "summary_status",
]
# ---- end of fixed values ----

ARTICLE_COLUMNS = ["company_name", "industry_sector", "id", "url", "title", "published_date", "s_created_ts"]
SUMMARY_COLUMNS = [
    "article_summary",
    "key_topic",
    "business_impact",
    "geography",
    "signal_type",
    "summary_model",
    "summary_status",
]


def without_excluded(articles: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Articles whose id is not excluded; NULL ids stay."""
    return articles.join(exclusions.select("id").where("id IS NOT NULL"), "id", "left_anti")


def news_all(articles: DataFrame, summaries: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Base news view: articles, their summaries and a priority.

    Bodies are never selected, so a body column is pruned at the scan. Both
    joins hash on the article id, so large inputs shuffle once for the two.
    """
    kept = without_excluded(articles.select(*ARTICLE_COLUMNS), exclusions)
    tags = summaries.select(F.col("article_id").alias("id"), *SUMMARY_COLUMNS)
    score = priority_score(F.col("signal_type"), F.col("key_topic"), F.col("title"))
    return kept.join(tags, "id", "left").select(
        "company_name",
        "industry_sector",
        "id",
        "url",
        "title",
        "article_summary",
        "key_topic",
        "business_impact",
        "geography",
        "signal_type",
        score.alias("priority_score"),
        "summary_model",
        "summary_status",
        "published_date",
        "s_created_ts",
    )


def since(as_of, period: str):
    """Condition: published within the rolling window; NULL dates fail."""
    return F.col("published_date") >= moment(as_of) - F.expr(WINDOWS[period])


def news_window(news: DataFrame, as_of, period: str) -> DataFrame:
    """Rolling ``week``, ``month`` or ``6_months``; ``all`` keeps every row."""
    return news if period == "all" else news.where(since(as_of, period))


def top_news(news: DataFrame, as_of, period: str) -> DataFrame:
    """High-priority news of the week or month."""
    low = {"week": TOP_WEEK_SCORE, "month": TOP_MONTH_SCORE}[period]
    return news_window(news, as_of, period).where(F.col("priority_score") >= low)


def export_view(news: DataFrame) -> DataFrame:
    """The fixed twelve-column export projection."""
    return news.select(*EXPORT_COLUMNS)
