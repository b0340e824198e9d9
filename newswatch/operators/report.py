"""Report tables: overview counts, sheet orders and row colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.functions.text import HIGH_PRIORITY, moment
from newswatch.operators import marts
from newswatch.operators.warehouse import TOP_MONTH_SCORE, TOP_WEEK_SCORE, export_view, news_window, since, top_news

# ---- fixed values: row colour per company ----
COMPANY_COLORS = {
    "ALLIANCE HEALTHCARE": "D8EAF7",
    "ASTERA": "DFF2E1",
    "BIOCODEX": "FADBD8",
    "CEVA SANTE": "E8DAEF",
    "DELPHARM": "FCF3CF",
    "EUROFINS": "D6EAF8",
    "FAREVA": "F5C6C6",
    "GALDERMA": "D5F5E3",
    "HAELON": "FDEBD0",
    "IPSEN": "D4E6F1",
    "LILLY": "FADBD8",
    "MODERNA": "E8DAEF",
    "OPELLA": "F9E79F",
    "OXIPHARM": "D1F2EB",
    "PFIZER": "CFE2FF",
    "PIERRE FABRE": "FDEDEC",
    "SANOFI": "D6EAF8",
    "SEBIA": "EBDEF0",
    "SERVIER": "FAD7A0",
    "STAGO": "D5F5E3",
    "VIATRIS": "EAECEE",
    "VIRBAC": "D4EFDF",
}
# ---- end of fixed values ----

def news_order() -> list[Column]:
    return [
        F.desc_nulls_last("priority_score"),
        F.desc_nulls_last("published_date"),
        F.asc_nulls_last("company_name"),
        F.asc_nulls_last("title"),
    ]


def mart_orders() -> dict[str, list[Column]]:
    """The order of each mart sheet (K3)."""
    busiest = [F.desc("high_priority_last_30_days"), F.desc("articles_last_30_days")]
    return {
        "dea_kpis": [F.asc("metric")],
        "dea_company": [*busiest, F.asc_nulls_last("company_name")],
        "dea_topic_signal": [*busiest, F.asc("key_topic"), F.asc("signal_type")],
        "dea_exec_feed": news_order(),
    }


def report_overview(news: DataFrame, as_of) -> DataFrame:
    """Headline counts of the report, one scan."""
    counts = news.agg(
        F.count("*").alias("all_articles"),
        F.count_if(since(as_of, "week")).alias("week_articles"),
        F.count_if(since(as_of, "month")).alias("month_articles"),
        F.count_if(F.col("priority_score") >= HIGH_PRIORITY).alias("high_priority_articles"),
    )
    metrics = counts.columns
    stamped = counts.withColumn("generated_at_utc", moment(as_of))
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in metrics]
    stamp = F.struct(
        F.lit("generated_at_utc").alias("metric"),
        F.date_format("generated_at_utc", "yyyy-MM-dd'T'HH:mm:ss").alias("value"),
    )
    return stamped.select(F.inline(F.array(stamp, *pairs)))


def _counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value with NULL as its own value, most frequent first."""
    counts = rows.groupBy(column).agg(F.count("*").alias("article_count"))
    return counts.orderBy(F.desc("article_count"), F.asc_nulls_last(column))


def company_counts(news: DataFrame, as_of) -> DataFrame:
    return _counts(news_window(news, as_of, "month"), "company_name")


def topic_counts(news: DataFrame) -> DataFrame:
    return _counts(news, "key_topic")


def signal_counts(news: DataFrame) -> DataFrame:
    return _counts(news, "signal_type")


def with_color(rows: DataFrame) -> DataFrame:
    """The row's company colour, NULL when the company has none (X11)."""
    palette = F.create_map(*[F.lit(x) for pair in COMPANY_COLORS.items() for x in pair])
    return rows.withColumn("color", F.try_element_at(palette, F.upper("company_name")))


def news_sheets(news: DataFrame, as_of) -> dict[str, DataFrame]:
    """The six feed sheets in report order (K2)."""
    frames = {
        "top_week": top_news(news, as_of, "week"),
        "top_month": top_news(news, as_of, "month"),
        "news_week": news_window(news, as_of, "week"),
        "news_month": news_window(news, as_of, "month"),
        "news_6_months": news_window(news, as_of, "6_months"),
        "news_all": news,
    }
    return {name: with_color(export_view(frame)).orderBy(*news_order()) for name, frame in frames.items()}


def mart_sheets(news: DataFrame, as_of) -> dict[str, DataFrame]:
    """The four marts, each in its own order (K3)."""
    frames = {
        "dea_kpis": marts.kpi_overview(news, as_of),
        "dea_company": with_color(marts.company_intelligence(news, as_of)),
        "dea_topic_signal": marts.topic_signal_heatmap(news, as_of),
        "dea_exec_feed": with_color(marts.executive_feed(news, as_of)),
    }
    return {name: frame.orderBy(*mart_orders()[name]) for name, frame in frames.items()}


def overview_sheets(news: DataFrame, as_of) -> dict[str, DataFrame]:
    return {
        "overview": report_overview(news, as_of),
        "company_summary": with_color(company_counts(news, as_of)),
        "topic_summary": topic_counts(news),
        "signal_summary": signal_counts(news),
    }


def report_sheets(news: DataFrame, as_of) -> dict[str, DataFrame]:
    """All sheets of the report bundle by name (M9)."""
    sheets = {**overview_sheets(news, as_of), **mart_sheets(news, as_of), **news_sheets(news, as_of)}
    info = [
        ("generated_at_utc", str(as_of)),
        ("views_exported", ", ".join(news_sheets(news, as_of))),
        ("marts_exported", ", ".join(mart_orders())),
    ]
    sheets["export_info"] = news.sparkSession.createDataFrame(info, "key string, value string")
    return sheets


def sheet_counts(news: DataFrame, as_of) -> DataFrame:
    """Rows of each news sheet, from one scan (M9's returned counts)."""
    score = F.col("priority_score")
    conditions = {
        "top_week": since(as_of, "week") & (score >= TOP_WEEK_SCORE),
        "top_month": since(as_of, "month") & (score >= TOP_MONTH_SCORE),
        "news_week": since(as_of, "week"),
        "news_month": since(as_of, "month"),
        "news_6_months": since(as_of, "6_months"),
        "news_all": F.lit(True),
    }
    counts = news.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])
    pairs = [F.struct(F.lit(n).alias("sheet"), F.col(n).alias("row_count")) for n in conditions]
    return counts.select(F.inline(F.array(*pairs)))
