"""Feed selection, its filters and summaries, and the chat context."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswatch.functions.text import blank_to_null, date_label, safe_url
from newswatch.operators.warehouse import export_view, news_window
from newswatch.session import scratch_path

# ---- fixed values ----
PERIOD_LABELS = {
    "week": "Last 7 days",
    "month": "This month",
    "6_months": "Last 6 months",
    "all": "All available",
}
DEFAULT_PERIOD = "week"
FEED_LIMIT = 200
CHAT_LIMIT = 60
CHAT_SOURCES = 12
DIGEST_ARTICLES = 3
TOP_TOPICS = 5
BAR_COMPANIES = 5
PULSE_TOPICS = 6
MIN_BAR_WIDTH = 8.0
SOURCE_COLUMNS = [
    "company_name",
    "industry_sector",
    "published_date",
    "title",
    "article_summary",
    "business_impact",
    "priority_score",
    "url",
]
CONTEXT_COLUMNS = [
    "company_name",
    "industry_sector",
    "published_date",
    "priority_score",
    "title",
    "article_summary",
    "business_impact",
    "key_topic",
    "signal_type",
    "url",
]
# wording of the answer without a model
HEADING = "Here is the latest view for {} in {}."
ALL_COMPANIES = "all companies"
NOTHING_FOUND = "I do not see any articles for {} in {}."
SELECTED_COMPANIES = "the selected companies"
QUESTION = "Question asked: {}"
ARTICLE_COUNT = " article(s)"
SUMMARY_LINE = "\n  Summary: "
IMPACT_LINE = "\n  Why it matters: "
MORE_LINE = ("\n  ... plus ", " more article(s).")
# ---- end of fixed values ----


def feed_order() -> list[Column]:
    """Score, then date with undated rows last, then company; the url settles ties."""
    return [F.desc("priority_score"), F.desc_nulls_last("published_date"), F.asc("company_name"), F.asc("url")]


def known_period(period: str | None) -> str:
    """An unknown period means the default one."""
    return period if period in PERIOD_LABELS else DEFAULT_PERIOD


def periods(spark) -> DataFrame:
    """The period catalogue in display order."""
    rows = [(i, value, label) for i, (value, label) in enumerate(PERIOD_LABELS.items())]
    return spark.createDataFrame(rows, "position int, value string, label string")


def _equals(df: DataFrame, column: str, wanted: str | None) -> DataFrame:
    """Keep equal rows; NULL, '' and ALL in any case mean no filter."""
    return df if not wanted or wanted.upper() == "ALL" else df.where(F.col(column) == wanted)


def period_rows(news: DataFrame, as_of, period: str | None) -> DataFrame:
    return news_window(news, as_of, known_period(period))


def _choices(df: DataFrame, column: str) -> DataFrame:
    return df.where(blank_to_null(F.col(column)).isNotNull()).select(column).distinct().orderBy(column)


def sectors(news: DataFrame, as_of, period: str = "all") -> DataFrame:
    """Distinct non-blank sectors, sorted."""
    return _choices(period_rows(news, as_of, period), "industry_sector")


def companies(news: DataFrame, as_of, period: str = "all", sector: str | None = None) -> DataFrame:
    """Distinct non-blank companies of a sector, sorted."""
    return _choices(_equals(period_rows(news, as_of, period), "industry_sector", sector), "company_name")


def topics(
    news: DataFrame, as_of, period: str = "all", sector: str | None = None, company: str | None = None
) -> DataFrame:
    """Distinct non-blank topics of a sector and company, sorted (D3)."""
    rows = _equals(period_rows(news, as_of, period), "industry_sector", sector)
    return _choices(_equals(rows, "company_name", company), "key_topic")


def feed(
    news: DataFrame,
    as_of,
    sector: str | None = None,
    company: str | None = None,
    period: str | None = DEFAULT_PERIOD,
    topic: str | None = None,
    limit: int = FEED_LIMIT,
) -> DataFrame:
    """The filtered feed, best first (F11, K1). Equality filters reach the scan."""
    rows = _equals(period_rows(news, as_of, period), "industry_sector", sector)
    rows = _equals(_equals(rows, "company_name", company), "key_topic", topic)
    return export_view(rows).orderBy(*feed_order()).limit(limit)


def display_rows(rows: DataFrame) -> DataFrame:
    """Feed rows as shown: date text, '' for NULL text, checked link."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in rows.columns if c not in ("published_date", "priority_score")]
    return rows.select(
        *texts, "priority_score", date_label(F.col("published_date")).alias("published_date")
    ).withColumn("link", safe_url(F.col("url")))


def feed_summary(rows: DataFrame) -> DataFrame:
    """Article count, distinct companies and mean priority of the limited rows."""
    mean = F.coalesce(F.bround(F.avg("priority_score"), 1), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("article_count"),
        F.countDistinct(F.coalesce("company_name", F.lit(""))).alias("company_count"),
        mean.alias("avg_priority"),
    )


def _top_counts(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-blank values; ties by name."""
    counts = rows.where(blank_to_null(F.col(column)).isNotNull()).groupBy(column).agg(F.count("*").alias("article_count"))
    return counts.orderBy(F.desc("article_count"), column).limit(n)


def top_topics(rows: DataFrame, n: int = TOP_TOPICS) -> DataFrame:
    """Most frequent topics of the feed (A10)."""
    return _top_counts(rows, "key_topic", n)


def topic_pulse(rows: DataFrame) -> DataFrame:
    """Topic chips of the overview."""
    return _top_counts(rows, "key_topic", PULSE_TOPICS)


def company_bars(rows: DataFrame) -> DataFrame:
    """Most frequent companies with a bar width in percent."""
    top = _top_counts(rows, "company_name", BAR_COMPANIES)
    widest = F.max("article_count").over(Window.partitionBy(F.lit(1)))  # at most BAR_COMPANIES rows
    width = F.greatest(F.col("article_count") / widest * 100, F.lit(MIN_BAR_WIDTH))
    return top.withColumn("bar_width", width)


def chat_feed(news: DataFrame, as_of, company: str | None = None, period: str | None = DEFAULT_PERIOD) -> DataFrame:
    """Rows a chat answer is based on."""
    return feed(news, as_of, company=company, period=period, limit=CHAT_LIMIT)


def chat_sources(rows: DataFrame) -> DataFrame:
    """The first rows of the feed as cited sources (K4)."""
    return display_rows(rows.orderBy(*feed_order()).limit(CHAT_SOURCES)).select(*SOURCE_COLUMNS)


def chat_context(rows: DataFrame) -> DataFrame:
    """One JSON object per article for a model prompt."""
    shown = display_rows(rows)
    return shown.select("url", F.to_json(F.struct(*CONTEXT_COLUMNS)).alias("context"))


def chat_digest(rows: DataFrame) -> DataFrame:
    """Per company: article count, its first articles and how many more.

    The input is a limited feed, so a company's rows are few by construction.
    """
    ranked = rows.withColumn(
        "position",
        F.row_number().over(Window.partitionBy("company_name").orderBy(*feed_order())),
    )
    entry = F.struct(
        "position",
        F.concat(date_label(F.col("published_date")), F.lit(" | "), F.coalesce(F.trim("title"), F.lit(""))).alias("line"),
        F.coalesce(F.trim("article_summary"), F.lit("")).alias("summary"),
        F.coalesce(F.trim("business_impact"), F.lit("")).alias("impact"),
    )
    grouped = ranked.groupBy("company_name").agg(
        F.count("*").alias("article_count"),
        F.array_sort(F.collect_list(F.when(F.col("position") <= DIGEST_ARTICLES, entry))).alias("firsts"),
    )

    def text(item: Column) -> Column:
        return F.concat(
            F.lit("\n- "),
            item["line"],
            F.when(item["summary"] != "", F.concat(F.lit(SUMMARY_LINE), item["summary"])).otherwise(""),
            F.when(item["impact"] != "", F.concat(F.lit(IMPACT_LINE), item["impact"])).otherwise(""),
        )

    more = F.col("article_count") - DIGEST_ARTICLES
    body = F.concat(
        F.col("company_name"),
        F.lit(": "),
        F.col("article_count").cast("string"),
        F.lit(ARTICLE_COUNT),
        F.array_join(F.transform("firsts", text), ""),
        F.when(more > 0, F.concat(F.lit(MORE_LINE[0]), more.cast("string"), F.lit(MORE_LINE[1]))).otherwise(""),
    )
    return grouped.select("company_name", "article_count", body.alias("digest")).orderBy("company_name")


def chat_answer(rows: DataFrame, question: str, company: str | None = None, period: str | None = DEFAULT_PERIOD) -> DataFrame:
    """The answer text built from the feed alone: heading, one part per company, the question.

    One row, also for an empty feed. The feed is limited, so its companies are few.
    """
    where = PERIOD_LABELS[known_period(period)].lower()
    parts = F.array_sort(F.collect_list(F.struct("company_name", "digest")))
    joined = chat_digest(rows).agg(parts.alias("parts"))
    heading = HEADING.format(company or ALL_COMPANIES, where)
    body = F.array_join(F.transform("parts", lambda p: F.concat(p["digest"], F.lit("\n\n"))), "")
    asked = (question or "").strip()
    text = F.rtrim(F.concat(F.lit(f"{heading}\n\n"), body)) if not asked else F.concat(
        F.lit(f"{heading}\n\n"), body, F.lit(QUESTION.format(asked))
    )
    nothing = NOTHING_FOUND.format(company or SELECTED_COMPANIES, where)
    return joined.select(F.when(F.size("parts") == 0, F.lit(nothing)).otherwise(F.regexp_replace(text, r"\s+$", "")).alias("answer"))


def combinations(news: DataFrame, as_of, period: str | None) -> DataFrame:
    """Sectors, companies and topics that occur together in a period: all choices come from these."""
    return period_rows(news, as_of, period).groupBy("industry_sector", "company_name", "key_topic").agg(F.count(F.lit(1)).alias("article_count"))


def valid_choices(combined: DataFrame, sector: str | None, company: str | None, topic: str | None) -> tuple[str, str, str]:
    """The wanted values that are offered, else ALL, each among the rows the ones before it leave.

    One row of counts answers for all three: whether a value is offered under each choice that can be in force before it.
    """
    names, wanted = ("industry_sector", "company_name", "key_topic"), [w or "ALL" for w in (sector, company, topic)]
    known = [F.col(n) == w for n, w in zip(names, wanted, strict=True)]
    offered = {}
    for k, name in enumerate(names):
        for kept in product((False, True), repeat=k):
            under = [known[j] for j in range(k) if kept[j]]
            offered[kept, k] = reduce(and_, [*under, known[k], blank_to_null(F.col(name)).isNotNull()])
    counts = combined.agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(offered.values())]).first()
    found = dict(zip(offered, counts, strict=True))
    chosen: list[str] = []
    for k, w in enumerate(wanted):
        kept = tuple(c.upper() != "ALL" for c in chosen)
        chosen.append(w if w.upper() == "ALL" or found[kept, k] else "ALL")
    return chosen[0], chosen[1], chosen[2]


def dashboard(
    news: DataFrame,
    as_of,
    sector: str | None = None,
    company: str | None = None,
    period: str | None = DEFAULT_PERIOD,
    topic: str | None = None,
    limit: int = FEED_LIMIT,
) -> dict:
    """The whole dashboard as DataFrames plus the selections in force.

    The base is read twice: for the choices, from which those in force are taken, and for the feed they
    select. Everything shown comes from these two small tables.
    """
    spark = news.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    combined = stored(combinations(news, as_of, period), "choices")
    sector, company, topic = valid_choices(combined, sector, company, topic)
    of_sector = _equals(combined, "industry_sector", sector)
    rows = stored(feed(news, as_of, sector, company, period, topic, limit), "feed")
    return {
        "selected": {"industry_sector": sector, "company": company, "period": period, "topic": topic},
        "industry_sectors": _choices(combined, "industry_sector"),
        "companies": _choices(of_sector, "company_name"),
        "topics": _choices(_equals(of_sector, "company_name", company), "key_topic"),
        "periods": periods(news.sparkSession),
        "summary": feed_summary(rows),
        "top_topics": top_topics(rows),
        "rows": display_rows(rows.orderBy(*feed_order())),
    }
