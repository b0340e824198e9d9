"""SQL oracle of the reporting queries: base view, marts, feed, report tables."""

from __future__ import annotations

from newswatch.sources.driver_tables import AS_OF, oracle_cte

T = f"TIMESTAMP '{AS_OF}'"
WEEK = f"published_date >= {T} - INTERVAL 7 DAY"
MONTH = f"published_date >= {T} - INTERVAL 1 MONTH"
HALF_YEAR = f"published_date >= {T} - INTERVAL 6 MONTH"

NEWS = """news AS (
SELECT a.company_name, a.industry_sector, a.id, a.url, a.title, s.article_summary, s.key_topic, s.business_impact,
       s.geography, s.signal_type,
       CASE WHEN coalesce(s.signal_type, '') IN ('approval', 'acquisition', 'merger', 'trial-readout', 'earnings') THEN 95
            WHEN coalesce(s.key_topic, '') IN ('regulatory', 'm&a', 'financial') THEN 88
            WHEN coalesce(s.signal_type, '') IN ('partnership', 'plant-expansion', 'launch') THEN 80
            WHEN coalesce(s.key_topic, '') IN ('clinical', 'partnership', 'manufacturing', 'product') THEN 72
            WHEN lower(a.title) LIKE '%phase 3%' THEN 84 WHEN lower(a.title) LIKE '%fda%' THEN 90
            WHEN lower(a.title) LIKE '%acquisition%' THEN 92 WHEN lower(a.title) LIKE '%earnings%' THEN 90
            ELSE 55 END AS priority_score,
       s.summary_model, s.summary_status, a.published_date, a.s_created_ts
FROM articles AS a LEFT JOIN summaries AS s ON s.article_id = a.id
LEFT JOIN exclusions AS x ON x.id = a.id WHERE x.id IS NULL)"""

EXPORT = (
    "company_name, industry_sector, published_date, priority_score, title, article_summary, key_topic, "
    "business_impact, geography, signal_type, url, summary_status"
)


def with_news(body: str, *more: str) -> str:
    parts = [oracle_cte("articles"), oracle_cte("summaries"), oracle_cte("exclusions"), NEWS, *more]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _windows() -> dict[str, str]:
    conditions = {
        "news_all": "true",
        "news_week": WEEK,
        "news_month": MONTH,
        "news_6_months": HALF_YEAR,
        "top_news_week": f"{WEEK} AND priority_score >= 72",
        "top_news_month": f"{MONTH} AND priority_score >= 75",
    }
    out = {name: with_news(f"SELECT * FROM news WHERE {c}") for name, c in conditions.items()}
    out |= {f"{name}_export": with_news(f"SELECT {EXPORT} FROM news WHERE {c}") for name, c in conditions.items()}
    return out


TAGGED = """tagged AS (SELECT *, coalesce(nullif(key_topic, ''), 'uncategorized') AS topic,
       coalesce(nullif(signal_type, ''), 'uncategorized') AS signal FROM news)"""


def _ranked(tag: str) -> str:
    return f"""best_{tag} AS (SELECT industry_sector, company_name, {tag} FROM (
    SELECT industry_sector, company_name, {tag},
           row_number() OVER (PARTITION BY industry_sector, company_name ORDER BY count(*) DESC, {tag}) AS rank
    FROM tagged WHERE {MONTH} GROUP BY industry_sector, company_name, {tag}) WHERE rank = 1)"""


def _marts() -> dict[str, str]:
    kpis = [
        ("total_articles", "count(*)", "All articles in the reporting warehouse"),
        ("articles_last_7_days", f"count(*) FILTER (WHERE {WEEK})", "Articles published in the rolling last 7 days"),
        ("articles_last_30_days", f"count(*) FILTER (WHERE {MONTH})", "Articles published in the rolling last month"),
        (
            "high_priority_last_30_days",
            f"count(*) FILTER (WHERE {MONTH} AND priority_score >= 75)",
            "High-priority articles in the rolling last month",
        ),
        (
            "active_companies_last_30_days",
            f"count(DISTINCT company_name) FILTER (WHERE {MONTH})",
            "Companies with at least one article in the rolling last month",
        ),
        (
            "articles_missing_summary",
            "count(*) FILTER (WHERE article_summary IS NULL OR summary_status NOT IN ('ai', 'fallback'))",
            "Articles still missing a completed AI summary",
        ),
    ]
    branches = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {e} AS v, '{label}' AS metric_label FROM news" for m, e, label in kpis
    )
    return {
        "kpi_overview": with_news(
            f"SELECT metric, CAST(v AS DOUBLE) AS numeric_value, CAST(v AS VARCHAR) AS metric_value, metric_label, "
            f"{T} AS generated_at FROM ({branches})"
        ),
        "company_intelligence": with_news(
            """SELECT r.*, coalesce(t.topic, 'no recent topic') AS leading_topic_last_30_days,
       coalesce(s.signal, 'no recent signal') AS leading_signal_last_30_days,
       CASE WHEN high_priority_last_30_days >= 3 THEN 'high' WHEN high_priority_last_30_days >= 1 THEN 'medium'
            ELSE 'watch' END AS attention_level
FROM rollup_ AS r
LEFT JOIN best_topic AS t ON t.industry_sector = r.industry_sector AND t.company_name = r.company_name
LEFT JOIN best_signal AS s ON s.industry_sector = r.industry_sector AND s.company_name = r.company_name""",
            TAGGED,
            f"""rollup_ AS (SELECT industry_sector, company_name,
       count(*) FILTER (WHERE {WEEK}) AS articles_last_7_days,
       count(*) FILTER (WHERE {MONTH}) AS articles_last_30_days,
       count(*) FILTER (WHERE {HALF_YEAR}) AS articles_last_6_months,
       count(*) AS articles_all,
       count(*) FILTER (WHERE {MONTH} AND priority_score >= 75) AS high_priority_last_30_days,
       CAST(round(CAST(avg(priority_score) FILTER (WHERE {MONTH}) AS DECIMAL(18, 6)), 1) AS DOUBLE)
            AS avg_priority_last_30_days,
       max(priority_score) FILTER (WHERE {MONTH}) AS top_priority_score_30_days,
       max(published_date) AS latest_published_date
FROM news GROUP BY industry_sector, company_name)""",
            _ranked("topic"),
            _ranked("signal"),
        ),
        "company_tag_counts": with_news(
            f"""SELECT industry_sector, company_name, 'topic' AS kind, topic AS tag, count(*) AS n_month
FROM tagged WHERE {MONTH} GROUP BY ALL
UNION ALL SELECT industry_sector, company_name, 'signal', signal, count(*) FROM tagged WHERE {MONTH} GROUP BY ALL""",
            TAGGED,
        ),
        "topic_signal_heatmap": with_news(
            f"""SELECT industry_sector, topic AS key_topic, signal AS signal_type, count(*) AS articles_last_30_days,
       count(*) FILTER (WHERE priority_score >= 75) AS high_priority_last_30_days,
       count(DISTINCT company_name) AS companies_last_30_days,
       CAST(round(CAST(avg(priority_score) AS DECIMAL(18, 6)), 1) AS DOUBLE) AS avg_priority_score,
       max(published_date) AS latest_published_date
FROM tagged WHERE {MONTH} GROUP BY industry_sector, topic, signal""",
            TAGGED,
        ),
        "executive_feed": with_news(
            f"""SELECT industry_sector, company_name, published_date, priority_score,
       CASE WHEN priority_score >= 90 THEN 'critical' WHEN priority_score >= 75 THEN 'high'
            WHEN priority_score >= 60 THEN 'medium' ELSE 'standard' END AS priority_band,
       title, article_summary, key_topic, business_impact, geography, signal_type, url
FROM news WHERE {MONTH} AND (priority_score >= 75 OR {WEEK})"""
        ),
    }


ORDER = "ORDER BY priority_score DESC, published_date DESC NULLS LAST, company_name, url"


def _feed(condition: str, limit: int) -> str:
    return f"feed AS (SELECT {EXPORT} FROM news WHERE {condition} {ORDER} LIMIT {limit})"


SHOWN = """shown AS (SELECT company_name, industry_sector, coalesce(strftime(published_date, '%Y-%m-%d'), '') AS day,
       priority_score, coalesce(title, '') AS title, coalesce(article_summary, '') AS article_summary,
       coalesce(key_topic, '') AS key_topic, coalesce(business_impact, '') AS business_impact,
       coalesce(geography, '') AS geography, coalesce(signal_type, '') AS signal_type, url,
       coalesce(summary_status, '') AS summary_status, published_date FROM feed)"""


def _feeds() -> dict[str, str]:
    everything = _feed("true", 200)
    chat = _feed(MONTH, 60)

    def top(column: str, n: int) -> str:
        return f"""SELECT {column}, count(*) AS article_count FROM feed WHERE coalesce({column}, '') <> ''
GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT {n}"""

    digest = """SELECT company_name, count(*) AS article_count,
       concat(company_name, ': ', count(*), ' article(s)', string_agg(line, '' ORDER BY position),
              CASE WHEN count(*) > 3 THEN concat(chr(10), '  ... plus ', count(*) - 3, ' more article(s).') ELSE '' END)
            AS digest
FROM (SELECT *, CASE WHEN position > 3 THEN '' ELSE concat(chr(10), '- ', day, ' | ', title,
             CASE WHEN article_summary <> '' THEN concat(chr(10), '  Summary: ', article_summary) ELSE '' END,
             CASE WHEN business_impact <> '' THEN concat(chr(10), '  Why it matters: ', business_impact) ELSE '' END)
             END AS line FROM ranked) GROUP BY company_name"""
    ranked = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY company_name {ORDER}) AS position FROM shown)"
    linked = """SELECT * EXCLUDE (day, published_date), day AS published_date,
       CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url ELSE '' END AS link"""
    return {
        "chat_answer": with_news(
            """SELECT concat('Here is the latest view for all companies in this month.', chr(10), chr(10),
       string_agg(concat(digest, chr(10), chr(10)), '' ORDER BY company_name), 'Question asked: What is new?') AS answer
FROM digests""",
            chat,
            SHOWN,
            ranked,
            f"digests AS ({digest})",
        ),
        "chat_answer_empty": with_news(
            """SELECT CASE WHEN count(*) = 0 THEN 'I do not see any articles for NOBODY in last 7 days.' END AS answer
FROM news WHERE company_name = 'NOBODY'"""
        ),
        "dashboard_rows": with_news(
            f"{linked}, 'BANKING' AS chosen_industry_sector, 'ALL' AS chosen_company, 'ALL' AS chosen_topic FROM shown",
            _feed(f"{HALF_YEAR} AND industry_sector = 'BANKING'", 200),
            SHOWN,
        ),
        "sectors": with_news("SELECT DISTINCT industry_sector FROM news WHERE coalesce(industry_sector, '') <> ''"),
        "companies": with_news(
            f"SELECT DISTINCT company_name FROM news WHERE {HALF_YEAR} AND industry_sector = 'LIFESCIENCE'"
        ),
        "topics": with_news(
            f"""SELECT DISTINCT key_topic FROM news WHERE {HALF_YEAR} AND industry_sector = 'LIFESCIENCE'
AND company_name = 'SRC0' AND coalesce(key_topic, '') <> ''"""
        ),
        "feed_filtered": with_news(
            "SELECT * FROM feed", _feed(f"{HALF_YEAR} AND industry_sector = 'BANKING' AND key_topic = 'm&a'", 200)
        ),
        "feed_ranked": with_news("SELECT * FROM feed", everything),
        "feed_display": with_news(
            f"{linked} FROM shown",
            everything,
            SHOWN,
        ),
        "feed_summary": with_news(
            """SELECT count(*) AS article_count, count(DISTINCT company_name) AS company_count,
       round_even(avg(priority_score), 1) AS avg_priority FROM feed""",
            everything,
        ),
        "top_topics": with_news(top("key_topic", 5), everything),
        "topic_pulse": with_news(top("key_topic", 6), everything),
        "company_bars": with_news(
            f"""SELECT *, greatest(article_count / max(article_count) OVER () * 100, 8.0::DOUBLE) AS bar_width
FROM ({top("company_name", 5)})""",
            everything,
        ),
        "chat_sources": with_news(
            f"""SELECT company_name, industry_sector, day AS published_date, title, article_summary, business_impact,
       priority_score, url FROM (SELECT * FROM shown {ORDER} LIMIT 12)""",
            chat,
            SHOWN,
        ),
        "chat_context": with_news(
            """SELECT url, concat('{"company_name":"', company_name, '","industry_sector":"', industry_sector,
       '","published_date":"', day, '","priority_score":', priority_score, ',"title":"', title,
       '","article_summary":"', article_summary, '","business_impact":"', business_impact, '","key_topic":"', key_topic,
       '","signal_type":"', signal_type, '","url":"', url, '"}') AS context FROM shown""",
            chat,
            SHOWN,
        ),
        "chat_digest": with_news(digest, chat, SHOWN, ranked),
    }


def _report() -> dict[str, str]:
    conditions = {
        "top_week": f"{WEEK} AND priority_score >= 72",
        "top_month": f"{MONTH} AND priority_score >= 75",
        "news_week": WEEK,
        "news_month": MONTH,
        "news_6_months": HALF_YEAR,
        "news_all": "true",
    }
    overview = {
        "all_articles": "true",
        "week_articles": WEEK,
        "month_articles": MONTH,
        "high_priority_articles": "priority_score >= 75",
    }
    rows = [
        f"SELECT '{m}' AS metric, CAST(count(*) FILTER (WHERE {c}) AS VARCHAR) AS value FROM news"
        for m, c in overview.items()
    ]
    stamp = f"SELECT 'generated_at_utc' AS metric, '{AS_OF.replace(' ', 'T')}' AS value"
    company = _marts()["company_intelligence"].replace("SELECT r.*,", "SELECT r.*, CAST(NULL AS VARCHAR) AS color,")
    return {
        "report_overview": with_news(" UNION ALL ".join([stamp, *rows])),
        "company_counts": with_news(
            f"SELECT company_name, count(*) AS article_count FROM news WHERE {MONTH} GROUP BY company_name"
        ),
        "topic_counts": with_news("SELECT key_topic, count(*) AS article_count FROM news GROUP BY key_topic"),
        "signal_counts": with_news("SELECT signal_type, count(*) AS article_count FROM news GROUP BY signal_type"),
        "report_news_month": with_news(f"SELECT {EXPORT}, CAST(NULL AS VARCHAR) AS color FROM news WHERE {MONTH}"),
        "report_companies": company,
        "report_sheet_counts": with_news(
            " UNION ALL ".join(
                f"SELECT '{s}' AS sheet, count(*) AS row_count FROM news WHERE {c}" for s, c in conditions.items()
            )
        ),
    }


def oracle() -> dict[str, str]:
    return {**_windows(), **_marts(), **_feeds(), **_report()}
