"""Adapters: the driver's Parquet tables shaped as warehouse tables.

Each adapter is one SELECT that Spark and the SQL oracle run alike; ``{TS}``
is the zone-less timestamp type and ``{name}`` a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-07-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
FLOW = "NEWS_FLOW"

ADAPTERS: dict[str, str] = {
    "articles": """
SELECT CAST(doc_id AS STRING) AS id, upper(source) AS company_name,
       CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'LIFESCIENCE' WHEN 1 THEN 'BANKING'
            WHEN 2 THEN 'ENERGY' ELSE 'SPACE' END AS industry_sector,
       concat('https://', source, '.example.com/news/', CAST(doc_id AS STRING)) AS url,
       concat(CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'FDA and Phase 3 update ' WHEN 1 THEN 'FDA notice '
              WHEN 2 THEN 'Acquisition of ' WHEN 3 THEN 'Earnings call ' WHEN 4 THEN 'Patient study in France '
              WHEN 5 THEN 'Alliance in Japan ' WHEN 6 THEN 'Sales in Europe ' ELSE 'Company note ' END,
              CAST(doc_id AS STRING)) AS title,
       text AS article_content,
       CASE WHEN doc_id % 17 = 0 THEN NULL
            ELSE CAST(DATE '2024-07-01' - CAST((doc_id * 37) % 400 AS INT) AS {TS}) END AS published_date,
       CAST(DATE '2024-07-01' - CAST(doc_id % 30 AS INT) AS {TS}) AS s_created_ts
FROM {documents}""",
    # NULL and '' tags included, no row for unlabelled documents
    "summaries": """
SELECT CAST(doc_id AS STRING) AS article_id, concat('summary ', CAST(doc_id AS STRING)) AS article_summary,
       CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'regulatory' WHEN 1 THEN 'm&a' WHEN 2 THEN 'clinical'
            WHEN 3 THEN 'corporate' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'product' END AS key_topic,
       CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN NULL ELSE concat('impact ', CAST(doc_id AS STRING)) END
            AS business_impact,
       CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'France' WHEN 1 THEN 'Europe' WHEN 2 THEN '' ELSE NULL END
            AS geography,
       CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'earnings' WHEN 1 THEN 'launch' WHEN 2 THEN ''
            WHEN 3 THEN NULL ELSE 'leadership-change' END AS signal_type,
       CASE WHEN quality = 1 THEN 'local:model:v1' ELSE 'fallback-extractive-v1' END AS summary_model,
       CASE WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'ai' ELSE 'fallback' END AS summary_status
FROM {labels}""",
    # stored hashes: current for good labels, stale for the others
    "summary_hashes": """
SELECT CAST(l.doc_id AS STRING) AS article_id,
       CASE WHEN l.quality = 1 THEN {SHA}(trim(regexp_replace(d.text, '{WS}', ' '{ALL})){BITS}) ELSE 'stale' END
            AS content_hash,
       CASE WHEN l.quality = 1 THEN 'local:model:v1' ELSE 'fallback-extractive-v1' END AS summary_model,
       CASE WHEN l.toxic = 1 THEN 'fallback' ELSE 'ai' END AS summary_status
FROM {labels} AS l JOIN {documents} AS d ON d.doc_id = l.doc_id""",
    "exclusions": """
SELECT upper(d.source) AS company_name, CAST(d.doc_id AS STRING) AS id, concat('excluded ', d.source) AS title
FROM {documents} AS d JOIN {labels} AS l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND l.toxic = 1""",
    "activity": """
SELECT CAST(event_id AS STRING) AS activity_id, concat('user', CAST(user_id % 40 AS STRING)) AS username,
       CASE CAST(user_id % 40 % 3 AS INT) WHEN 0 THEN 'admin' WHEN 1 THEN 'viewer' ELSE 'guest' END AS role,
       CASE event_type WHEN 'signup' THEN 'login' WHEN 'view' THEN 'news_filter'
            WHEN 'click' THEN 'ai_chat' ELSE event_type END AS activity_type,
       CASE event_type WHEN 'click' THEN '/api/dashboard/chat' ELSE '/dashboard' END AS activity_path,
       props AS activity_meta, CAST(NULL AS STRING) AS request_id,
       concat('10.0.0.', CAST(user_id % 50 AS STRING)) AS client_ip, ts AS created_ts
FROM {events}""",
    # one row per day and company
    "monitoring": """
SELECT concat('run-', CAST(CAST(ts AS DATE) AS STRING)) AS run_id, 'NEWS_FLOW' AS run_name,
       concat('SRC', CAST(user_id % 20 AS STRING)) AS company_name,
       CASE WHEN user_id % 20 < 10 THEN 'FULL' ELSE 'DELTA' END AS load_type,
       CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0
             AND count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS run_status,
       CAST(NULL AS STRING) AS run_message,
       count(*) FILTER (WHERE event_type = 'purchase') AS records_inserted, count(*) AS urls_attempted,
       count(*) FILTER (WHERE event_type <> 'error') AS urls_fetched,
       count(*) FILTER (WHERE event_type = 'view') AS parse_success_count,
       count(*) FILTER (WHERE event_type = 'error') AS error_count,
       min(ts) AS run_start_ts, max(ts) AS run_end_ts
FROM {events} GROUP BY CAST(ts AS DATE), user_id % 20""",
    # one fetch attempt per event
    "fetch_log": """
SELECT concat('SRC', CAST(user_id % 20 AS STRING)) AS company_name,
       concat('https://src', CAST(user_id % 20 AS STRING), '.example.com/news/', CAST(event_id AS STRING)) AS url,
       event_type <> 'error' AS fetched, event_type = 'view' AS parsed,
       CASE WHEN event_type = 'error' AND value < 5 THEN NULL ELSE round(value * 64) / 64 END AS response_time_ms
FROM {events}""",
    # blank sectors, padded duplicates, a bad scheme, NULL slots, some companies with all five slots
    "load_sources": """
SELECT upper(source) AS company_name, CASE WHEN n % 6 = 0 THEN ' ' ELSE ' banking ' END AS industry_sector,
       concat('https://', source, '.example.com/news/') AS source_1,
       CASE WHEN n % 2 = 0 THEN concat(' https://', source, '.example.com/news/ ')
            ELSE concat('http://', source, '.example.com/press/') END AS source_2,
       CASE WHEN n % 3 = 0 THEN 'ftp://old.example.com' END AS source_3,
       CASE WHEN n % 5 = 0 THEN concat('https://', source, '.example.com/a/') END AS source_4,
       CASE WHEN n % 5 = 0 THEN concat('https://', source, '.example.com/b/') END AS source_5
FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM {documents}) AS d""",
    # mixed case, blank load type, inactive rows, NULL sector
    "load_config": """
SELECT 'NEWS_FLOW' AS flow_name, upper(source) AS company_name,
       CASE n % 3 WHEN 0 THEN ' full ' WHEN 1 THEN 'DELTA' ELSE '' END AS load_type,
       CASE n % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'Y' WHEN 2 THEN 'N' ELSE 'Y' END AS active_flag,
       CASE n % 5 WHEN 0 THEN NULL ELSE 'energy' END AS industry_sector
FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS n FROM {documents}) AS d""",
    # known and new companies, invalid sector, known, new and invalid urls, three states
    "requests": """
SELECT concat('req', CAST(c_custkey AS STRING)) AS request_id,
       concat('  src', CAST(c_custkey % 25 AS STRING), ' ') AS company_name,
       CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'banking' WHEN 1 THEN ' SPACE ' WHEN 2 THEN 'RETAIL'
            ELSE 'ENERGY' END AS industry_sector,
       CASE CAST(c_custkey % 3 AS INT)
            WHEN 0 THEN concat('https://src', CAST(c_custkey % 25 AS STRING), '.example.com/news/')
            WHEN 1 THEN concat(' https://new', CAST(c_custkey % 11 AS STRING), '.example.com ')
            ELSE 'www.example.com' END AS source_url,
       CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'REJECTED' WHEN 1 THEN 'PENDING' ELSE 'APPROVED' END
            AS review_status,
       concat('user', CAST(c_custkey % 40 AS STRING)) AS submitter_username, 'guest' AS submitter_role,
       CAST(DATE '2024-06-01' + CAST(c_custkey % 29 AS INT) AS {TS}) AS requested_ts
FROM {customer}""",
    # scraped records: every article, and a second copy of each under another company with other blanks
    "records": """
SELECT concat('SRC', CAST((doc_id + k) % 20 AS STRING)) AS company_name,
       concat(CAST(doc_id AS STRING), '-', CAST(k AS STRING)) AS id,
       concat('https://', source, '.example.com/news/') AS source_url,
       CASE WHEN doc_id % 23 = 0 THEN concat('ftp://', source, '.example.com/', CAST(doc_id AS STRING))
            WHEN doc_id % 31 = 0 THEN NULL
            ELSE concat(' https://', source, '.example.com/news/', CAST(doc_id AS STRING), ' ') END AS url,
       CASE WHEN doc_id % 19 = 0 THEN ' short ' WHEN doc_id % 37 = 0 THEN NULL
            ELSE concat(' Company note ', CAST(doc_id AS STRING), ' ') END AS title,
       text AS article_content,
       CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'unknown'
            WHEN doc_id % 2 = 0 THEN concat(CAST(DATE '2024-01-31' - CAST(doc_id % 60 AS INT) AS STRING), 'T12:00:00+00:00')
            ELSE CAST(DATE '2024-01-31' - CAST(doc_id % 60 AS INT) AS STRING) END AS published_date,
       '2024-01-31T00:00:00+00:00' AS s_created_ts,
       CAST(n_chars % 1000 AS DOUBLE) / 8 AS response_time_ms,
       doc_id * 2 + (1 - k) AS seq
FROM (SELECT *, 0 AS k FROM {documents} UNION ALL SELECT *, 1 AS k FROM {documents}) AS d""",
    # staging rows: each article under two tables, some without id, legacy schemas too
    "staged": """
SELECT CASE WHEN k = 1 THEN concat('stg_ls_', source) WHEN doc_id % 2 = 0 THEN 'stg_banking' ELSE 'stg_space' END
            AS schemaname,
       concat('stg_', source) AS tablename, upper(source) AS company_name,
       CASE WHEN doc_id % 2 = 0 THEN 'BANKING' ELSE 'SPACE' END AS industry_sector,
       CASE WHEN doc_id % 41 = 0 THEN NULL ELSE CAST(doc_id AS STRING) END AS id,
       concat('https://', source, '.example.com/news/', CAST(doc_id - k * (doc_id % 3) AS STRING)) AS url,
       concat('Note ', CAST(doc_id AS STRING)) AS title,
       CAST(DATE '2024-07-01' - CAST(doc_id % 400 AS INT) AS {TS}) AS published_date,
       CAST(DATE '2024-07-01' AS {TS}) AS s_created_ts, doc_id * 2 + k AS seq
FROM (SELECT *, 0 AS k FROM {documents} UNION ALL SELECT *, 1 AS k FROM {documents}) AS d""",
    # table names in mixed case, staged or not
    "listing": """
SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN 'STG_LifeScience' WHEN doc_id % 3 = 1 THEN 'stg_air_space' ELSE 'dwh' END
            AS schemaname,
       CASE WHEN doc_id % 2 = 0 THEN concat('Stg_', source, '_', lang) ELSE concat('v_', source) END AS tablename
FROM {documents}""",
    # stored settings, counted from the texts
    "scraping_config": """
SELECT CASE lang WHEN 'de' THEN 'MAX_ITEMS_PER_SOURCE' WHEN 'en' THEN 'MIN_TITLE_LENGTH'
            WHEN 'es' THEN 'EXPORT_RESULTS' ELSE 'CUSTOM_NOTE' END AS param_name,
       CASE lang WHEN 'es' THEN ' Yes ' ELSE CAST(count(*) AS STRING) END AS param_value
FROM {documents} GROUP BY lang""",
    # listing pages, one per article: embedded items, links in and out of containers, dates in several tags
    "listings": """
SELECT doc_id, upper(source) AS company_name, concat(root, '/list/', n) AS url, root, n, kind,
       concat('<html><head><title> Listing &amp; more ', n, ' </title>',
              CASE CAST(doc_id % 5 AS INT)
                   WHEN 0 THEN '<meta property="article:published_time" content="2024-05-01T10:00:00+02:00">'
                   WHEN 1 THEN '<meta content="2024-05-02" name="pubdate">'
                   WHEN 2 THEN '<time datetime="2020-01-01"><b>2024-05-03</b> 08:00:00</time>'
                   WHEN 3 THEN '<meta itemprop="datePublished" content="soon">' ELSE '' END,
              '<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","url":"/news/j', n,
              '","headline":"Item ', n, '","datePublished":"', CAST(item_day AS STRING),
              'T10:00:00Z"},{"@type":["BlogPosting","Thing"],"mainEntityOfPage":{"@id":"/story/k', n,
              '"},"name":"Story"},{"@type":"Person","url":"/news/p"},',
              '{"@type":"Article","url":"https://other.example.org/news/x"}]}</script></head><body>',
              '<nav><a href="/news/nav', n, '">Nav</a></nav><div class="wide news"><a href="/news/a', n,
              '">Read</a><a href="/about/', n, '">Press note</a><a href="/about/plain">Contact</a><a href="/news/a', n,
              '">Again</a></div><p><a href="/article/b', n, '">Story</a><a href="/article/file.pdf">File</a></p>',
              '<div class="card"><a href="/2024-05-01-Viatris-', n, '">V</a></div><a href="/press-release/d', n,
              '">x</a><article><a href="/news/c', n, '">Lead</a><a href="/list/', n, '?page=2">Next news</a></article>',
              '<p><a href="?o=20">Older</a> <a href="?cat=', n, '">Category</a></p><p>', safe, '</p></body></html>') AS html,
       safe, text, item_day
FROM (SELECT *, CAST(doc_id AS STRING) AS n, CAST(doc_id % 4 AS INT) AS kind,
             DATE '2024-02-15' - CAST(doc_id % 40 AS INT) AS item_day,
             CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'https://newsroom.viatris.com' WHEN 1 THEN 'https://www.ceva.com'
                  ELSE concat('https://', source, '.example.com') END AS root,
             replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe
      FROM {documents}) AS d""",
    # a model's replies: bare JSON, JSON inside prose, blanks, and broken text
    "replies": """
SELECT CAST(d.doc_id AS STRING) AS article_id,
       CASE CAST(d.doc_id % 5 AS INT)
            WHEN 0 THEN concat('{"article_summary": "  About ', d.source, '  ", "key_topic": "product", "geography": null}')
            WHEN 1 THEN concat('Sure: {"article_summary": "Note ', CAST(d.doc_id AS STRING),
                               '", "business_impact": " ", "signal_type": "launch"} Done.')
            WHEN 2 THEN '{"article_summary": "", "key_topic": " m&a "}'
            WHEN 3 THEN d.source
            ELSE concat('{"article_summary": "', CAST(d.n_chars AS STRING), ' chars", "geography": "Europe"}') END AS reply
FROM {documents} AS d""",
}

# Page snapshots of the listings and of three of the articles each one links to.
SNAPSHOTS = """
SELECT url, html AS text, 200 AS status_code, 'text/html; charset=UTF-8' AS content_type,
       CAST(doc_id % 8 AS DOUBLE) AS response_time_ms FROM {listings}
UNION ALL
SELECT concat(root, part, n), concat('<html><head><title>Page of ', part, n,
              '</title></head><body><article><p>', safe, '</p></article></body></html>'),
       CASE WHEN doc_id % 11 = 0 THEN 404 ELSE 200 END,
       CASE WHEN doc_id % 13 = 0 THEN 'application/pdf' ELSE 'Text/HTML' END, CAST(doc_id % 16 AS DOUBLE)
FROM (SELECT *, '/news/j' AS part FROM {listings} UNION ALL SELECT *, '/story/k' AS part FROM {listings}
      UNION ALL SELECT *, '/news/c' AS part FROM {listings}) AS l"""

ADAPTERS["snapshots"] = SNAPSHOTS.replace("{listings}", f"({ADAPTERS['listings']}) AS base")

# One robots file per site of the pages, in three variants.
ADAPTERS["robots_files"] = """
SELECT site, length(site) % 3 AS variant,
       CASE length(site) % 3
            WHEN 0 THEN concat('User-agent: *', chr(10), 'Disallow: /en/', chr(10), 'Allow: /en/1', chr(10),
                               'Disallow: /*?page=', chr(10), '# note')
            WHEN 1 THEN concat('User-agent: OtherBot', chr(10), 'User-agent: NewsBot # ours', chr(10), 'Disallow: /fr/*5$',
                               chr(10), 'Allow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
            ELSE concat('Disallow: /', chr(10), 'User-agent: *', chr(10), 'Disallow:', chr(10), 'Crawl-delay: 5', chr(10),
                        'Disallow: /de') END AS text
FROM (SELECT DISTINCT {SITE} AS site FROM {pages}) AS p"""

# What differs between the two SQL dialects.
SPARK = {"TS": "TIMESTAMP_NTZ", "SHA": "sha2", "BITS": ", 256", "ALL": "", "WS": r"\\s+", "SITE": "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"}
DUCKDB = {"TS": "TIMESTAMP", "SHA": "sha256", "BITS": "", "ALL": ", 'g'", "WS": r"\s+", "SITE": "regexp_extract(url, '^[a-z]+://[^/?#]*')"}

_TABLE = re.compile(r"\{(documents|labels|events|customer|pages)\}")


def adapter_sql(name: str, dialect: dict[str, str]) -> str:
    sql = ADAPTERS[name]
    for key, value in dialect.items():
        sql = sql.replace("{" + key + "}", value)
    return sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def adapted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter as a lazy DataFrame over the driver's Parquet files."""
    sql = adapter_sql(name, SPARK)
    # file tables are named by path, so no view is left behind in the session
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m.group(1)}.parquet`", sql))


def adapted_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One adapter over the driver's Parquet files read as a file stream."""

    def stream(table: str) -> DataFrame:
        schema = read(spark, sf_dir, table).schema
        # a pattern, because a file stream takes folders and patterns
        # and a bound on what one micro-batch holds
        return spark.readStream.schema(schema).option("maxBytesPerTrigger", 4 * 1024**3).parquet(f"{sf_dir}/{table}.parque[t]")

    sql = adapter_sql(name, SPARK)
    sources = {table: stream(table) for table in set(_TABLE.findall(sql))}
    return spark.sql(sql, **sources)


def oracle_cte(name: str) -> str:
    """The adapter as a named part of an oracle query's WITH clause."""
    return f"{name} AS ({_TABLE.sub(lambda m: m.group(1), adapter_sql(name, DUCKDB))})"
