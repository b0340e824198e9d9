"""SQL oracle of the source, load, monitoring, activity and request queries."""

from __future__ import annotations

from newswatch.sources.driver_tables import AS_OF, EVENTS_AS_OF, oracle_cte

SECTORS = "('LIFESCIENCE', 'BANKING', 'TELECOMMUNICATION', 'ENERGY', 'DEFENSE', 'AIR', 'SPACE', 'TRANSPORT')"
SLUG = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def with_tables(names: str, body: str, *more: str) -> str:
    return "WITH " + ",\n".join([*(oracle_cte(n) for n in names.split()), *more]) + "\n" + body


CONFIG = """config AS (SELECT trim(company_name) AS company_name, coalesce(nullif(upper(trim(load_type)), ''), 'FULL') AS load_type,
       coalesce(nullif(upper(trim(industry_sector)), ''), 'LIFESCIENCE') AS industry_sector
FROM load_config WHERE flow_name = 'NEWS_FLOW' AND upper(active_flag) = 'Y')"""
VALID = """valid AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn
  FROM (SELECT * REPLACE (trim(coalesce(url, '')) AS url, trim(coalesce(title, '')) AS title) FROM records)
  WHERE regexp_matches(url, '^https?://') AND length(title) >= 10) WHERE rn = 1)"""
LOADABLE = """loadable AS (SELECT v.*, coalesce(c.load_type, 'FULL') AS load_type,
       coalesce(c.industry_sector, 'LIFESCIENCE') AS industry_sector
FROM valid AS v LEFT JOIN config AS c ON c.company_name = v.company_name)"""
CUTOFFS = """cutoffs AS (SELECT company_name, max(run_end_ts) AS last_success FROM monitoring
WHERE run_name = 'NEWS_FLOW' AND run_status = 'SUCCESS' GROUP BY company_name)"""
DUE = """due AS (SELECT l.* REPLACE (try_cast(substr(replace(l.published_date, 'T', ' '), 1, 19) AS TIMESTAMP) AS published_date)
FROM loadable AS l LEFT JOIN cutoffs AS k ON k.company_name = l.company_name
WHERE l.load_type <> 'DELTA' OR k.last_success IS NULL
   OR try_cast(substr(replace(l.published_date, 'T', ' '), 1, 19) AS TIMESTAMP) IS NULL
   OR try_cast(substr(replace(l.published_date, 'T', ' '), 1, 19) AS TIMESTAMP) > k.last_success)"""
FRESH = """fresh AS (SELECT * FROM due WHERE NOT EXISTS (SELECT 1 FROM loadable AS s WHERE s.published_date LIKE '2023%'
  AND s.industry_sector = due.industry_sector AND s.company_name = due.company_name AND s.url = due.url))"""
LOAD = (CONFIG, VALID, LOADABLE, CUTOFFS, DUE, FRESH)
LOAD_TABLES = "records load_config monitoring fetch_log"
RECORD = "company_name, id, url, title, published_date, load_type, industry_sector"
FETCHED = """count(*) FILTER (WHERE response_time_ms IS NOT NULL) AS urls_attempted,
       count(*) FILTER (WHERE fetched) AS urls_fetched, count(*) FILTER (WHERE parsed) AS parse_success_count,
       count(*) FILTER (WHERE NOT fetched) AS error_count, coalesce(avg(response_time_ms), 0.0) AS avg_response_time_ms"""
LOG = f"logged AS (SELECT company_name, {FETCHED} FROM fetch_log GROUP BY company_name)"
METRICS = """measured AS (SELECT g.company_name, coalesce(r.n, 0) AS urls_attempted, coalesce(r.n, 0) AS urls_fetched,
       coalesce(r.n, 0) AS parse_success_count,
       CASE WHEN coalesce(r.mean, 0) <> 0 THEN r.mean ELSE g.avg_response_time_ms END AS avg_response_time_ms,
       g.error_count, coalesce(r.urls, 0) AS unique_urls
FROM logged AS g LEFT JOIN (SELECT company_name, count(*) AS n, count(DISTINCT url) AS urls, avg(response_time_ms) AS mean
  FROM due GROUP BY company_name) AS r ON r.company_name = g.company_name)"""


def _sources() -> dict[str, str]:
    defaults = {
        "MAX_ITEMS_PER_SOURCE": "25", "MAX_WORKERS": "8", "LISTING_SLEEP_SEC": "0.2", "ARTICLE_SLEEP_SEC": "0.15",
        "REQUEST_TIMEOUT_SEC": "25", "MIN_TITLE_LENGTH": "10", "EXPORT_RESULTS": "true",
    }
    values = ", ".join(f"('{k}', '{v}')" for k, v in defaults.items())

    def setting(name: str) -> str:
        return f"coalesce(max(param_value) FILTER (WHERE param_name = '{name}'), '{defaults[name]}')"

    typed = [
        *[
            f"CAST({setting(n)} AS INT) AS {n}"
            for n in ("MAX_ITEMS_PER_SOURCE", "MAX_WORKERS", "REQUEST_TIMEOUT_SEC", "MIN_TITLE_LENGTH")
        ],
        *[f"CAST({setting(n)} AS DOUBLE) AS {n}" for n in ("LISTING_SLEEP_SEC", "ARTICLE_SLEEP_SEC")],
        f"lower(trim({setting('EXPORT_RESULTS')})) IN ('true', '1', 'yes', 'on') AS EXPORT_RESULTS",
    ]
    title_slug = SLUG.format(c="title")
    return {
        "source_unpivot": with_tables(
            "load_sources",
            """SELECT DISTINCT company_name, coalesce(nullif(upper(trim(industry_sector)), ''), 'LIFESCIENCE') AS industry_sector,
       url FROM (SELECT company_name, industry_sector,
                 trim(unnest([source_1, source_2, source_3, source_4, source_5])) AS url FROM load_sources)
WHERE regexp_matches(url, '^https?://')""",
        ),
        "load_config_active": with_tables("load_config", "SELECT * FROM config", CONFIG),
        "settings": with_tables("scraping_config", f"SELECT {', '.join(typed)} FROM scraping_config"),
        "setting_rows": with_tables(
            "scraping_config",
            f"""SELECT * FROM scraping_config UNION ALL SELECT * FROM (VALUES {values}) AS d(param_name, param_value)
WHERE param_name NOT IN (SELECT param_name FROM scraping_config)""",
        ),
        "sector_backfill": with_tables(
            "load_config",
            """SELECT * REPLACE (CASE WHEN industry_sector IS NULL OR trim(industry_sector) = '' THEN 'LIFESCIENCE'
ELSE industry_sector END AS industry_sector) FROM load_config""",
        ),
        "flow_rename": with_tables(
            "load_config",
            """SELECT * REPLACE (CASE WHEN flow_name = 'OLD_FLOW' AND NOT EXISTS (SELECT 1 FROM both_flows AS x
  WHERE x.flow_name = 'NEWS_FLOW' AND x.company_name = b.company_name) THEN 'NEWS_FLOW' ELSE flow_name END AS flow_name)
FROM both_flows AS b""",
            """both_flows AS (SELECT * REPLACE ('OLD_FLOW' AS flow_name) FROM load_config
UNION ALL SELECT * FROM load_config WHERE active_flag = 'Y')""",
        ),
        "run_rename": with_tables(
            "monitoring",
            "SELECT 'NEXT_FLOW' AS run_name, company_name, count(*) AS runs FROM monitoring GROUP BY company_name",
        ),
        "config_to_delta": with_tables(
            "load_config monitoring",
            """SELECT * REPLACE (CASE WHEN upper(trim(load_type)) = 'FULL' AND company_name IN
  (SELECT company_name FROM monitoring WHERE load_type = 'FULL') THEN 'DELTA' ELSE upper(trim(load_type)) END AS load_type)
FROM load_config""",
        ),
        "staging_labels": with_tables(
            "listing",
            """SELECT schemaname, tablename,
       upper(replace(regexp_replace(tablename, '^stg_', '', 'i'), '_', ' ')) AS company_name,
       upper(replace(regexp_replace(schemaname, '^stg_', '', 'i'), '_', ' ')) AS industry_sector
FROM listing WHERE schemaname ILIKE 'stg%' AND tablename ILIKE 'stg%'""",
        ),
        "identifiers": with_tables(
            "articles", f"SELECT id, {title_slug} AS slug, upper(replace({title_slug}, '_', ' ')) AS label FROM articles"
        ),
        "staging_union": with_tables(
            "articles",
            """SELECT company_name, industry_sector, concat('stg_', lower(industry_sector)) AS schemaname,
       concat('stg_', lower(company_name)) AS tablename, id, url, title, published_date, s_created_ts FROM articles""",
        ),
        "staging_layout": with_tables(
            "articles",
            """SELECT company_name, industry_sector, concat('stg_', lower(industry_sector)) AS schemaname,
       concat('stg_', lower(company_name)) AS tablename, id, url, title, published_date, s_created_ts FROM articles""",
        ),
        "staging_dedup": with_tables(
            "staged",
            """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
  (PARTITION BY id ORDER BY schemaname, tablename, url) AS rn FROM staged) WHERE rn = 1""",
        ),
        "eligible_articles": with_tables(
            "staged exclusions",
            """SELECT id, url, tablename FROM (SELECT *, row_number() OVER
  (PARTITION BY id ORDER BY schemaname, tablename, url) AS rn FROM staged)
WHERE rn = 1 AND (id IS NULL OR id NOT IN (SELECT id FROM exclusions WHERE id IS NOT NULL))""",
        ),
        "legacy_merge": with_tables(
            "staged articles",
            """SELECT 'LIFESCIENCE' AS industry_sector, company, url, id, title FROM (
  SELECT upper(replace(substr(schemaname, 8), '_', ' ')) AS company, *,
         row_number() OVER (PARTITION BY schemaname, url ORDER BY seq) AS rn
  FROM staged WHERE schemaname LIKE 'stg\\_ls\\_%' ESCAPE '\\') AS s
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM articles AS a WHERE a.industry_sector = 'LIFESCIENCE'
  AND a.company_name = s.company AND a.url = s.url)""".replace("company, url,", "company AS company_name, url,"),
        ),
    }


def _loads() -> dict[str, str]:
    return {
        "validate": with_tables("records", "SELECT * EXCLUDE (article_content) FROM valid", VALID),
        "validation_metrics": with_tables(
            "records fetch_log",
            f"""SELECT urls_attempted, urls_fetched, titles AS parse_success_count, avg_response_time_ms, error_count,
       unique_urls FROM (SELECT {FETCHED}, (SELECT count(*) FROM valid) AS titles,
                         (SELECT count(DISTINCT url) FROM valid) AS unique_urls FROM fetch_log)""",
            VALID,
        ),
        "delta_filter": with_tables(LOAD_TABLES, f"SELECT {RECORD} FROM due", *LOAD),
        "merge_new": with_tables(LOAD_TABLES, f"SELECT {RECORD} FROM fresh", *LOAD),
        "fetch_metrics": with_tables("fetch_log", "SELECT * FROM logged", LOG),
        "fetch_metrics_overall": with_tables("fetch_log", f"SELECT {FETCHED} FROM fetch_log"),
        "monitoring_metrics": with_tables(LOAD_TABLES, "SELECT * FROM measured", *LOAD, LOG, METRICS),
        "load_run": with_tables(
            LOAD_TABLES,
            f"""SELECT 'run-1' AS run_id, 'NEWS_FLOW' AS run_name, m.company_name,
       concat('stg_', lower(coalesce(c.industry_sector, 'LIFESCIENCE'))) AS target_schema,
       concat('stg_', lower(m.company_name)) AS target_table, coalesce(c.load_type, 'FULL') AS load_type,
       CASE WHEN m.urls_attempted = 0 AND m.error_count > 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS run_status,
       CASE WHEN m.urls_attempted = 0 AND m.error_count > 0
            THEN 'Source scrape failed before any valid records were parsed' ELSE 'Data loaded successfully' END AS run_message,
       coalesce(i.n, 0) AS records_inserted, m.urls_attempted, m.urls_fetched, m.parse_success_count,
       m.avg_response_time_ms, m.error_count, TIMESTAMP '{EVENTS_AS_OF}' AS run_start_ts, TIMESTAMP '{EVENTS_AS_OF}' AS run_end_ts
FROM measured AS m LEFT JOIN config AS c ON c.company_name = m.company_name
LEFT JOIN (SELECT company_name, count(*) AS n FROM fresh GROUP BY company_name) AS i ON i.company_name = m.company_name""",
            *LOAD,
            LOG,
            METRICS,
        ),
        "load_run_write_errors": with_tables(
            LOAD_TABLES,
            f"""SELECT 'run-1' AS run_id, 'NEWS_FLOW' AS run_name, m.company_name,
       concat('stg_', lower(coalesce(c.industry_sector, 'LIFESCIENCE'))) AS target_schema,
       concat('stg_', lower(m.company_name)) AS target_table, coalesce(c.load_type, 'FULL') AS load_type,
       CASE WHEN m.urls_attempted = 0 AND m.error_count > 0 OR length(m.company_name) % 5 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END AS run_status,
       CASE WHEN m.urls_attempted = 0 AND m.error_count > 0
            THEN 'Source scrape failed before any valid records were parsed'
            WHEN length(m.company_name) % 5 = 0 THEN 'cannot store ' || m.company_name ELSE 'Data loaded successfully' END AS run_message,
       CASE WHEN length(m.company_name) % 5 = 0 THEN 0 ELSE coalesce(i.n, 0) END AS records_inserted, m.urls_attempted, m.urls_fetched, m.parse_success_count,
       m.avg_response_time_ms, m.error_count, TIMESTAMP '{EVENTS_AS_OF}' AS run_start_ts, TIMESTAMP '{EVENTS_AS_OF}' AS run_end_ts
FROM measured AS m LEFT JOIN config AS c ON c.company_name = m.company_name
LEFT JOIN (SELECT company_name, count(*) AS n FROM fresh GROUP BY company_name) AS i ON i.company_name = m.company_name""",
            *LOAD,
            LOG,
            METRICS,
        ),
        "source_seed": with_tables(
            "load_sources",
            """SELECT trim(company_name) AS company_name,
       coalesce(nullif(upper(trim(industry_sector)), ''), 'LIFESCIENCE') AS industry_sector, nullif(trim(source_1), '') AS source_1,
       nullif(trim(source_2), '') AS source_2, nullif(trim(source_3), '') AS source_3, nullif(trim(source_4), '') AS source_4,
       nullif(trim(source_5), '') AS source_5 FROM load_sources WHERE trim(company_name) <> ''""",
        ),
        "config_seed": with_tables(
            "load_config",
            """SELECT trim(flow_name) AS flow_name, trim(company_name) AS company_name, nullif(trim(load_type), '') AS load_type,
       nullif(trim(active_flag), '') AS active_flag,
       coalesce(nullif(upper(trim(industry_sector)), ''), 'LIFESCIENCE') AS industry_sector FROM load_config""",
        ),
        "settings_seed": with_tables(
            "scraping_config",
            """SELECT param_name, param_value, CASE param_name WHEN 'MAX_ITEMS_PER_SOURCE' THEN 'Maximum articles to fetch per source'
       WHEN 'MIN_TITLE_LENGTH' THEN 'Minimum accepted article title length'
       WHEN 'EXPORT_RESULTS' THEN 'Whether to export the latest validated CSV' END AS description FROM scraping_config""",
        ),
        "exclusion_file": with_tables("exclusions", "SELECT company_name, id, title FROM exclusions"),
        "export_csv": with_tables(
            "records", "SELECT company_name, id, url, title, length(article_content) AS body_chars FROM valid", VALID
        ),
        "activity_bad_parameters": with_tables(
            "activity",
            f"""SELECT activity_id, username FROM activity
WHERE created_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY""",
        ),
        "report_ordered": with_tables(
            "monitoring",
            """SELECT company_name, run_end_ts, CAST(row_number() OVER (ORDER BY run_end_ts DESC, company_name) AS INT) AS place
FROM daily""",
            DAY,
        ),
        "summary_upsert": with_tables(
            "articles summaries",
            """SELECT article_id, article_summary, summary_status FROM summaries WHERE article_id NOT IN (SELECT id FROM articles)
UNION ALL SELECT id, concat('version 2 of ', title), 'ai' FROM articles""",
        ),
        "source_upsert": with_tables(
            "articles load_sources",
            f"""SELECT coalesce(c.company_name, s.company_name) AS company_name, s.industry_sector,
       coalesce(c.url, s.source_1) AS source_1, s.source_2, s.source_3, s.source_4, s.source_5,
       CASE WHEN s.company_name IS NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2024-01-01' END AS s_created_ts,
       CASE WHEN c.company_name IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '{AS_OF}' END AS s_modified_ts
FROM load_sources AS s FULL JOIN (SELECT company_name, max(url) AS url FROM articles GROUP BY 1 UNION ALL
  SELECT concat(company_name, ' ', industry_sector), min(url) FROM articles GROUP BY 1) AS c
  ON c.company_name = s.company_name""",
        ),
        "purge_bodies": with_tables(
            "articles summaries",
            """SELECT id, CASE WHEN s.article_id IS NULL THEN sha256(article_content) END AS body_hash
FROM articles AS a LEFT JOIN summaries AS s ON s.article_id = a.id AND coalesce(s.article_summary, '') <> ''""",
        ),
        "purge_counts": with_tables(
            "articles summaries",
            """SELECT industry_sector, count(*) AS purged FROM articles AS a WHERE article_content IS NOT NULL
AND EXISTS (SELECT 1 FROM summaries AS s WHERE s.article_id = a.id AND coalesce(s.article_summary, '') <> '')
GROUP BY industry_sector""",
        ),
    }


DAY = """daily AS (SELECT * FROM monitoring WHERE run_end_ts
  BETWEEN timezone('UTC', timezone('Europe/Paris', TIMESTAMP '2024-01-15 00:00:00'))
      AND timezone('UTC', timezone('Europe/Paris', TIMESTAMP '2024-01-15 23:59:59.999999')))"""


def _monitoring() -> dict[str, str]:
    return {
        "last_success": with_tables("monitoring", "SELECT * FROM cutoffs", CUTOFFS),
        "report_window": with_tables("monitoring", "SELECT * FROM daily", DAY),
        "report_totals": with_tables(
            "monitoring",
            """SELECT count(*) AS row_count, CAST(coalesce(sum(records_inserted), 0) AS BIGINT) AS total_inserted,
       CAST(coalesce(sum(error_count), 0) AS BIGINT) AS total_errors,
       count(*) FILTER (WHERE run_status = 'SUCCESS') AS successful_rows,
       count(*) FILTER (WHERE run_status <> 'SUCCESS') AS failed_rows, count(DISTINCT run_id) AS run_count FROM daily""",
            DAY,
        ),
        "report_runs": with_tables(
            "monitoring",
            """SELECT run_id, CASE WHEN bool_and(run_status = 'SUCCESS') THEN 'SUCCESS' ELSE 'FAILED' END AS run_status,
       count(*) AS companies, CAST(sum(records_inserted) AS BIGINT) AS records_inserted FROM monitoring GROUP BY run_id""",
        ),
        "report_run_companies": with_tables(
            "monitoring",
            """SELECT run_id, company_name, run_status, load_type, records_inserted, urls_attempted, urls_fetched,
       parse_success_count, error_count,
       CASE WHEN error_count <> 0 THEN 'background: #fee2e2; color: #7f1d1d;'
            WHEN records_inserted <> 0 THEN 'background: #dcfce7; color: #14532d;' ELSE '' END AS row_style FROM daily""",
            DAY,
        ),
        "latest_run": with_tables(
            "monitoring",
            """SELECT run_id, run_name, company_name, run_status, records_inserted, run_end_ts FROM monitoring
ORDER BY run_end_ts DESC, company_name LIMIT 1""",
        ),
        "recent_runs": with_tables(
            "monitoring",
            """SELECT run_id, max(run_end_ts) AS run_end_ts FROM monitoring GROUP BY run_id
ORDER BY max(run_end_ts) DESC, run_id LIMIT 5""",
        ),
    }


def _activity() -> dict[str, str]:
    def since(days: int) -> str:
        return f"created_ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL {days} DAY"

    def summary(where: str) -> str:
        return f"""SELECT username, role, count(*) FILTER (WHERE activity_type = 'login') AS login_count,
       count(*) FILTER (WHERE activity_type = 'news_filter') AS news_filter_count,
       count(*) FILTER (WHERE activity_type = 'ai_chat') AS ai_chat_count, max(created_ts) AS last_activity_ts
FROM activity WHERE {where} GROUP BY username, role"""

    return {
        "activity_summary": with_tables("activity", summary(since(7))),
        "activity_of_user": with_tables(
            "activity", summary(f"{since(30)} AND username = 'user7' AND activity_type = 'ai_chat'")
        ),
        "recent_activity": with_tables(
            "activity",
            f"""SELECT username, role, activity_type, activity_path, activity_meta, created_ts FROM activity
WHERE {since(7)} ORDER BY created_ts DESC, activity_id LIMIT 50""",
        ),
        "active_accounts": with_tables("activity", f"SELECT DISTINCT username FROM activity WHERE {since(7)}"),
        "activity_meta": with_tables(
            "activity",
            """SELECT activity_id, activity_type, json_extract_string(activity_meta, '$.k') AS k,
       json_extract_string(activity_meta, '$.period') AS period FROM activity""",
        ),
        "activity_append": with_tables(
            "activity",
            """SELECT username, role, activity_type, activity_path,
       concat('{"period":"week","topic":"', activity_type, '"}') AS activity_meta, client_ip, created_ts
FROM activity WHERE role <> 'guest'""",
        ),
        "rate_audit": with_tables(
            "activity",
            """SELECT activity_id, scope, client_ip, created_ts, attempts,
       attempts > CASE scope WHEN 'chat' THEN 1 ELSE 3 END AS over_limit
FROM (SELECT *, count(*) OVER (PARTITION BY scope, client_ip ORDER BY created_ts
        RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW) AS attempts
      FROM (SELECT *, CASE activity_type WHEN 'ai_chat' THEN 'chat' ELSE 'public' END AS scope FROM activity))""",
        ),
    }


CHECKED = f"""checked AS (SELECT *, CASE WHEN company_name = '' THEN 'Company name is required'
       WHEN length(company_name) > 100 THEN 'Company name is too long'
       WHEN NOT regexp_matches(source_url, '^https?://') THEN 'Source URL must start with http:// or https://'
       WHEN known_sector IS NULL THEN 'Invalid industry sector' END AS reject_reason
FROM (SELECT * REPLACE (upper(trim(regexp_replace(company_name, '\\s+', ' ', 'g'))) AS company_name,
                        trim(source_url) AS source_url),
      CASE WHEN upper(trim(industry_sector)) IN {SECTORS} THEN upper(trim(industry_sector)) END AS known_sector FROM requests))"""
STORED = """stored AS (SELECT request_id, company_name, known_sector AS requested_industry_sector, source_url,
       submitter_username, review_status, CAST(NULL AS VARCHAR) AS reviewer_username, CAST(NULL AS VARCHAR) AS review_note,
       requested_ts, CAST(NULL AS TIMESTAMP) AS reviewed_ts FROM checked WHERE reject_reason IS NULL)"""
DECIDED = f"""decided AS (SELECT d.request_id AS decided_id, approved, note, sector, s.*,
       CASE WHEN s.request_id IS NULL THEN 'Request not found'
            WHEN review_status <> 'PENDING' THEN 'Request has already been reviewed'
            WHEN sector IS NULL THEN 'Invalid industry sector' END AS reject_reason
FROM (SELECT r.request_id, n % 2 = 0 AS approved, CASE WHEN n % 3 <> 0 THEN 'checked' END AS note,
             CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 1 THEN 'AIR' ELSE st.requested_industry_sector END AS sector
      FROM (SELECT request_id, CAST(substr(request_id, 4) AS BIGINT) AS n FROM requests) AS r
      LEFT JOIN stored AS st ON st.request_id = r.request_id) AS d
LEFT JOIN stored AS s ON s.request_id = d.request_id)"""
PLACED = """approved AS (SELECT request_id, company_name, known_sector AS sector, source_url,
       CAST(substr(request_id, 4) AS BIGINT) AS position FROM checked
  WHERE reject_reason IS NULL AND review_status = 'APPROVED'),
existing AS (SELECT company_name, trim(url) AS url, row_number() OVER (PARTITION BY company_name ORDER BY i) - 1 AS slot
  FROM (SELECT company_name, unnest([source_1, source_2, source_3, source_4, source_5]) AS url, unnest([1, 2, 3, 4, 5]) AS i
        FROM load_sources) WHERE coalesce(url, '') <> ''),
placed AS (SELECT w.company_name, url, coalesce(used, 0) - 1 + row_number() OVER
    (PARTITION BY w.company_name ORDER BY first) AS slot
  FROM (SELECT company_name, source_url AS url, min(position) AS first FROM approved GROUP BY 1, 2) AS w
  LEFT JOIN (SELECT company_name, count(*) AS used FROM existing GROUP BY 1) AS u ON u.company_name = w.company_name
  WHERE NOT EXISTS (SELECT 1 FROM existing AS e WHERE e.company_name = w.company_name AND e.url = w.url)),
slots AS (SELECT company_name, url, slot FROM existing UNION ALL SELECT company_name, url, slot FROM placed WHERE slot < 5),
marked AS (SELECT a.*, EXISTS (SELECT 1 FROM slots AS s WHERE s.company_name = a.company_name AND s.url = a.source_url) AS ok
  FROM approved AS a),
touched AS (SELECT company_name, arg_max(sector, position) AS industry_sector FROM marked WHERE ok GROUP BY company_name)"""


def _requests() -> dict[str, str]:
    slot = [f"max(url) FILTER (WHERE slot = {i}) AS source_{i + 1}" for i in range(5)]
    pick = [f"CASE WHEN t.company_name IS NULL THEN l.source_{i} ELSE p.source_{i} END AS source_{i}" for i in range(1, 6)]
    tables = "requests load_sources load_config"
    return {
        "request_valid": with_tables("requests", "SELECT * EXCLUDE (industry_sector) FROM checked", CHECKED),
        "request_submit": with_tables(
            "requests",
            f"""SELECT company_name, known_sector AS requested_industry_sector, source_url, submitter_username,
       submitter_role, 'PENDING' AS review_status, CAST(NULL AS VARCHAR) AS reviewer_username,
       CAST(NULL AS VARCHAR) AS review_note, TIMESTAMP '{AS_OF}' AS requested_ts, CAST(NULL AS TIMESTAMP) AS reviewed_ts
FROM checked WHERE reject_reason IS NULL""",
            CHECKED,
        ),
        "request_list": with_tables(
            "requests", "SELECT * FROM stored WHERE submitter_username = 'user7'", CHECKED, STORED
        ),
        "request_review": with_tables(
            "requests",
            f"""SELECT s.* REPLACE (CASE WHEN d.decided_id IS NULL THEN s.review_status WHEN d.approved THEN 'APPROVED'
         ELSE 'REJECTED' END AS review_status,
       CASE WHEN d.decided_id IS NULL THEN s.requested_industry_sector ELSE d.sector END AS requested_industry_sector,
       CASE WHEN d.decided_id IS NOT NULL THEN 'boss' END AS reviewer_username, d.note AS review_note,
       CASE WHEN d.decided_id IS NOT NULL THEN TIMESTAMP '{AS_OF}' END AS reviewed_ts)
FROM stored AS s LEFT JOIN (SELECT * FROM decided WHERE reject_reason IS NULL) AS d ON d.decided_id = s.request_id""",
            CHECKED,
            STORED,
            DECIDED,
        ),
        "request_refused": with_tables(
            "requests",
            "SELECT decided_id AS request_id, reject_reason FROM decided WHERE reject_reason IS NOT NULL",
            CHECKED,
            STORED,
            DECIDED,
        ),
        "request_apply": with_tables(
            tables,
            f"""SELECT coalesce(l.company_name, t.company_name) AS company_name,
       coalesce(t.industry_sector, l.industry_sector) AS industry_sector, {", ".join(pick)}
FROM load_sources AS l FULL JOIN touched AS t ON t.company_name = l.company_name
LEFT JOIN (SELECT company_name, {", ".join(slot)} FROM slots GROUP BY company_name) AS p
  ON p.company_name = t.company_name""",
            CHECKED,
            PLACED,
        ),
        "request_apply_config": with_tables(
            tables,
            """SELECT 'NEWS_FLOW' AS flow_name, coalesce(l.company_name, t.company_name) AS company_name,
       CASE WHEN t.company_name IS NULL THEN l.load_type ELSE coalesce(nullif(trim(l.load_type), ''), 'FULL') END AS load_type,
       CASE WHEN t.company_name IS NULL THEN l.active_flag ELSE 'Y' END AS active_flag,
       coalesce(t.industry_sector, l.industry_sector) AS industry_sector
FROM load_config AS l FULL JOIN touched AS t ON t.company_name = l.company_name""",
            CHECKED,
            PLACED,
        ),
        "request_overflow": with_tables(
            tables,
            """SELECT request_id, 'Company already has five configured sources' AS reject_reason FROM marked WHERE NOT ok""",
            CHECKED,
            PLACED,
        ),
    }


def oracle() -> dict[str, str]:
    return {**_sources(), **_loads(), **_monitoring(), **_activity(), **_requests()}
