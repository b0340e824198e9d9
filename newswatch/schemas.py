"""Schemas of the stored tables (M12). Timestamps are zone-less UTC."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "articles": "id string, company_name string, url string, title string, "
    "published_date timestamp_ntz, s_created_ts timestamp_ntz, industry_sector string",
    # content_hash: of the squashed body, '' without one, NULL where it was not worked out at load
    "article_bodies": "id string, company_name string, url string, article_content string, content_hash string, industry_sector string",
    "load_sources": "company_name string, industry_sector string, source_1 string, source_2 string, "
    "source_3 string, source_4 string, source_5 string, s_created_ts timestamp_ntz, s_modified_ts timestamp_ntz",
    "load_config": "flow_name string, company_name string, load_type string, active_flag string, "
    "industry_sector string, selectors array<string>, s_created_ts timestamp_ntz, s_modified_ts timestamp_ntz",
    "scraping_config": "param_name string, param_value string, description string, "
    "s_created_ts timestamp_ntz, s_modified_ts timestamp_ntz",
    "load_monitoring": "run_id string, run_name string, company_name string, target_schema string, "
    "target_table string, load_type string, run_status string, run_message string, records_inserted bigint, "
    "urls_attempted bigint, urls_fetched bigint, parse_success_count bigint, avg_response_time_ms double, "
    "error_count bigint, run_start_ts timestamp_ntz, run_end_ts timestamp_ntz",
    "article_summary": "article_id string, company_name string, url string, title string, article_summary string, "
    "key_topic string, business_impact string, geography string, signal_type string, content_hash string, "
    "summary_model string, summary_status string, error_message string, summarized_at timestamp_ntz, part string",
    "title_exclusion": "company_name string, id string, title string",
    "company_requests": "request_id string, company_name string, requested_industry_sector string, "
    "source_url string, submitter_username string, submitter_role string, review_status string, "
    "reviewer_username string, review_note string, requested_ts timestamp_ntz, reviewed_ts timestamp_ntz",
    "activity_monitoring": "activity_id string, username string, role string, activity_type string, "
    "activity_path string, activity_meta string, request_id string, client_ip string, created_ts timestamp_ntz",
}

# Tables laid out on disk by sector or piece; the partition column comes last.
PARTITIONED = {"articles": "industry_sector", "article_bodies": "industry_sector", "article_summary": "part"}

# Tables whose rows are replaced by key: the partition column is a piece of the run that added the rows.
PIECEWISE = {"article_summary": ["article_id"]}

RECORD = (
    "company_name string, id string, source_url string, url string, title string, article_content string, "
    "published_date string, s_created_ts string, response_time_ms double, seq bigint"
)
PAGE_SNAPSHOT = "url string, text string, status_code int, content_type string, response_time_ms double"
