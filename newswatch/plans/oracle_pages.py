"""SQL oracle of the page queries."""

from __future__ import annotations

from newswatch.plans.oracle_load import CUTOFFS, with_tables

SITE = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


def decoded(text: str) -> str:
    # an entity cut off before its semicolon counts too, when nothing that could belong to its name follows
    for name, char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")]:
        text = rf"regexp_replace({text}, '&{name}(?:;|([^-.a-zA-Z0-9&;])|$)', '{char}\1', 'g')"
    return text


def plain(source: str) -> str:
    """Text of page source: tags out, entities decoded, white space squashed."""
    stripped = rf"regexp_replace({source}, '</?[a-zA-Z][^>]*>', ' ', 'gs')"
    return rf"trim(regexp_replace({decoded(stripped)}, '\s+', ' ', 'g'))"


_DROP = "|".join(rf"<{t}(?:\s[^>]*)?>.*?</{t}>" for t in ["script", "style", "nav", "header", "footer", "aside"])
# A paragraph is closed when the next paragraph tag is an end tag; else it runs to the end of the article.
PAGE_TEXT = rf"""stripped AS (SELECT page_id, regexp_replace(html, '<!--.*?-->|{_DROP}', ' ', 'gis') AS body FROM pages),
parts AS (SELECT page_id, regexp_extract(body, '<article>(.*?)</article>', 1, 's') AS article FROM stripped),
whole AS (SELECT *, {plain("article")} AS text, string_split(article, '<p>') AS ps FROM parts),
paragraphs AS (SELECT page_id, string_agg(paragraph, ' ' ORDER BY i) AS text FROM (
    SELECT page_id, i, array_to_string(list_transform(string_split_regex(
             CASE WHEN contains(ps[i], '</p>') THEN string_split(ps[i], '</p>')[1] ELSE array_to_string(ps[i:], '') END,
             '<[^>]*>'), lambda s: trim(regexp_replace({decoded("s")}, '^\s+|\s+$', '', 'g'))), '') AS paragraph
    FROM (SELECT page_id, ps, unnest(range(2, len(ps) + 1)) AS i FROM whole WHERE length(text) < 100))
  WHERE paragraph <> '' GROUP BY page_id)"""

ANCHORS = """anchors AS (SELECT url, CAST(i - 1 AS BIGINT) AS pos, hrefs[i] AS href, trim(texts[i]) AS text
  FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS hrefs,
               regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS texts,
               unnest(range(1, len(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) + 1)) AS i FROM pages))"""

# what each listing page links to, in order, by kind of site
LINKS = """found AS (SELECT url AS page_url, 1 AS n, concat(root, '/2024-05-01-Viatris-', n) AS url FROM listings WHERE kind = 0
UNION ALL SELECT url, 1, concat(root, '/press-release/d', n) FROM listings WHERE kind = 1
UNION ALL SELECT url, i, concat(root, ['/news/c', '/news/a', '/about/', '/2024-05-01-Viatris-', '/press-release/d', '/article/b'][i], n)
  FROM (SELECT *, unnest([1, 2, 3, 4, 5, 6]) AS i FROM listings WHERE kind > 1))"""
# embedded items first, then at most three links; items known to be old are passed over; three are taken
CHOSEN = """chosen AS (SELECT company_name, source_url, url, title, row_number() OVER (PARTITION BY source_url ORDER BY place) AS n,
       item_day, last_success, root, part, doc_id
  FROM (SELECT l.company_name, l.url AS source_url, concat(root, part, l.n) AS url, title, place, part, root, doc_id,
               item_day, last_success
    FROM (SELECT *, '/news/j' AS part, concat('Item ', n) AS title, 0 AS place FROM listings
          UNION ALL SELECT *, '/story/k', 'Story', 1 FROM listings
          UNION ALL SELECT l.*, substr(f.url, length(root) + 1, length(f.url) - length(root) - length(l.n)), NULL, 1 + f.n
            FROM listings AS l JOIN found AS f ON f.page_url = l.url WHERE f.n <= 3) AS l
    LEFT JOIN cutoffs AS k ON k.company_name = l.company_name
    WHERE place > 0 OR last_success IS NULL OR item_day + INTERVAL 10 HOUR > last_success)
  QUALIFY n <= 3)"""
DAY_IN_TEXT = r"regexp_extract(s.text, '\b20\d{2}-\d{2}-\d{2}\b')"
VISITS = rf"""visits AS (SELECT c.*, s.text AS html, s.status_code, s.response_time_ms AS ms,
       s.status_code IS NOT NULL AS attempted,
       coalesce(s.status_code < 400 AND lower(s.content_type) LIKE '%text/html%', false) AS fetched,
       CASE WHEN c.part = '/news/j' THEN c.item_day + INTERVAL 10 HOUR
            ELSE try_cast({DAY_IN_TEXT} AS TIMESTAMP) END AS published
  FROM chosen AS c LEFT JOIN snapshots AS s ON s.url = c.url)"""


def oracle() -> dict[str, str]:
    crawl = (CUTOFFS, LINKS, CHOSEN, VISITS)
    tables = "listings snapshots monitoring"
    body = plain("regexp_extract(html, '<article>(.*)</article>', 1, 's')")
    return {
        "page_title": f"""SELECT page_id, trim({decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")}) AS title FROM pages""",
        "page_text": f"""WITH {PAGE_TEXT}
SELECT w.page_id, CASE WHEN length(t) > 50 THEN t END AS page_text FROM (
  SELECT w.page_id, substr(CASE WHEN length(w.text) >= 100 THEN w.text
       ELSE trim(regexp_replace(p.text, '\\s+', ' ', 'g')) END, 1, 50000) AS t
  FROM whole AS w LEFT JOIN paragraphs AS p ON p.page_id = w.page_id) AS w""",
        "page_anchors": f"WITH {ANCHORS} SELECT *, CAST(NULL AS BIGINT) AS container FROM anchors",
        "page_links": f"WITH {ANCHORS} SELECT url AS page_url, pos, concat({SITE}, href) AS url FROM anchors",
        "page_dates": with_tables(
            "listings",
            r"""SELECT url, concat('Listing & more ', n) AS page_title,
       CASE doc_id % 5 WHEN 0 THEN TIMESTAMP '2024-05-01 08:00:00' WHEN 1 THEN TIMESTAMP '2024-05-02 00:00:00'
            WHEN 2 THEN TIMESTAMP '2024-05-03 08:00:00'
            ELSE CAST(item_day AS TIMESTAMP) + INTERVAL 10 HOUR END AS page_date FROM listings""",
        ),
        "jsonld_items": with_tables(
            "listings",
            """SELECT url AS page_url, concat(root, '/news/j', n) AS url, concat('Item ', n) AS title,
       CAST(item_day AS TIMESTAMP) + INTERVAL 10 HOUR AS published_date FROM listings
UNION ALL SELECT url, concat(root, '/story/k', n), 'Story', NULL FROM listings""",
        ),
        "listing_links": with_tables("listings", "SELECT * FROM found", LINKS),
        "extra_listing_pages": with_tables(
            "listings",
            """SELECT url AS page_url, 1 AS n, concat(url, CASE kind WHEN 0 THEN '?o=20' ELSE concat('?cat=', n) END) AS url
FROM listings WHERE kind < 2""",
        ),
        "crawl_candidates": with_tables(
            tables, "SELECT company_name, source_url, CAST(n AS INT) AS n, url, title FROM chosen", CUTOFFS, LINKS, CHOSEN
        ),
        "crawl_records": with_tables(
            tables,
            f"""SELECT company_name, sha256(concat(company_name, '|', url)) AS id, source_url, url,
       coalesce(title, regexp_extract(html, '<title>(.*?)</title>', 1)) AS title,
       CASE WHEN length({body}) > 50 THEN sha256(substr({body}, 1, 50000)) END AS content_hash,
       strftime(published, '%Y-%m-%dT%H:%M:%S+00:00') AS published_date, '2024-02-20T00:00:00+00:00' AS s_created_ts,
       ms AS response_time_ms
FROM visits WHERE fetched AND (last_success IS NULL OR published IS NULL OR published > last_success)""",
            *crawl,
        ),
        "crawl_metrics": with_tables(
            tables,
            """SELECT company_name, count(*) FILTER (WHERE attempted) AS urls_attempted,
       count(*) FILTER (WHERE fetched) AS urls_fetched, count(*) FILTER (WHERE fetched) AS parse_success_count,
       count(*) FILTER (WHERE NOT fetched) AS error_count, coalesce(avg(ms), 0.0) AS avg_response_time_ms
FROM visits GROUP BY company_name""",
            *crawl,
        ),
        "usable_pages": with_tables(
            "snapshots",
            """SELECT url, status_code < 400 AND lower(content_type) LIKE '%text/html%' AS fetched, response_time_ms
FROM snapshots""",
        ),
        "robots_groups": with_tables(
            "robots_files",
            r"""SELECT site, pos, field, value, CAST(sum(starts) OVER (PARTITION BY site ORDER BY pos) AS BIGINT) AS "group" FROM (
  SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY site ORDER BY pos), '') <> 'user-agent'
                 THEN 1 ELSE 0 END AS starts
  FROM (SELECT site, pos, lower(trim(string_split(line, ':')[1])) AS field, trim(string_split(line, ':')[2]) AS value
        FROM (SELECT site, i - 1 AS pos, trim(string_split(string_split(text, chr(10))[i], '#')[1]) AS line
              FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM robots_files))
        WHERE contains(line, ':'))
  WHERE field IN ('user-agent', 'allow', 'disallow'))""",
        ),
        "robots_decision": with_tables(
            "robots_files",
            rf"""SELECT page_id, url, CASE variant
       WHEN 0 THEN NOT regexp_matches(target, '^/.*\?page=') AND (regexp_matches(target, '^/en/1') OR NOT regexp_matches(target, '^/en/'))
       WHEN 1 THEN NOT regexp_matches(target, '^/fr/.*5$') ELSE NOT regexp_matches(target, '^/de') END AS allowed
FROM (SELECT page_id, url, {SITE} AS site, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), ''), '/') AS target
      FROM pages) AS p JOIN robots_files AS r ON r.site = p.site""",
        ),
    }
