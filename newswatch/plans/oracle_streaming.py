"""SQL oracle of the streaming queries."""

from __future__ import annotations

from newswatch.plans.oracle_load import LOAD, LOAD_TABLES, RECORD, with_tables

WINDOW = 3_600_000_000


def oracle() -> dict[str, str]:
    limiter = with_tables(
        "activity",
        """SELECT activity_id, scope, client_ip, allowed,
       CASE WHEN allowed THEN 0 ELSE greatest(1, (oldest + 3600000000 - at_us) // 1000000) END AS retry_after FROM verdicts""",
        """calls AS (SELECT activity_id, scope, client_ip, at_us, row_number() OVER
    (PARTITION BY scope, client_ip ORDER BY at_us, activity_id) AS n, CASE scope WHEN 'chat' THEN 1 ELSE 3 END AS most
  FROM (SELECT *, epoch_us(created_ts) AS at_us, CASE activity_type WHEN 'ai_chat' THEN 'chat' ELSE 'public' END AS scope
        FROM activity))""",
        f"""verdicts AS (
  SELECT activity_id, scope, client_ip, n, true AS allowed, [at_us] AS live, at_us, at_us AS oldest FROM calls WHERE n = 1
  UNION ALL
  SELECT c.activity_id, c.scope, c.client_ip, c.n, len(list_filter(v.live, lambda x: x > c.at_us - {WINDOW})) < c.most,
         CASE WHEN len(list_filter(v.live, lambda x: x > c.at_us - {WINDOW})) < c.most
              THEN list_append(list_filter(v.live, lambda x: x > c.at_us - {WINDOW}), c.at_us)
              ELSE list_filter(v.live, lambda x: x > c.at_us - {WINDOW}) END,
         c.at_us, list_filter(v.live, lambda x: x > c.at_us - {WINDOW})[1]
  FROM verdicts AS v JOIN calls AS c ON c.scope = v.scope AND c.client_ip = v.client_ip AND c.n = v.n + 1)""",
    )
    limiter = limiter.replace("WITH ", "WITH RECURSIVE ", 1)
    return {
        "rate_limiter": limiter,
        "rate_limiter_late": limiter,  # late arrival changes no verdict
        "continuous_load": with_tables(LOAD_TABLES, f"SELECT {RECORD} FROM due", *LOAD),
    }
