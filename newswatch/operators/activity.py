"""User activity: recording, summaries, recent rows, rate audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.functions.text import meta_field, moment

# ---- fixed values ----
ALLOWED_DAYS = [1, 7, 30]
DEFAULT_DAYS = 7
ACTIVITY_TYPES = ["login", "news_filter", "ai_chat"]
META_FIELDS = ["industry_sector", "company", "period", "topic", "question_length"]
RECENT_LIMIT = 50
RATE_WINDOW_SECONDS = 60
RATE_LIMITS = {"public": 240, "chat": 30}
CHAT_PATH = "/api/dashboard/chat"
NEWS_PATH = "/api/dashboard/news"
PUBLIC_PATHS = ["/", "/dashboard", "/viewer", "/viewer/logout"]
PUBLIC_PREFIXES = ["/requests", "/static/"]
# ---- end of fixed values ----


def new_activity(events: DataFrame) -> DataFrame:
    """Events to append: user and role required, ``meta`` map as JSON, an id each."""
    kept = events.where((F.coalesce("username", F.lit("")) != "") & (F.coalesce("role", F.lit("")) != ""))
    return kept.select(
        F.expr("uuid()").alias("activity_id"),
        "username",
        "role",
        "activity_type",
        "activity_path",
        F.coalesce(F.to_json("meta"), F.lit("{}")).alias("activity_meta"),
        "request_id",
        "client_ip",
        "created_ts",
    )


def report_parameters(accounts: DataFrame, days, username: str | None, activity_type: str | None):
    """Allowed days, known user, known type; anything else falls back (F16)."""
    try:
        days = int(days)
    except (TypeError, ValueError):
        days = DEFAULT_DAYS
    days = days if days in ALLOWED_DAYS else DEFAULT_DAYS
    username = (username or "").strip() or "ALL"
    if username != "ALL" and accounts.where(F.col("username") == username).isEmpty():
        username = "ALL"
    activity_type = (activity_type or "").strip()
    return days, username, activity_type if activity_type in ACTIVITY_TYPES else "ALL"


def activity_since(
    activity: DataFrame, as_of, days: int = DEFAULT_DAYS, username: str = "ALL", activity_type: str = "ALL"
) -> DataFrame:
    """The last ``days`` days, optionally of one user and type."""
    rows = activity.where(F.col("created_ts") >= moment(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    if username != "ALL":
        rows = rows.where(F.col("username") == username)
    return rows if activity_type == "ALL" else rows.where(F.col("activity_type") == activity_type)


def activity_summary(activity: DataFrame, as_of, **filters) -> DataFrame:
    """Counts by user and role, latest first."""
    counts = [F.count_if(F.col("activity_type") == t).alias(f"{t}_count") for t in ACTIVITY_TYPES]
    return (
        activity_since(activity, as_of, **filters)
        .groupBy("username", "role")
        .agg(*counts, F.max("created_ts").alias("last_activity_ts"))
        .orderBy(F.desc("last_activity_ts"), "username")
    )


def readable_meta(c: Column) -> Column:
    """JSON text; NULL and broken text become an empty object."""
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.lit("{}"))


def recent_activity(activity: DataFrame, as_of, limit: int = RECENT_LIMIT, **filters) -> DataFrame:
    """The latest events (K6); the id settles ties."""
    latest = activity_since(activity, as_of, **filters).orderBy(F.desc("created_ts"), "activity_id").limit(limit)
    return latest.select(
        "username",
        "role",
        "activity_type",
        "activity_path",
        readable_meta(F.col("activity_meta")).alias("activity_meta"),
        "created_ts",
    )


def active_accounts(activity: DataFrame, as_of, days: int = DEFAULT_DAYS) -> DataFrame:
    """Distinct users of the last days, sorted."""
    return activity_since(activity, as_of, days).select("username").distinct().orderBy("username")


def meta_fields(activity: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Fields of the JSON metadata as columns."""
    fields = [meta_field(F.col("activity_meta"), name).alias(name) for name in names or META_FIELDS]
    return activity.select("activity_id", "activity_type", *fields)


def rate_scope(method: Column, path: Column) -> Column:
    """The limit a request counts against, NULL for none."""
    prefixed = path.startswith(PUBLIC_PREFIXES[0]) | path.startswith(PUBLIC_PREFIXES[1])
    return (
        F.when((method == "POST") & (path == CHAT_PATH), F.lit("chat"))
        .when(path.isin(PUBLIC_PATHS) | prefixed | ((method == "GET") & (path == NEWS_PATH)), F.lit("public"))
    )


def rate_audit(
    requests: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS, limits: dict[str, int] | None = None
) -> DataFrame:
    """Attempts of the same scope and client in the trailing window of each request.

    The window is half-open: a request exactly ``window_seconds`` old is out.
    Each client's time line is cut into stretches of ten windows, and a
    stretch also sees the last window of the one before. So one client with a
    third of all rows is spread over many tasks, at a tenth more rows. A request without a time has no
    attempts to count: ``attempts`` and ``over_limit`` are NULL.
    """
    limits = limits or RATE_LIMITS
    untimed = requests.where("created_ts IS NULL")
    stretch = F.window("created_ts", f"{window_seconds * 10} seconds")
    near_end = F.col("created_ts") > F.col("w.end") - F.expr(f"INTERVAL {window_seconds} SECONDS")
    seen = requests.withColumn("w", stretch).select(
        "*",
        F.explode(
            F.when(near_end, F.array(F.col("w.start"), F.col("w.end"))).otherwise(F.array(F.col("w.start")))
        ).alias("stretch"),
    )
    frame = f"RANGE BETWEEN INTERVAL '{window_seconds - 1}.999999' SECOND PRECEDING AND CURRENT ROW"
    counted = seen.withColumn(
        "attempts",
        F.expr(f"count(*) OVER (PARTITION BY scope, client_ip, stretch ORDER BY created_ts {frame})"),
    )
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    own = counted.where(F.col("stretch") == F.col("w.start")).drop("w", "stretch")
    every = own.unionByName(untimed.withColumn("attempts", F.lit(None).cast("bigint")))
    return every.select(
        "activity_id",
        "scope",
        "client_ip",
        "created_ts",
        "attempts",
        (F.col("attempts") > F.try_element_at(limit, F.col("scope"))).alias("over_limit"),
    )
