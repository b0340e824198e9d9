"""Feed, monitoring, activity, requests, robots, sources: edge cases and brute force."""

import json
import random
import re
import types
from collections import deque
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newswatch.operators import activity, feed, load, marts, monitor, report, requests, robots, warehouse
from newswatch.operators.validate import validate, validation_metrics
from newswatch.schemas import RECORD
from newswatch.sources import pages, registry, seeds, staging
from newswatch.streaming import rate_limiter
from newswatch.streaming.rate_limiter import SECOND, admit, rate_limited

AS_OF = "2024-03-31 00:00:00"
NEWS = (
    "company_name string, industry_sector string, id string, url string, title string, article_summary string, key_topic string, "
    "business_impact string, geography string, signal_type string, priority_score int, summary_model string, "
    "summary_status string, published_date timestamp_ntz, s_created_ts timestamp_ntz"
)


def news(spark, rows):
    """Rows of (company, sector, score, date, topic)."""
    full = [
        (c, s, str(i), f"https://x/{i}", f"T{i}", "sum", t, None, None, None, p, None, "ai", d, None)
        for i, (c, s, p, d, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, NEWS)


def test_window_bounds(spark):
    days = [datetime(2024, 3, 24), datetime(2024, 3, 23, 23, 59, 59), datetime(2024, 2, 29), datetime(2024, 2, 28), datetime(2023, 9, 30), None]
    rows = news(spark, [("A", "S", 72, d, "t") for d in days])
    sizes = {p: warehouse.news_window(rows, AS_OF, p).count() for p in ("week", "month", "6_months", "all")}
    assert sizes == {"week": 1, "month": 3, "6_months": 5, "all": 6}  # one month before March 31 is February 29
    assert warehouse.top_news(rows, AS_OF, "week").count() == 1 and warehouse.top_news(rows, AS_OF, "month").count() == 0


def test_null_ids_and_missing_names(spark):
    articles = spark.createDataFrame([(None, "A"), ("1", "B")], "id string, company_name string")
    excluded = spark.createDataFrame([("1",), (None,)], "id string")
    assert [r.company_name for r in warehouse.without_excluded(articles, excluded).collect()] == ["A"]
    day = datetime(2024, 3, 30)
    mart = marts.company_intelligence(news(spark, [(None, "S", 95, day, "t"), ("A", "S", 55, None, "t"), ("B", "S", 55, day, "m&a"), ("B", "S", 60, day, "b")]), AS_OF)
    rows = {r.company_name: r for r in mart.collect()}
    assert rows[None].leading_topic_last_30_days == "no recent topic" and rows[None].attention_level == "medium"
    assert rows["A"].leading_topic_last_30_days == "no recent topic" and rows["A"].avg_priority_last_30_days is None
    assert rows["B"].leading_topic_last_30_days == "b" and rows["B"].avg_priority_last_30_days == 57.5
    kpis = {r.metric: r.numeric_value for r in marts.kpi_overview(news(spark, []), AS_OF).collect()}
    assert set(kpis.values()) == {0.0} and len(kpis) == 6


def test_dashboard_filters_cascade(spark):
    day = datetime(2024, 3, 30)
    rows = news(spark, [("A", "BANKING", 95, day, "x"), ("B", "ENERGY", 80, day, ""), ("B", "ENERGY", 80, None, "y"), ("C", "ENERGY", 55, day, "y")])
    board = feed.dashboard(rows, AS_OF, sector="ENERGY", company="A", period="nonsense", topic="x")
    assert board["selected"] == {"industry_sector": "ENERGY", "company": "ALL", "period": "nonsense", "topic": "ALL"}
    assert [r[0] for r in board["companies"].collect()] == ["B", "C"]  # an unknown period is the week
    assert [r.company_name for r in board["rows"].collect()] == ["B", "C"]
    whole = feed.dashboard(rows, AS_OF, sector="all", period="all")
    assert [(r.company_name, r.published_date) for r in whole["rows"].collect()] == [
        ("A", "2024-03-30"), ("B", "2024-03-30"), ("B", ""), ("C", "2024-03-30")
    ]
    summary = whole["summary"].head()
    assert (summary.article_count, summary.company_count, summary.avg_priority) == (4, 3, 77.5)
    assert [r.label for r in whole["periods"].orderBy("position").collect()] == ["Last 7 days", "This month", "Last 6 months", "All available"]
    empty = feed.feed_summary(feed.feed(rows, AS_OF, company="nobody")).head()
    assert (empty.article_count, empty.company_count, empty.avg_priority) == (0, 0, 0.0)
    colors = report.with_color(spark.createDataFrame([("Pfizer",), ("X",), (None,)], "company_name string"))
    assert [r.color for r in colors.collect()] == ["CFE2FF", None, None]


def test_dashboard_choices_against_a_plain_model(spark, tmp_path):
    rng = random.Random(2)
    made = [(rng.choice(["A", "B", None]), rng.choice(["S", "T", ""]), 50, datetime(2024, 3, 30), rng.choice(["x", "y", ""])) for _ in range(12)]
    news(spark, made).write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    combined = feed.combinations(base, AS_OF, "week").cache()
    for sector in ("S", "T", "", "all", None, "Q"):
        for company in ("A", "B", "Z", ""):
            for topic in ("x", "y", "z", "All"):
                chosen, left = [], made
                for k, wanted in ((1, sector), (0, company), (4, topic)):
                    found = not wanted or wanted.upper() == "ALL" or wanted in {r[k] for r in left if r[k]}
                    chosen.append((wanted or "ALL") if found else "ALL")
                    left = [r for r in left if chosen[-1].upper() == "ALL" or r[k] == chosen[-1]]
                assert feed.valid_choices(combined, sector, company, topic) == tuple(chosen)
    board = feed.dashboard(base, AS_OF, "S", "A", "week", "x")
    for name in ("industry_sectors", "companies", "topics", "summary", "top_topics", "rows"):
        files = board[name].inputFiles()
        assert files and not any(str(tmp_path) in f for f in files), name  # nothing reads the base again


MONITORING = "run_id string, run_name string, company_name string, load_type string, run_status string, run_message string, records_inserted bigint, urls_attempted bigint, urls_fetched bigint, parse_success_count bigint, error_count bigint, run_start_ts timestamp_ntz, run_end_ts timestamp_ntz"


def test_monitoring_report(spark):
    end = datetime(2024, 3, 31, 21, 59, 59, 999999)  # the last moment of the day in Paris, in summer time
    rows = [
        ("r1", "f", "B", "FULL", "SUCCESS", None, 3, 1, 1, 1, 0, end, end),
        ("r1", "f", "A", "FULL", "FAILURE", None, None, 1, 1, 1, 2, end, end),
        ("r2", "f", "A", "FULL", "SUCCESS", None, 0, 1, 1, 1, 0, end, datetime(2024, 3, 30, 23)),
        ("r3", "f", "A", "FULL", "SUCCESS", None, 9, 1, 1, 1, 0, end, end + timedelta(microseconds=1)),
    ]
    df = spark.createDataFrame(rows, MONITORING)
    out = monitor.report(df, "2024-03-31")
    totals = out["totals"].head()
    assert (totals.total_inserted, totals.total_errors, totals.successful_rows, totals.failed_rows, totals.run_count) == (3, 2, 2, 1, 2)
    assert {(r.run_id, r.run_status) for r in out["runs"].collect()} == {("r1", "FAILED"), ("r2", "SUCCESS")}
    styles = [(r.company_name, r.row_style[:20]) for r in out["companies"].collect()]
    assert styles == [("A", monitor.ERROR_STYLE[:20]), ("B", monitor.INSERT_STYLE[:20]), ("A", "")]
    assert out["notice"].count() == 0
    empty = monitor.report(df, "2020-01-01")
    assert empty["totals"].head().row_count == 0 and empty["notice"].count() == 1
    assert [r.company_name for r in monitor.ordered_rows(df.where("run_id = 'r1'")).collect()] == ["A", "B"]


def test_validation_and_delta(spark):
    rows = [("A", " https://x/1 ", " Title long enough ", 2), ("B", "https://x/1", "Another long title", 1), ("A", "HTTPS://x/2", "Title long enough", 3), ("A", None, "Title long enough", 4), ("A", "https://x/3", "short", 5)]
    df = spark.createDataFrame(rows, "company_name string, url string, title string, seq int").withColumn("response_time_ms", F.lit(4.0))
    assert [(r.company_name, r.url) for r in validate(df).collect()] == [("B", "https://x/1")]
    assert validate(df, 3).count() == 2
    run = spark.createDataFrame([(9, 8, 7, 0.0, 1)], "urls_attempted bigint, urls_fetched bigint, parse_success_count bigint, avg_response_time_ms double, error_count bigint")
    assert tuple(validation_metrics(validate(df), run).head()) == (9, 8, 1, 4.0, 1, 1)
    assert tuple(validation_metrics(validate(df.limit(0)), run).head()) == (9, 8, 7, 0.0, 1, 0)
    delta = spark.createDataFrame(
        [("A", d, "DELTA") for d in ("2026-04-19T09:00:00Z", "2026-04-19T10:00:00Z", "2026-04-19 10:00:01", None, "soon")] + [("B", "2000-01-01", "FULL"), ("C", "2000-01-01", "DELTA")],
        "company_name string, published_date string, load_type string",
    )
    cutoffs = spark.createDataFrame([("A", datetime(2026, 4, 19, 10)), ("B", datetime(2026, 4, 19, 10))], "company_name string, last_success timestamp_ntz")
    kept = load.delta_filter(delta, cutoffs).collect()
    assert sorted((r.company_name, str(r.published_date)) for r in kept) == [
        ("A", "2026-04-19 10:00:01"), ("A", "None"), ("A", "None"), ("B", "2000-01-01 00:00:00"), ("C", "2000-01-01 00:00:00")
    ]


def test_rate_audit_against_brute_force(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    hot = [0, 60_000_000, 120_000_000, 599_999_999, 600_000_000, 600_000_001, 659_999_999, 660_000_000]  # exact ages and stretch ends
    calls = [("public", "hot", t) for t in hot] + [(rng.choice(["public", "chat"]), rng.choice(["hot", "b"]), rng.randrange(0, 1_500_000_000, 250_000)) for _ in range(1500)]
    rows = [(str(i), s, c, start + timedelta(microseconds=t)) for i, (s, c, t) in enumerate(calls)]
    df = spark.createDataFrame(rows, "activity_id string, scope string, client_ip string, created_ts timestamp_ntz")
    got = {r.activity_id: (r.attempts, r.over_limit) for r in activity.rate_audit(df, 60, {"public": 20, "chat": 5}).collect()}
    for i, (s, c, t) in enumerate(calls):
        n = sum(1 for s2, c2, t2 in calls if s2 == s and c2 == c and t - 60_000_000 < t2 <= t)
        assert got[str(i)] == (n, n > (20 if s == "public" else 5))
    assert len(got) == len(calls)


def test_admission(spark):
    known = deque()
    times = [t * SECOND for t in (0, 1, 2, 30, 59, 60, 61, 62)]
    verdicts = list(admit(known, times, 60 * SECOND, 2))
    assert verdicts == [(True, 0), (True, 0), (False, 58), (False, 30), (False, 1), (True, 0), (True, 0), (False, 58)]
    scopes = [("POST", "/api/dashboard/chat", "chat"), ("GET", "/api/dashboard/chat", None), ("GET", "/api/dashboard/news", "public"), ("GET", "/requests/1", "public"), ("GET", "/static/a", "public"), ("GET", "/other", None)]
    df = spark.createDataFrame(scopes, "m string, p string, want string")
    assert df.where(~activity.rate_scope(F.col("m"), F.col("p")).eqNullSafe(F.col("want"))).count() == 0


def test_activity(spark):
    events = spark.createDataFrame(
        [("u", "admin", "login", {"period": "week"}), ("", "admin", "login", None), ("v", None, "login", None), ("w", "guest", "x", None)],
        "username string, role string, activity_type string, meta map<string,string>",
    ).select("*", *[F.lit(None).cast("string").alias(c) for c in ("activity_path", "request_id", "client_ip")], F.lit(None).cast("timestamp_ntz").alias("created_ts"))
    added = {r.username: r for r in activity.new_activity(events).collect()}
    assert set(added) == {"u", "w"} and json.loads(added["u"].activity_meta) == {"period": "week"} and added["w"].activity_meta == "{}"
    texts = spark.createDataFrame([('{"a": 1}',), ("{broken",), (None,)], "m string")
    assert [r[0] for r in texts.select(activity.readable_meta(F.col("m"))).collect()] == ['{"a": 1}', "{}", "{}"]
    accounts = spark.createDataFrame([("u",)], "username string")
    assert activity.report_parameters(accounts, "30", " u ", "login") == (30, "u", "login")
    assert activity.report_parameters(accounts, "5", "nobody", "odd") == (7, "ALL", "ALL")
    assert activity.report_parameters(accounts, None, None, None) == (7, "ALL", "ALL")


def test_requests(spark):
    raw = spark.createDataFrame(
        [("  big   co ", "", " https://a "), ("", "AIR", "https://a"), ("x" * 101, "AIR", "https://a"), ("c", "AIR", "a.com"), ("c", "retail", "http://a"), ("c", " ", "http://a")],
        "company_name string, industry_sector string, source_url string",
    ).select("*", F.lit("u").alias("submitter_username"), F.lit("guest").alias("submitter_role"))
    reasons = [r.reject_reason for r in requests.validate_requests(raw).collect()]
    assert reasons == [None, requests.NO_NAME, requests.LONG_NAME, requests.BAD_URL, requests.BAD_SECTOR, requests.BAD_SECTOR]
    stored = requests.submit_requests(raw, AS_OF).collect()
    assert [(r.company_name, r.requested_industry_sector, r.source_url, r.review_status) for r in stored] == [("BIG CO", "LIFESCIENCE", "https://a", "PENDING")]


def test_requests_fill_free_slots_only(spark):
    sources = spark.createDataFrame([("A", "AIR", "u1", None, " u2 ", "", "u3", None, None), ("Z", "AIR", "z", None, None, None, None, None, None)],
        "company_name string, industry_sector string, source_1 string, source_2 string, source_3 string, source_4 string, source_5 string, s_created_ts timestamp_ntz, s_modified_ts timestamp_ntz")
    config = spark.createDataFrame([("F", "A", "DELTA", "N", "AIR")], "flow_name string, company_name string, load_type string, active_flag string, industry_sector string")
    wanted = [("r1", "A", "SPACE", "n1", 1), ("r2", "A", "AIR", "u2", 2), ("r3", "A", "ENERGY", "n2", 3), ("r4", "A", "BANKING", "n3", 4), ("r5", "A", "DEFENSE", "n1", 5), ("r6", "NEW", "AIR", "n", 6)]
    approved = spark.createDataFrame(wanted, "request_id string, company_name string, sector string, source_url string, position int")
    out = requests.apply_requests(sources, config, approved, "F", AS_OF)
    rows = {r.company_name: r for r in out["load_sources"].collect()}
    assert [rows["A"][f"source_{i}"] for i in range(1, 6)] == ["u1", "u2", "u3", "n1", "n2"] and rows["A"].industry_sector == "DEFENSE"
    assert rows["NEW"].source_1 == "n" and rows["Z"].source_1 == "z" and rows["Z"].s_modified_ts is None
    assert [(r.request_id, r.reject_reason) for r in out["rejected"].collect()] == [("r4", requests.SLOTS_FULL)]
    assert {(r.company_name, r.load_type, r.active_flag) for r in out["load_config"].collect()} == {("A", "DELTA", "Y"), ("NEW", "FULL", "Y")}


def fetch_allowed(text, url_path, agent):
    """A plain model: groups in order, the longest rule wins, the later of equals."""
    groups, agents, rules = [], [], []
    for raw in text.split("\n"):
        name, colon, value = (raw.split("#")[0].strip()).partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if rules:
                groups.append((agents, rules))
                agents, rules = [], []
            agents.append(value.lower())
        elif name in ("allow", "disallow") and agents:
            rules.append((name, value))
    groups.append((agents, rules))
    named = [r for a, rs in groups if any(x != "*" and x in agent.lower() for x in a) for r in rs]
    star = [r for a, rs in groups if "*" in a and not any(x != "*" and x in agent.lower() for x in a) for r in rs]
    best, allowed = -1, True
    for name, pattern in named or star:
        regex = "".join(".*" if ch == "*" else re.escape(ch) for ch in (pattern[:-1] if pattern.endswith("$") else pattern))
        if pattern and len(pattern) >= best and re.match(regex + ("$" if pattern.endswith("$") else ""), url_path):
            best, allowed = len(pattern), name == "allow"
    return allowed


def test_robots_against_a_plain_model(spark):
    rng = random.Random(5)
    parts = ["/a", "/b", "*", "$", ".x", "/", "?q="]
    lines = ["User-agent: *", "User-Agent: NewsBot", "user-agent: other", "# note", "Sitemap: x", "no colon"]

    def line():
        if rng.random() < 0.45:
            return rng.choice(lines)
        return rng.choice(["Disallow", "Allow", " ALLOW "]) + ": " + "".join(rng.choice(parts) for _ in range(rng.randrange(0, 4)))

    files = [(f"https://h{i}.com", "\n".join(line() for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    urls = [(i, s, "".join(rng.choice(["/a", "/b", ".x", "/"]) for _ in range(rng.randrange(0, 4))), rng.choice(["", "?q=1"])) for i, (s, _) in enumerate(files * 20)]
    df = spark.createDataFrame([(i, s + (p if p.startswith("/") or not p else "/" + p) + q) for i, s, p, q in urls] + [(-1, "https://unknown.org/a")], "i int, url string")
    rules = robots.site_rules(spark.createDataFrame(files, "site string, text string"), "NewsBot/1.0")
    got = {r.i: (r.url, r.allowed) for r in robots.fetch_decisions(df, rules).collect()}
    texts = dict(files)
    for i, (url, allowed) in got.items():
        site, rest = re.match(r"(https://[^/?]+)(.*)", url).groups()
        path = rest if rest.startswith("/") else "/" + rest
        assert allowed == fetch_allowed(texts.get(site, ""), path, "NewsBot/1.0"), (url, texts.get(site))


def test_staging_layouts(spark):
    listing = spark.createDataFrame([("STG_LifeScience", "Stg_big_co"), ("dwh", "stg_x"), ("stg_air", "view")], "schemaname string, tablename string")
    assert [tuple(r) for r in staging.staging_tables(listing).collect()] == [("STG_LifeScience", "Stg_big_co", "BIG CO", "LIFESCIENCE")]
    for db, table, rows in [("stg_air", "stg_one", [("1", "u1"), (None, "u2")]), ("stg_space", "stg_two_co", [("1", "u3"), (None, "u4")])]:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
        df = spark.createDataFrame(rows, "id string, url string").select("*", *[F.lit(None).cast(t).alias(n) for n, t in [("title", "string"), ("published_date", "timestamp_ntz"), ("s_created_ts", "timestamp_ntz"), ("article_content", "string")]])
        df.write.mode("overwrite").saveAsTable(f"{db}.{table}")
    union = staging.staged_tables(spark)
    assert {(r.company_name, r.industry_sector, r.url) for r in union.collect()} == {("ONE", "AIR", "u1"), ("ONE", "AIR", "u2"), ("TWO CO", "SPACE", "u3"), ("TWO CO", "SPACE", "u4")}
    assert "article_content" not in union.columns and "article_content" in staging.staged_tables(spark, with_body=True).columns
    assert {r.url for r in staging.first_by_id(union).collect()} == {"u1", "u2"}
    snapshots = spark.createDataFrame([("a", 200, "Text/HTML; x"), ("b", 404, "text/html"), ("c", 200, "application/pdf"), ("d", 200, None), ("e", None, "text/html")], "url string, status_code int, content_type string")
    assert [r.url for r in pages.usable_pages(snapshots).collect()] == ["a"]


def test_seed_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text("COMPANY_NAME,INDUSTRY_SECTOR,SOURCE_1,SOURCE_2,SOURCE_3,SOURCE_4,SOURCE_5\n Acme ,air,https://a,,,,\n,,x,,,,\nB,,,,,,\n")
    (tmp_path / "c.csv").write_text("COMPANY_NAME,FLOW_NAME,LOAD_TYPE,ACTIVE_FLAG,INDUSTRY_SECTOR\nAcme,F,FULL,Y,\nAcme,,FULL,Y,AIR\n")
    (tmp_path / "s.json").write_text('{"EXPORT_RESULTS": true,\n "MAX_WORKERS": 3, "LISTING_SLEEP_SEC": 0.5, "NOTE": "x"}')
    (tmp_path / "e.csv").write_text('company_name,id,title\nA,1,"two\nlines"\n')
    rows = {r.company_name: r for r in seeds.source_seed(seeds.read_csv(spark, str(tmp_path / "s.csv"))).collect()}
    assert set(rows) == {"Acme", "B"} and rows["Acme"].industry_sector == "AIR" and rows["B"].industry_sector == "LIFESCIENCE" and rows["Acme"].source_2 is None
    config = seeds.config_seed(seeds.read_csv(spark, str(tmp_path / "c.csv")))
    assert [tuple(r) for r in config.collect()] == [("F", "Acme", "FULL", "Y", "LIFESCIENCE")]
    settings = seeds.settings_seed(spark, str(tmp_path / "s.json"))
    assert {(r.param_name, r.param_value) for r in settings.collect()} == {("EXPORT_RESULTS", "true"), ("MAX_WORKERS", "3"), ("LISTING_SLEEP_SEC", "0.5"), ("NOTE", "x")}
    typed = registry.settings(registry.settings_or_file(settings.limit(0), settings)).head()
    assert (typed.MAX_WORKERS, typed.EXPORT_RESULTS, typed.LISTING_SLEEP_SEC, typed.MAX_ITEMS_PER_SOURCE) == (3, True, 0.5, 25)
    assert seeds.seed_if_empty(config, config.limit(0)).count() == 1 and seeds.seed_if_empty(config.limit(0), config).count() == 1
    assert seeds.exclusion_list(spark, str(tmp_path / "e.csv")).head().title == "two\nlines"


def test_where_a_stream_is_cut_changes_nothing(spark, tmp_path):
    """A url belongs to its first arrival also when that one was not due and came in an earlier batch."""
    from newswatch.streaming.continuous_load import continuous_load

    def row(company, n, day, title="A title that is long enough"):
        return (company, f"id{n}", "https://a.com/", f"https://a.com/{n % 3}", title, "body", day, "2026-01-01T00:00:00+00:00", 1.0, n)

    parts = [[row("OLD", 0, "2020-01-01"), row("NEW", 1, None)], [row("NEW", 3, None), row("NEW", 4, None)], [row("NEW", 2, None), row("NEW", 5, None)]]
    config = spark.createDataFrame([("OLD", "DELTA", "BANKING"), ("NEW", "FULL", "SPACE")], "company_name string, load_type string, industry_sector string")
    cutoffs = spark.createDataFrame([("OLD", datetime(2025, 1, 1))], "company_name string, last_success timestamp_ntz")
    found = {}
    for n_files in (1, 3):
        folder = tmp_path / f"in{n_files}"
        for part in ([sum(parts, [])] if n_files == 1 else parts):
            spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = str(tmp_path / f"out{n_files}")
        continuous_load(stream, out, f"{out}-checkpoint", config, cutoffs, once=True).awaitTermination()
        found[n_files] = sorted(r.id for r in spark.read.parquet(out).collect())
    assert found[1] == found[3] == ["id1", "id2"]


def test_continuous_load_of_many_batches(spark, tmp_path):
    """Any cut gives the same rows, a batch reads no stored rows, and urls stored before are known."""
    from newswatch.streaming.continuous_load import continuous_load, stored

    rng = random.Random(8)
    rows = [
        (rng.choice("AB"), f"id{n}", "https://a.com/", f" https://a.com/{rng.randrange(60)} ", "A title that is long enough"[: rng.choice([5, 30])], "body", None, None, None, n)
        for n in range(200)
    ]
    config = spark.createDataFrame([("A", "FULL", "SPACE")], "company_name string, load_type string, industry_sector string")
    cutoffs = spark.createDataFrame([], "company_name string, last_success timestamp_ntz")
    before = ("A", "old", "https://a.com/", "https://a.com/7", "An older title of it", None, None, None, None, -1)
    want = {}
    for r in rows:
        if len(r[4]) >= 10:
            want.setdefault(r[3].strip(), r[:2])
    want = sorted([("A", "old"), *(v for k, v in want.items() if (k, v[0]) != ("https://a.com/7", "A"))])
    for n_files in (1, 20):
        folder, out = tmp_path / f"many{n_files}", str(tmp_path / f"loaded{n_files}")
        first = spark.createDataFrame([before], RECORD).withColumns({"load_type": F.lit("FULL"), "industry_sector": F.lit("SPACE")})
        first.withColumn("published_date", F.lit(None).cast("timestamp_ntz")).write.partitionBy("industry_sector").parquet(out)
        size = len(rows) // n_files
        for k in range(n_files):
            spark.createDataFrame(rows[k * size : (k + 1) * size], RECORD).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(folder))
        for _ in range(2):  # a second run finds nothing new
            query = continuous_load(stream, out, f"{out}-checkpoint", config, cutoffs, once=True)
            query.awaitTermination()
        loaded = stored(spark, out)
        assert sorted((r.company_name, r.id) for r in loaded.collect()) == want
        assert {r.article_content for r in loaded.where("id <> 'old'").collect()} == {"body"}


def test_only_a_repeated_batch_reads_the_table(spark, tmp_path, monkeypatch):
    from newswatch.streaming import continuous_load as module

    calls = []
    monkeypatch.setattr(module, "load_batch", lambda batch, path, config, cutoffs, again: calls.append(again))
    load = module.loader("p", None, None)
    for k in range(20):
        load(None, k)
    assert calls == [True] + [False] * 19


def test_staging_layout_in_one_scan(spark, tmp_path):
    def table(schema, name, ids):
        rows = [(i, f"https://x/{i}", "t", f"body {i}") for i in ids]
        spark.createDataFrame(rows, "id string, url string, title string, article_content string").write.parquet(f"{tmp_path}/l/{schema}/{name}")

    table("stg_banking", "stg_acme_corp", ["1", "2"])
    table("stg_banking", "stg_other", ["3"])
    table("dwh", "stg_acme_corp", ["4"])
    table("stg_life", "final", ["5"])
    union = staging.staged_layout(spark, f"{tmp_path}/l", with_body=True)
    assert sorted((r.id, r.company_name, r.industry_sector, r.tablename, r.article_content, r.published_date) for r in union.collect()) == [
        ("1", "ACME CORP", "BANKING", "stg_acme_corp", "body 1", None),
        ("2", "ACME CORP", "BANKING", "stg_acme_corp", "body 2", None),
        ("3", "OTHER", "BANKING", "stg_other", "body 3", None),
    ]
    plan = staging.staged_layout(spark, f"{tmp_path}/l")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "article_content" not in plan
    empty = staging.staged_layout(spark, f"{tmp_path}/missing")
    assert empty.count() == 0 and empty.columns == union.drop("article_content").columns


def test_requests_without_a_time_are_kept(spark):
    rows = [("a", "chat", "ip", None), ("b", "chat", "ip", datetime(2026, 1, 1))]
    got = activity.rate_audit(spark.createDataFrame(rows, "activity_id string, scope string, client_ip string, created_ts timestamp_ntz"))
    assert sorted((r.activity_id, r.attempts, r.over_limit) for r in got.collect()) == [("a", None, None), ("b", 1, False)]


def late_stream(spark, folder, batches):
    """One file, and so one micro-batch, for each list of calls."""
    schema = "activity_id string, scope string, client_ip string, at_us long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = f"{folder}-verdicts"
    limited = rate_limited(stream, 600, {"public": 3, "chat": 1}, lateness_seconds=900)
    limited.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.parquet(out).collect()
    assert len(found) == len({r.activity_id for r in found})
    return {r.activity_id: (r.allowed, r.retry_after) for r in found}


@pytest.mark.parametrize("n_batches", [2, 7])
def test_late_calls_have_the_verdicts_of_the_true_order(spark, tmp_path, n_batches):
    rng = random.Random(n_batches)
    start = 1_767_225_600
    calls = [(f"c{n}", rng.choice(["public", "chat"]), rng.choice("AAB"), (start + rng.randrange(7200)) * SECOND + rng.randrange(SECOND)) for n in range(300)]
    want = {}
    for key in {c[1:3] for c in calls}:
        own, admitted = sorted((c[3], c[0]) for c in calls if c[1:3] == key), []
        for at, name in own:
            live = [t for t in admitted if t > at - 600 * SECOND]
            most = 1 if key[0] == "chat" else 3
            want[name] = (len(live) < most, 0 if len(live) < most else max(1, (live[0] + 600 * SECOND - at) // SECOND))
            if len(live) < most:
                admitted.append(at)
    arrival = sorted(calls, key=lambda c: c[3] + rng.randrange(900) * SECOND)
    assert [c[3] for c in arrival] != sorted(c[3] for c in calls)
    size = -(-len(arrival) // n_batches)
    batches = [arrival[k : k + size] for k in range(0, len(arrival), size)]
    assert late_stream(spark, tmp_path / "open", batches).items() < want.items()  # the last ones are still held back
    heartbeat = [(None, None, None, (start + 7200 + 900 + 61) * SECOND)]
    assert late_stream(spark, tmp_path / "ended", [*batches, heartbeat]) == want


def test_calls_later_than_waited_for_and_calls_without_a_time(spark, tmp_path):
    minute = 60 * SECOND
    first = [("a", "chat", "A", 100 * minute), ("no time", "chat", "A", None)]
    later = [("b", "chat", "A", 1000 * minute)]
    latest = [("too late", "chat", "A", 104 * minute), ("much too late", "chat", "A", 50 * minute)]
    heartbeat = [(None, None, None, 2000 * minute)]
    got = late_stream(spark, tmp_path / "in", [first, later, latest, heartbeat])
    assert got == {"a": (True, 0), "no time": (None, None), "b": (True, 0), "too late": (False, 360), "much too late": (True, 0)}


class CountedState:
    """The states and timers of one client in memory; counts every call to them."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getMapState(self, *_):
        return self

    getValueState = getListState = lambda self, *_: CountedValue(self)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.values[key]

    def containsKey(self, key):
        self.calls += 1
        return key in self.values

    def removeKey(self, key):
        self.calls += 1
        del self.values[key]

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class CountedValue:
    def __init__(self, owner):
        self.owner, self.value = owner, None

    def exists(self):
        self.owner.calls += 1
        return self.value is not None

    def get(self):
        self.owner.calls += 1
        return self.value

    def put(self, value):
        self.owner.calls += 1
        self.value = value

    update = put

    def clear(self):
        self.put(None)


@pytest.mark.parametrize("room", [1 << 14, 40, 1])
def test_held_calls_need_few_state_calls_and_keep_the_true_order(monkeypatch, room):
    monkeypatch.setattr(rate_limiter, "ROOM", room, raising=False)
    rng = random.Random(room)
    minute, start = 60 * SECOND, 1_767_225_600 * SECOND
    calls = [(start + rng.randrange(2000) * minute + rng.randrange(minute), f"c{n}") for n in range(2000)]
    limiter, state = rate_limiter.PatientRateLimiter(600, {"public": 3}), CountedState()
    limiter.init(state)
    frames = [pd.DataFrame(calls[k : k + 500], columns=["at_us", "activity_id"]) for k in range(0, 2000, 500)]
    got, watermark, live, want = [], 0, deque(), {}

    def fire(to):
        times = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: to // 1000)
        for at in sorted(t for t in state.timers if t <= to // 1000):
            got.extend(limiter.handleExpiredTimer(("public", "A"), times, types.SimpleNamespace(getExpiryTimeInMs=lambda at=at: at)))
            state.timers.discard(at)

    got.extend(limiter.handleInputRows(("public", "A"), iter(frames[:2]), None))
    fire(start - minute)
    got.extend(limiter.handleInputRows(("public", "A"), iter(frames[2:]), None))
    for part in (1, 2):  # the watermark passes the middle, then the end
        fire(start + part * 1001 * minute)
    for at, name in sorted(calls):
        want[name] = next(iter(rate_limiter.admit(live, [at], 600 * SECOND, 3)))
    rows = pd.concat(got)
    assert len(rows) == 2000 and not state.timers and not state.values
    assert dict(zip(rows["activity_id"], zip(rows["allowed"], rows["retry_after"], strict=True), strict=True)) == want
    if room > 2000:
        assert state.calls < 100
