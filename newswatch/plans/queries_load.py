"""Registered source, load, table-change, monitoring, activity and request queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newswatch.functions.text import label_from_name, moment, normalize_identifier
from newswatch.operators import activity, load, monitor, requests, tables
from newswatch.operators.validate import validate, validation_metrics
from newswatch.plans.jobs import export_csv
from newswatch.session import scratch_path
from newswatch.sources import registry, seeds, staging
from newswatch.sources.driver_tables import AS_OF, EVENTS_AS_OF, FLOW, adapted

REPORT_DAY = "2024-01-15"
RECORD_COLUMNS = ["company_name", "id", "url", "title", "published_date", "load_type", "industry_sector"]


class Inputs:
    """The adapted tables of one scale factor, read lazily by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._read = lambda name: adapted(spark, sf_dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        return self._read(name)


def on_inputs(fn):
    return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))


def loadable(t: Inputs) -> DataFrame:
    """Validated records with their load configuration."""
    return load.with_load_config(validate(t.records), registry.active_config(t.load_config, FLOW))


def due(t: Inputs) -> DataFrame:
    return load.delta_filter(loadable(t), load.last_success(t.monitoring, FLOW))


def stored(t: Inputs) -> DataFrame:
    """The load's target: what is dated 2023 is stored already."""
    return loadable(t).where(F.col("published_date").startswith("2023"))


def new_rows(t: Inputs) -> DataFrame:
    return load.rows_to_insert(due(t), stored(t))


def attempts(t: Inputs) -> DataFrame:
    return t.fetch_log.withColumn("attempted", F.col("response_time_ms").isNotNull())


def metrics(t: Inputs) -> DataFrame:
    return load.monitoring_metrics(attempts(t), due(t), load.fetch_metrics(attempts(t)))


def run_rows(t: Inputs) -> DataFrame:
    inserted = new_rows(t).groupBy("company_name").agg(F.count("*").alias("records_inserted"))
    config = registry.active_config(t.load_config, FLOW)
    return load.monitoring_rows(metrics(t), config, inserted, FLOW, "run-1", EVENTS_AS_OF)


def layout_union(t: Inputs) -> DataFrame:
    """Every article written as a table per company, and the union read back in one scan."""
    staged = staging.staged_articles(t.articles).drop("company_name", "industry_sector")
    path = scratch_path(staged.sparkSession, "staging-layout")
    staged.write.partitionBy("schemaname", "tablename").parquet(path)
    return staging.staged_layout(staged.sparkSession, path)


def run_rows_with_write_errors(t: Inputs) -> DataFrame:
    """The same run where the rows of every company whose name's length five divides could not be stored."""
    inserted = new_rows(t).groupBy("company_name").agg(F.count("*").alias("records_inserted"))
    config = registry.active_config(t.load_config, FLOW)
    broken = metrics(t).where(F.length("company_name") % 5 == 0)
    errors = broken.select("company_name", F.concat(F.lit("cannot store "), "company_name").alias("write_error"))
    return load.monitoring_rows(metrics(t), config, inserted, FLOW, "run-1", EVENTS_AS_OF, errors)


def summary_changes(t: Inputs) -> DataFrame:
    """Two new summaries per article in some order; the later one has to win."""
    rows = t.articles.select(F.col("id").alias("article_id"), "title", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    text = F.concat(F.lit("version "), F.col("n").cast("string"), F.lit(" of "), F.col("title"))
    return rows.select("article_id", text.alias("article_summary"), F.lit("ai").alias("summary_status"), "n")


def summary_upsert(t: Inputs) -> DataFrame:
    changes = summary_changes(t)
    target = t.summaries.select("article_id", "article_summary", "summary_status")
    return tables.upsert(target, tables.last_per_key(changes, ["article_id"], "n"), ["article_id"])


def source_upsert(t: Inputs) -> DataFrame:
    """Set the first source of every company that has sent records, new companies added."""
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    target = t.load_sources.withColumns({"s_created_ts": stamp, "s_modified_ts": stamp})
    changes = t.articles.groupBy(F.concat("company_name", F.lit(" "), "industry_sector").alias("company_name")).agg(
        F.min("url").alias("source_1")
    )
    renamed = t.articles.groupBy("company_name").agg(F.max("url").alias("source_1"))
    return tables.upsert_columns(target, renamed.unionByName(changes), ["company_name"], moment(AS_OF))


def bodies_after_purge(t: Inputs) -> DataFrame:
    bodies = t.articles.select("id", "company_name", "url", "industry_sector", "article_content")
    kept = tables.bodies_to_keep(bodies, t.summaries)
    rows = tables.with_bodies(t.articles.drop("article_content"), kept)
    return rows.select("id", F.sha2("article_content", 256).alias("body_hash"))


def purged_per_sector(t: Inputs) -> DataFrame:
    purged = tables.bodies_to_purge(t.articles, t.summaries)
    return purged.groupBy("industry_sector").agg(F.count("*").alias("purged"))


def legacy_merge(t: Inputs) -> DataFrame:
    rows = load.rows_to_insert(staging.legacy_articles(t.staged), t.articles)
    return rows.select("industry_sector", "company_name", "url", "id", "title")


def valid_requests(t: Inputs) -> DataFrame:
    return requests.validate_requests(t.requests)


def stored_requests(t: Inputs) -> DataFrame:
    """Requests as stored: the valid ones, with their states."""
    rows = valid_requests(t).where("reject_reason IS NULL").withColumn("requested_industry_sector", F.col("known_sector"))
    return rows.select(
        "request_id",
        "company_name",
        "requested_industry_sector",
        "source_url",
        "submitter_username",
        "review_status",
        F.lit(None).cast("string").alias("reviewer_username"),
        F.lit(None).cast("string").alias("review_note"),
        "requested_ts",
        F.lit(None).cast("timestamp_ntz").alias("reviewed_ts"),
    )


def decisions(t: Inputs) -> DataFrame:
    """A decision on every request sent in, valid or not."""
    number = F.expr("substring(request_id, 4)").cast("bigint")
    return t.requests.select(
        "request_id",
        (number % 2 == 0).alias("approved"),
        F.lit("boss").alias("reviewer_username"),
        F.when(number % 3 == 0, F.lit("")).otherwise(F.lit("checked")).alias("review_note"),
        F.when(number % 7 == 0, F.lit("nowhere")).when(number % 5 == 1, F.lit("air")).alias("industry_sector"),
    )


def review(t: Inputs) -> DataFrame:
    taken = requests.review_decisions(stored_requests(t), decisions(t))
    return requests.reviewed_requests(stored_requests(t), taken, AS_OF)


def refused_decisions(t: Inputs) -> DataFrame:
    taken = requests.review_decisions(stored_requests(t), decisions(t))
    return taken.where("reject_reason IS NOT NULL").select("request_id", "reject_reason")


def applied(t: Inputs) -> dict[str, DataFrame]:
    approved = valid_requests(t).where("reject_reason IS NULL AND review_status = 'APPROVED'").select(
        "request_id",
        "company_name",
        F.col("known_sector").alias("sector"),
        "source_url",
        F.expr("substring(request_id, 4)").cast("bigint").alias("position"),
    )
    return requests.apply_requests(t.load_sources, t.load_config, approved, FLOW, AS_OF)


def day_rows(t: Inputs) -> DataFrame:
    return monitor.report_rows(t.monitoring, REPORT_DAY)


def audit(t: Inputs) -> DataFrame:
    scoped = t.activity.withColumn(
        "scope", F.when(F.col("activity_type") == "ai_chat", F.lit("chat")).otherwise(F.lit("public"))
    )
    return activity.rate_audit(scoped, 3600, {"public": 3, "chat": 1})


def run_validation(t: Inputs) -> DataFrame:
    return validation_metrics(validate(t.records), load.fetch_metrics(attempts(t), per_company=False))


def recorded(t: Inputs) -> DataFrame:
    """Activity to append; users of one role are taken as anonymous."""
    events = t.activity.withColumns(
        {
            "role": F.when(F.col("role") != "guest", F.col("role")),
            "meta": F.create_map(F.lit("period"), F.lit("week"), F.lit("topic"), F.col("activity_type")),
        }
    )
    return activity.new_activity(events).drop("activity_id", "request_id")


def seed_file(spark: SparkSession, table: DataFrame) -> DataFrame:
    """A table written as a seed CSV with upper-case headings and read back."""
    path = scratch_path(spark, "seed")
    table.select(*[F.col(c).alias(c.upper()) for c in table.columns]).write.option("header", True).option("escape", '"').csv(path)
    return seeds.read_csv(spark, path)


def seeded_settings(t: Inputs) -> DataFrame:
    """The settings table written as one JSON object and read back as a seed."""
    spark = t.scraping_config.sparkSession
    path = scratch_path(spark, "settings")
    entries = F.map_from_entries(F.collect_list(F.struct("param_name", "param_value")))  # one entry per setting
    t.scraping_config.agg(F.to_json(entries).alias("value")).write.text(path)
    return seeds.settings_seed(spark, path)


def excluded(t: Inputs) -> DataFrame:
    """The exclusion list written as a CSV file and read back."""
    spark = t.exclusions.sparkSession
    path = scratch_path(spark, "exclusions")
    t.exclusions.select("company_name", "id", "title").write.option("header", True).csv(path)
    return seeds.exclusion_list(spark, path)


def exported_csv(t: Inputs) -> DataFrame:
    """Validated records exported as CSV and read back."""
    rows = validate(t.records)
    path = scratch_path(rows.sparkSession, "export")
    export_csv(rows, path)
    back = rows.sparkSession.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("company_name", "id", "url", "title", F.length("article_content").alias("body_chars"))


def activity_with_bad_parameters(t: Inputs) -> DataFrame:
    """Parameters nobody offers fall back to seven days, all users, all types."""
    chosen = activity.report_parameters(activity.active_accounts(t.activity, EVENTS_AS_OF, 30), "many", "nobody", "no type")
    return activity.activity_since(t.activity, EVENTS_AS_OF, *chosen).select("activity_id", "username")


def ordered_day(t: Inputs) -> DataFrame:
    """Report rows with their place in the report's order; a day has a row per company and run."""
    rows = monitor.ordered_rows(day_rows(t)).withColumn("at", F.monotonically_increasing_id())
    return rows.select("company_name", "run_end_ts", F.row_number().over(Window.orderBy("at")).alias("place"))


def queries() -> dict:
    recipes = {
        "source_seed": lambda t: seeds.source_seed(seed_file(t.load_sources.sparkSession, t.load_sources)),
        "config_seed": lambda t: seeds.config_seed(seed_file(t.load_config.sparkSession, t.load_config)),
        "settings_seed": seeded_settings,
        "exclusion_file": excluded,
        "export_csv": exported_csv,
        "activity_bad_parameters": activity_with_bad_parameters,
        "report_ordered": ordered_day,
        "source_unpivot": lambda t: registry.source_urls(t.load_sources),
        "load_config_active": lambda t: registry.active_config(t.load_config, FLOW),
        "settings": lambda t: registry.settings(t.scraping_config),
        "setting_rows": lambda t: registry.setting_rows(t.scraping_config),
        "sector_backfill": lambda t: registry.backfill_sector(t.load_config),
        "flow_rename": lambda t: load.rename_flow(_two_flows(t), "OLD_FLOW", FLOW),
        "run_rename": lambda t: load.rename_runs(t.monitoring, FLOW, "NEXT_FLOW").groupBy("run_name", "company_name").agg(
            F.count("*").alias("runs")
        ),
        "config_to_delta": lambda t: load.switch_to_delta(
            t.load_config.withColumn("load_type", F.upper(F.trim("load_type"))), t.monitoring.where("load_type = 'FULL'"), FLOW
        ),
        "staging_labels": lambda t: staging.staging_tables(t.listing),
        "identifiers": lambda t: t.articles.select(
            "id",
            normalize_identifier(F.col("title")).alias("slug"),
            label_from_name(normalize_identifier(F.col("title"))).alias("label"),
        ),
        "staging_layout": layout_union,
        "staging_union": lambda t: staging.staged_articles(t.articles),
        "staging_dedup": lambda t: staging.first_by_id(t.staged),
        "eligible_articles": lambda t: staging.eligible_articles(t.staged, t.exclusions).select("id", "url", "tablename"),
        "legacy_merge": legacy_merge,
        "validate": lambda t: validate(t.records).drop("article_content"),
        "validation_metrics": run_validation,
        "delta_filter": lambda t: due(t).select(*RECORD_COLUMNS),
        "merge_new": lambda t: new_rows(t).select(*RECORD_COLUMNS),
        "fetch_metrics": lambda t: load.fetch_metrics(attempts(t)),
        "fetch_metrics_overall": lambda t: load.fetch_metrics(attempts(t), per_company=False),
        "monitoring_metrics": metrics,
        "load_run": run_rows,
        "load_run_write_errors": run_rows_with_write_errors,
        "summary_upsert": summary_upsert,
        "source_upsert": source_upsert,
        "purge_bodies": bodies_after_purge,
        "purge_counts": purged_per_sector,
        "last_success": lambda t: load.last_success(t.monitoring, FLOW),
        "report_window": day_rows,
        "report_totals": lambda t: monitor.report_totals(day_rows(t)),
        "report_runs": lambda t: monitor.report_runs(t.monitoring),
        "report_run_companies": lambda t: monitor.report_companies(day_rows(t)),
        "latest_run": lambda t: monitor.latest_run(t.monitoring),
        "recent_runs": lambda t: monitor.recent_runs(t.monitoring, 5),
        "activity_summary": lambda t: activity.activity_summary(t.activity, EVENTS_AS_OF, days=7),
        "activity_of_user": lambda t: activity.activity_summary(
            t.activity, EVENTS_AS_OF, days=30, username="user7", activity_type="ai_chat"
        ),
        "recent_activity": lambda t: activity.recent_activity(t.activity, EVENTS_AS_OF, days=7),
        "active_accounts": lambda t: activity.active_accounts(t.activity, EVENTS_AS_OF, 7),
        "activity_meta": lambda t: activity.meta_fields(t.activity, ["k", "period"]),
        "activity_append": recorded,
        "rate_audit": audit,
        "request_valid": lambda t: valid_requests(t).drop("industry_sector"),
        "request_submit": lambda t: requests.submit_requests(t.requests, AS_OF).drop("request_id"),
        "request_list": lambda t: requests.list_requests(stored_requests(t), "guest", "user7"),
        "request_review": review,
        "request_refused": refused_decisions,
        "request_apply": lambda t: applied(t)["load_sources"],
        "request_apply_config": lambda t: applied(t)["load_config"],
        "request_overflow": lambda t: applied(t)["rejected"].select("request_id", "reject_reason"),
    }
    return {name: on_inputs(fn) for name, fn in recipes.items()}


def _two_flows(t: Inputs) -> DataFrame:
    old = t.load_config.withColumn("flow_name", F.lit("OLD_FLOW"))
    return old.unionByName(t.load_config.where("active_flag = 'Y'"))
