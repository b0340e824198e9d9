"""Incremental load: cutoffs, the DELTA filter, first-wins merge, run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswatch.functions.text import DEFAULT_SECTOR, moment, parse_utc, staging_name
from newswatch.sources.registry import DEFAULT_LOAD_TYPE

# ---- fixed values ----
SUCCESS = "SUCCESS"
FAILURE = "FAILURE"
LOADED_MESSAGE = "Data loaded successfully"
FAILED_MESSAGE = "Source scrape failed before any valid records were parsed"
# ---- end of fixed values ----

COUNTERS = ["urls_attempted", "urls_fetched", "parse_success_count", "error_count"]


def last_success(monitoring: DataFrame, flow_name: str) -> DataFrame:
    """End of each company's latest successful run of a flow."""
    done = monitoring.where((F.col("run_name") == flow_name) & (F.col("run_status") == SUCCESS))
    return done.groupBy("company_name").agg(F.max("run_end_ts").alias("last_success"))


def with_load_config(rows: DataFrame, config: DataFrame) -> DataFrame:
    """Add load type and sector; companies without active config are FULL, default sector."""
    known = config.select("company_name", F.col("load_type"), F.col("industry_sector"))
    return rows.join(known, "company_name", "left").withColumns(
        {
            "load_type": F.coalesce("load_type", F.lit(DEFAULT_LOAD_TYPE)),
            "industry_sector": F.coalesce("industry_sector", F.lit(DEFAULT_SECTOR)),
        }
    )


def is_later(published: Column, cutoff: Column) -> Column:
    """True without a cutoff, without a readable date, or strictly after the cutoff."""
    return cutoff.isNull() | published.isNull() | (published > cutoff)


def delta_filter(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Drop rows of DELTA companies that are not after the company's cutoff.

    ``rows`` carry ``load_type`` and an ISO text ``published_date``; the date is
    returned as a UTC timestamp.
    """
    dated = rows.withColumn("published_date", parse_utc(F.col("published_date"))).join(cutoffs, "company_name", "left")
    cutoff = F.when(F.col("load_type") == "DELTA", F.col("last_success"))
    return dated.where(is_later(F.col("published_date"), cutoff)).drop("last_success")


def rows_to_insert(batch: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of the batch whose url a company does not have yet, first one wins (M1).

    Existing rows are never changed. The join keys are unique on both sides,
    so no key is hot.
    """
    keys = ["industry_sector", "company_name", "url"]
    order = Window.partitionBy(*keys).orderBy("seq")
    firsts = batch.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    return firsts.join(target.select(*keys), keys, "left_anti")


def fetch_metrics(log: DataFrame, per_company: bool = True) -> DataFrame:
    """Counters and mean response time of a fetch log, per company or overall.

    A log row has ``attempted``, ``fetched``, ``parsed`` (booleans) and a
    response time, NULL when there was none. What was not fetched is an error.
    """
    groups = ["company_name"] if per_company else []
    return log.groupBy(*groups).agg(
        F.count_if(F.col("attempted")).alias("urls_attempted"),
        F.count_if(F.col("fetched")).alias("urls_fetched"),
        F.count_if(F.col("parsed")).alias("parse_success_count"),
        F.count_if(~F.col("fetched")).alias("error_count"),
        F.coalesce(F.avg("response_time_ms"), F.lit(0.0)).alias("avg_response_time_ms"),
    )


def monitoring_metrics(companies: DataFrame, eligible: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per-company counts of what was eligible after the DELTA filter.

    Response time is the rows' mean, else the fetch log's; errors come from the
    log. Urls are counted once by grouping on them first.
    """
    per_url = eligible.groupBy("company_name", "url").agg(
        F.count("*").alias("n"), F.sum("response_time_ms").alias("ms"), F.count("response_time_ms").alias("n_ms")
    )
    rows = per_url.groupBy("company_name").agg(
        F.sum("n").alias("eligible"), F.count("url").alias("urls"), F.try_divide(F.sum("ms"), F.sum("n_ms")).alias("mean")
    )
    log = metrics.select("company_name", "error_count", F.col("avg_response_time_ms").alias("log_avg"))
    count = F.coalesce("eligible", F.lit(0))
    mean = F.when(F.coalesce("mean", F.lit(0.0)) != 0, F.col("mean")).otherwise(F.coalesce("log_avg", F.lit(0.0)))
    return (
        companies.select("company_name")
        .distinct()
        .join(rows, "company_name", "left")
        .join(log, "company_name", "left")
        .select(
            "company_name",
            count.alias("urls_attempted"),
            count.alias("urls_fetched"),
            count.alias("parse_success_count"),
            mean.alias("avg_response_time_ms"),
            F.coalesce("error_count", F.lit(0)).alias("error_count"),
            F.coalesce("urls", F.lit(0)).alias("unique_urls"),
        )
    )


def monitoring_rows(
    metrics: DataFrame, config: DataFrame, inserted: DataFrame, flow_name: str, run_id: str, ended_at,
    write_errors: DataFrame | None = None,
) -> DataFrame:
    """One monitoring row per company of the run.

    A company fails when it has no eligible row and its sources had errors, or when its rows could not be
    stored: ``write_errors`` holds (company_name, write_error). ``inserted`` holds (company_name, records_inserted).
    """
    failed = (F.col("urls_attempted") == 0) & (F.col("error_count") > 0)
    rows = with_load_config(metrics, config).join(inserted, "company_name", "left")
    if write_errors is None:
        rows = rows.withColumn("write_error", F.lit(None).cast("string"))
    else:
        rows = rows.join(write_errors.select("company_name", "write_error"), "company_name", "left")
    unstored = F.col("write_error").isNotNull()
    return rows.select(
        F.lit(run_id).alias("run_id"),
        F.lit(flow_name).alias("run_name"),
        "company_name",
        staging_name(F.col("industry_sector")).alias("target_schema"),
        staging_name(F.col("company_name")).alias("target_table"),
        "load_type",
        F.when(failed | unstored, F.lit(FAILURE)).otherwise(F.lit(SUCCESS)).alias("run_status"),
        F.when(failed, F.lit(FAILED_MESSAGE)).otherwise(F.coalesce("write_error", F.lit(LOADED_MESSAGE))).alias("run_message"),
        F.when(unstored, 0).otherwise(F.coalesce("records_inserted", F.lit(0))).cast("bigint").alias("records_inserted"),
        "urls_attempted",
        "urls_fetched",
        "parse_success_count",
        "avg_response_time_ms",
        "error_count",
        moment(ended_at).alias("run_start_ts"),
        moment(ended_at).alias("run_end_ts"),
    )


def switch_to_delta(load_config: DataFrame, succeeded: DataFrame, flow_name: str) -> DataFrame:
    """FULL companies that succeeded load incrementally next time (M5).

    Every other column keeps its value.
    """
    done = succeeded.select("company_name").distinct().withColumn("done", F.lit(True))
    turn = F.col("done") & (F.col("flow_name") == flow_name) & (F.col("load_type") == "FULL")
    rows = load_config.join(done, "company_name", "left")
    return rows.withColumn("load_type", F.when(turn, F.lit("DELTA")).otherwise(F.col("load_type"))).select(
        *load_config.columns
    )


def rename_flow(load_config: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a flow where the company has no row under the new name."""
    taken = load_config.where(F.col("flow_name") == new).select("company_name").distinct()
    taken = taken.withColumn("taken", F.lit(True))
    free = (F.col("flow_name") == old) & F.col("taken").isNull()
    rows = load_config.join(taken, "company_name", "left")
    return rows.withColumn("flow_name", F.when(free, F.lit(new)).otherwise(F.col("flow_name"))).select(
        *load_config.columns
    )


def rename_runs(monitoring: DataFrame, old: str, new: str) -> DataFrame:
    """Rename a flow in the run history, without exception."""
    return monitoring.withColumn(
        "run_name", F.when(F.col("run_name") == old, F.lit(new)).otherwise(F.col("run_name"))
    )
