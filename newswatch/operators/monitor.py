"""Daily monitoring report: window, totals, runs, companies, latest run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----
REPORT_ZONE = "Europe/Paris"
ERROR_STYLE = "background: #fee2e2; color: #7f1d1d;"
INSERT_STYLE = "background: #dcfce7; color: #14532d;"
EMPTY_DAY = "No rows were found in the load monitoring table for this report day."
# ---- end of fixed values ----

COUNTS = ["records_inserted", "urls_attempted", "urls_fetched", "parse_success_count", "error_count"]


def day_bounds(day: str, zone: str = REPORT_ZONE) -> tuple[Column, Column]:
    """First and last microsecond of a local day in UTC."""

    def utc(clock: str) -> Column:
        return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.lit(f"{day} {clock}").cast("timestamp_ntz"))

    return utc("00:00:00"), utc("23:59:59.999999")


def report_rows(monitoring: DataFrame, day: str, zone: str = REPORT_ZONE) -> DataFrame:
    """Monitoring rows that ended on the local day, counts never NULL.

    The bounds fold to constants, so the range reaches the scan.
    """
    start, end = day_bounds(day, zone)
    rows = monitoring.where((F.col("run_end_ts") >= start) & (F.col("run_end_ts") <= end))
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS})


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Latest end first, then company (K5)."""
    return rows.orderBy(F.desc("run_end_ts"), "company_name")


def report_totals(rows: DataFrame) -> DataFrame:
    """One row of totals (A16); runs are counted by grouping on them first."""
    run = F.nullif("run_id", F.lit(""))
    per_run = rows.groupBy(run.alias("run_id")).agg(
        F.count("*").alias("n"),
        F.sum("records_inserted").alias("inserted"),
        F.sum("error_count").alias("errors"),
        F.count_if(F.col("run_status") == "SUCCESS").alias("good"),
        F.count_if(~F.col("run_status").eqNullSafe("SUCCESS")).alias("bad"),
    )

    def total(name: str, alias: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(alias)

    return per_run.agg(
        total("n", "row_count"),
        total("inserted", "total_inserted"),
        total("errors", "total_errors"),
        total("good", "successful_rows"),
        total("bad", "failed_rows"),
        F.count("run_id").alias("run_count"),
    )


def report_runs(rows: DataFrame) -> DataFrame:
    """Per run: status, companies and insertions."""
    good = F.every(F.col("run_status").eqNullSafe("SUCCESS"))
    return rows.groupBy("run_id").agg(
        F.when(good, F.lit("SUCCESS")).otherwise(F.lit("FAILED")).alias("run_status"),
        F.count("*").alias("companies"),
        F.sum("records_inserted").alias("records_inserted"),
    )


def report_companies(rows: DataFrame) -> DataFrame:
    """Company table of each run in company order, with a highlight."""
    style = (
        F.when(F.col("error_count") != 0, F.lit(ERROR_STYLE))
        .when(F.col("records_inserted") != 0, F.lit(INSERT_STYLE))
        .otherwise(F.lit(""))
    )
    table = rows.select("run_id", "company_name", "run_status", "load_type", *COUNTS, style.alias("row_style"))
    return table.orderBy("run_id", "company_name")


def report(monitoring: DataFrame, day: str, zone: str = REPORT_ZONE) -> dict[str, DataFrame]:
    """The daily report as tables (C4). ``notice`` has a row only when the day is empty."""
    rows = report_rows(monitoring, day, zone)
    totals = report_totals(rows)
    return {
        "totals": totals,
        "runs": report_runs(rows),
        "companies": report_companies(rows),
        "notice": totals.where("row_count = 0").select(F.lit(EMPTY_DAY).alias("notice")),
    }


def latest_run(monitoring: DataFrame) -> DataFrame:
    """The monitoring row that ended last (K8)."""
    columns = ["run_id", "run_name", "company_name", "run_status", "records_inserted", "run_end_ts"]
    return monitoring.select(*columns).orderBy(F.desc("run_end_ts"), "company_name").limit(1)


def recent_runs(monitoring: DataFrame, n: int) -> DataFrame:
    """The ``n`` runs that ended last (K8)."""
    ends = monitoring.groupBy("run_id").agg(F.max("run_end_ts").alias("run_end_ts"))
    return ends.orderBy(F.desc("run_end_ts"), "run_id").limit(n)
