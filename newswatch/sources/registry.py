"""Source registry, load configuration and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.functions.text import normalize_sector, strip

# ---- fixed values ----
SOURCE_SLOTS = ["source_1", "source_2", "source_3", "source_4", "source_5"]
DEFAULT_LOAD_TYPE = "FULL"
SETTING_DEFAULTS = {
    "MAX_ITEMS_PER_SOURCE": "25",
    "MAX_WORKERS": "8",
    "LISTING_SLEEP_SEC": "0.2",
    "ARTICLE_SLEEP_SEC": "0.15",
    "REQUEST_TIMEOUT_SEC": "25",
    "MIN_TITLE_LENGTH": "10",
    "EXPORT_RESULTS": "true",
}
SETTING_TYPES = {
    "MAX_ITEMS_PER_SOURCE": "int",
    "MAX_WORKERS": "int",
    "LISTING_SLEEP_SEC": "double",
    "ARTICLE_SLEEP_SEC": "double",
    "REQUEST_TIMEOUT_SEC": "int",
    "MIN_TITLE_LENGTH": "int",
    "EXPORT_RESULTS": "boolean",
}
TRUE_WORDS = ["true", "1", "yes", "on"]
# ---- end of fixed values ----


def source_urls(load_sources: DataFrame) -> DataFrame:
    """One row per (company, url) of the filled http(s) slots.

    Of repeated pairs the sector of the first slot stays.
    """
    slots = F.array(*[F.col(c) for c in SOURCE_SLOTS])
    rows = load_sources.select(
        strip(F.coalesce("company_name", F.lit(""))).alias("company_name"),
        normalize_sector(F.col("industry_sector")).alias("industry_sector"),
        F.posexplode(slots).alias("slot", "raw_url"),
    ).withColumn("url", strip(F.col("raw_url")))
    kept = rows.where((F.col("company_name") != "") & F.col("url").rlike("^https?://"))
    first = F.min(F.struct("slot", "industry_sector"))
    return (
        kept.groupBy("company_name", "url")
        .agg(first.alias("first"))
        .select("company_name", F.col("first.industry_sector").alias("industry_sector"), "url")
    )


def active_config(load_config: DataFrame, flow_name: str) -> DataFrame:
    """Active companies of one flow with their load type and sector."""
    rows = load_config.where((F.col("flow_name") == flow_name) & (F.upper("active_flag") == "Y"))
    return rows.select(
        strip(F.col("company_name")).alias("company_name"),
        load_type(F.col("load_type")).alias("load_type"),
        normalize_sector(F.col("industry_sector")).alias("industry_sector"),
    ).where("company_name <> ''")


def load_type(c: Column) -> Column:
    """Upper-cased load type; NULL and blank mean FULL."""
    return F.coalesce(F.nullif(F.upper(strip(c)), F.lit("")), F.lit(DEFAULT_LOAD_TYPE))


def typed(c: Column, kind: str) -> Column:
    """A setting's text as its type; unreadable numbers raise, as a wrong setting should."""
    if kind == "boolean":
        return F.lower(strip(c)).isin(TRUE_WORDS)
    return strip(c).cast(kind)


def settings(scraping_config: DataFrame) -> DataFrame:
    """One row with the seven typed settings, stored values over defaults (S3)."""
    stored = scraping_config.agg(
        *[F.max(F.when(F.col("param_name") == name, F.col("param_value"))).alias(name) for name in SETTING_DEFAULTS]
    )
    return stored.select(
        *[
            typed(F.coalesce(name, F.lit(default)), SETTING_TYPES[name]).alias(name)
            for name, default in SETTING_DEFAULTS.items()
        ]
    )


def setting_rows(scraping_config: DataFrame) -> DataFrame:
    """All settings as text: stored rows, and defaults for names not stored (S3)."""
    defaults = scraping_config.sparkSession.createDataFrame(
        list(SETTING_DEFAULTS.items()), "param_name string, param_value string"
    )
    missing = defaults.join(scraping_config, "param_name", "left_anti")
    return scraping_config.select("param_name", "param_value").unionByName(missing)


def settings_or_file(scraping_config: DataFrame, file_rows: DataFrame) -> DataFrame:
    """Stored settings, or the file's rows when nothing is stored (S3)."""
    return file_rows if scraping_config.isEmpty() else scraping_config


def backfill_sector(table: DataFrame) -> DataFrame:
    """NULL and blank sectors become the default; others stay as written."""
    from newswatch.functions.text import DEFAULT_SECTOR

    blank = F.col("industry_sector").isNull() | (F.trim("industry_sector") == "")
    return table.withColumn("industry_sector", F.when(blank, F.lit(DEFAULT_SECTOR)).otherwise(F.col("industry_sector")))
