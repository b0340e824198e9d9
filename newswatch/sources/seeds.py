"""Seed files: CSV sources and configuration, JSON settings, exclusion lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newswatch.functions.text import DEFAULT_SECTOR, blank_to_null, strip

# ---- fixed values ----
SETTING_NOTES = {
    "MAX_ITEMS_PER_SOURCE": "Maximum articles to fetch per source",
    "MAX_WORKERS": "Maximum worker threads for scraping",
    "LISTING_SLEEP_SEC": "Delay between listing page requests",
    "ARTICLE_SLEEP_SEC": "Delay between article requests",
    "REQUEST_TIMEOUT_SEC": "Per-request timeout in seconds",
    "MIN_TITLE_LENGTH": "Minimum accepted article title length",
    "EXPORT_RESULTS": "Whether to export the latest validated CSV",
}
SOURCE_HEADER = ["COMPANY_NAME", "INDUSTRY_SECTOR", "SOURCE_1", "SOURCE_2", "SOURCE_3", "SOURCE_4", "SOURCE_5"]
CONFIG_HEADER = ["COMPANY_NAME", "FLOW_NAME", "LOAD_TYPE", "ACTIVE_FLAG", "INDUSTRY_SECTOR"]
# ---- end of fixed values ----


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every field as text."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _text(raw: DataFrame, name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit(""))) if name in raw.columns else F.lit("")


def _sector(raw: DataFrame) -> Column:
    return F.coalesce(blank_to_null(F.upper(_text(raw, "INDUSTRY_SECTOR"))), F.lit(DEFAULT_SECTOR))


def source_seed(raw: DataFrame) -> DataFrame:
    """Rows for the source registry: trimmed, blank slots NULL, nameless rows dropped."""
    slots = [blank_to_null(_text(raw, name)).alias(name.lower()) for name in SOURCE_HEADER[2:]]
    rows = raw.select(_text(raw, "COMPANY_NAME").alias("company_name"), _sector(raw).alias("industry_sector"), *slots)
    return rows.where("company_name <> ''")


def config_seed(raw: DataFrame) -> DataFrame:
    """Rows for the load configuration; flow and company are required."""
    rows = raw.select(
        _text(raw, "FLOW_NAME").alias("flow_name"),
        _text(raw, "COMPANY_NAME").alias("company_name"),
        blank_to_null(_text(raw, "LOAD_TYPE")).alias("load_type"),
        blank_to_null(_text(raw, "ACTIVE_FLAG")).alias("active_flag"),
        _sector(raw).alias("industry_sector"),
    )
    return rows.where("flow_name <> '' AND company_name <> ''")


def settings_seed(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object as (param_name, param_value, description) rows."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>", {"allowSingleQuotes": "false"})
    notes = F.create_map(*[F.lit(x) for pair in SETTING_NOTES.items() for x in pair])
    rows = text.select(F.explode(entries).alias("param_name", "param_value"))
    return rows.withColumn("description", F.try_element_at(notes, F.col("param_name")))


def seed_if_empty(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """The stored table, or the seed when the table has no rows."""
    return seed if stored.isEmpty() else stored


def exclusion_list(spark: SparkSession, path: str) -> DataFrame:
    """Excluded articles from a CSV of company_name, id, title."""
    schema = "company_name string, id string, title string"
    return spark.read.option("header", True).option("multiLine", True).schema(schema).csv(path)
