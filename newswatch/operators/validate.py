"""Validation of scraped records and its metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newswatch.functions.text import strip

MIN_TITLE_LENGTH = 10  # fixed value: the default setting


def usable(records: DataFrame, min_title_length: int = MIN_TITLE_LENGTH) -> DataFrame:
    """Rows with a web address and a long enough title, both trimmed (F1); row by row, so also of a stream."""
    clean = records.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in ("url", "title")})
    return clean.where(F.col("url").rlike("^https?://") & (F.length("title") >= min_title_length))


def validate(records: DataFrame, min_title_length: int = MIN_TITLE_LENGTH) -> DataFrame:
    """Clean urls and titles, drop bad rows, keep each url's first arrival.

    Urls are unique across companies. ``seq`` is the arrival order. Of a url
    with very many copies each task passes on one row only.
    """
    order = Window.partitionBy("url").orderBy("seq")
    return usable(records, min_title_length).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def validation_metrics(validated: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """Run totals completed by what validation saw.

    ``run_metrics`` is one row. The mean response time is taken from the rows
    only when the run has none. Urls are unique after validation.
    """
    seen = validated.agg(
        F.count("url").alias("unique_urls"),
        F.count("title").alias("titles"),
        F.avg("response_time_ms").alias("row_avg"),
    )
    # two one-row frames stacked, then folded into one row
    both = run_metrics.unionByName(seen, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    run_avg = F.col("avg_response_time_ms")
    from_rows = F.when(F.coalesce(run_avg, F.lit(0.0)) == 0, F.col("row_avg")).otherwise(run_avg)
    some = F.col("unique_urls") > 0
    return one.select(
        "urls_attempted",
        "urls_fetched",
        F.when(some, F.col("titles")).otherwise(F.col("parse_success_count")).alias("parse_success_count"),
        F.when(some, from_rows).otherwise(run_avg).alias("avg_response_time_ms"),
        "error_count",
        "unique_urls",
    )
