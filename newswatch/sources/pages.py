"""Stored page snapshots in place of page fetches.

A snapshot table has one row per url. Stored bucketed by url, it is joined
without moving page texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable() -> Column:
    """Status below 400 and an HTML content type (S12); never NULL."""
    html = F.lower(F.coalesce("content_type", F.lit(""))).contains("text/html")
    return F.coalesce((F.col("status_code") < 400) & html, F.lit(False))


def usable_pages(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(is_usable())


def fetch_log(snapshots: DataFrame) -> DataFrame:
    """One attempt per snapshot with the outcome and time."""
    return snapshots.select("url", is_usable().alias("fetched"), "response_time_ms")
