"""Company requests: validation, submission, listing, review, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newswatch.functions.text import DEFAULT_SECTOR, INDUSTRY_SECTORS, blank_to_null, moment, squash_spaces, strip
from newswatch.operators.tables import upsert_columns
from newswatch.sources.registry import DEFAULT_LOAD_TYPE, SOURCE_SLOTS

# ---- fixed values ----
MAX_COMPANY_LENGTH = 100
PENDING, APPROVED, REJECTED = "PENDING", "APPROVED", "REJECTED"
NO_NAME = "Company name is required"
LONG_NAME = "Company name is too long"
BAD_URL = "Source URL must start with http:// or https://"
BAD_SECTOR = "Invalid industry sector"
NOT_FOUND = "Request not found"
REVIEWED = "Request has already been reviewed"
SLOTS_FULL = "Company already has five configured sources"
# ---- end of fixed values ----


def known_sector(c: Column) -> Column:
    """Trimmed, upper-cased sector when it is a known one, else NULL; NULL and '' mean the default."""
    sector = F.upper(strip(F.coalesce(blank_to_null(c), F.lit(DEFAULT_SECTOR))))
    return F.when(sector.isin(INDUSTRY_SECTORS), sector)


def validate_requests(raw: DataFrame) -> DataFrame:
    """Normalised input and the first reason to refuse it, NULL when valid."""
    rows = raw.withColumns(
        {
            "company_name": F.upper(squash_spaces(F.coalesce("company_name", F.lit("")))),
            "source_url": strip(F.coalesce("source_url", F.lit(""))),
            "known_sector": known_sector(F.col("industry_sector")),
        }
    )
    reason = (
        F.when(F.col("company_name") == "", NO_NAME)
        .when(F.length("company_name") > MAX_COMPANY_LENGTH, LONG_NAME)
        .when(~F.col("source_url").rlike("^https?://"), BAD_URL)
        .when(F.col("known_sector").isNull(), BAD_SECTOR)
    )
    return rows.withColumn("reject_reason", reason)


def submit_requests(raw: DataFrame, as_of) -> DataFrame:
    """Valid input as PENDING request rows to append."""
    valid = validate_requests(raw).where("reject_reason IS NULL")
    return valid.select(
        F.expr("uuid()").alias("request_id"),
        "company_name",
        F.col("known_sector").alias("requested_industry_sector"),
        "source_url",
        "submitter_username",
        "submitter_role",
        F.lit(PENDING).alias("review_status"),
        F.lit(None).cast("string").alias("reviewer_username"),
        F.lit(None).cast("string").alias("review_note"),
        moment(as_of).alias("requested_ts"),
        F.lit(None).cast("timestamp_ntz").alias("reviewed_ts"),
    )


def list_requests(requests: DataFrame, role: str, username: str) -> DataFrame:
    """All requests for an admin, else the user's own; newest first."""
    rows = requests if role == "admin" else requests.where(F.col("submitter_username") == username)
    return rows.orderBy(F.desc("requested_ts"), "request_id")


def review_decisions(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with their request, and why one cannot be taken.

    ``decisions`` has one row per request: request_id, approved,
    reviewer_username, review_note, industry_sector.
    """
    chosen = decisions.select(
        "request_id",
        "approved",
        F.col("reviewer_username").alias("by"),
        blank_to_null(F.col("review_note")).alias("note"),
        blank_to_null(F.col("industry_sector")).alias("override"),
    )
    joined = chosen.join(requests, "request_id", "left")
    sector = F.when(F.col("override").isNotNull(), known_sector(F.col("override"))).when(
        F.col("approved"), known_sector(F.col("requested_industry_sector"))
    ).otherwise(F.col("requested_industry_sector"))
    rows = joined.withColumn("sector", sector)
    reason = (
        F.when(F.col("review_status").isNull(), NOT_FOUND)
        .when(F.col("review_status") != PENDING, REVIEWED)
        .when(F.col("sector").isNull(), BAD_SECTOR)
    )
    return rows.withColumn("reject_reason", reason)


def reviewed_requests(requests: DataFrame, taken: DataFrame, as_of) -> DataFrame:
    """The request table after the decisions that could be taken."""
    new = taken.where("reject_reason IS NULL").select(
        "request_id",
        F.when(F.col("approved"), APPROVED).otherwise(REJECTED).alias("new_status"),
        F.col("sector").alias("new_sector"),
        "by",
        "note",
    )
    done = F.col("new_status").isNotNull()
    replaced = {
        "review_status": F.col("new_status"),
        "requested_industry_sector": F.col("new_sector"),
        "reviewer_username": F.col("by"),
        "review_note": F.col("note"),
        "reviewed_ts": moment(as_of),
    }
    joined = requests.join(new, "request_id", "left")
    return joined.select(
        *[F.when(done, replaced[c]).otherwise(F.col(c)).alias(c) if c in replaced else F.col(c) for c in requests.columns]
    )


def filled_slots(load_sources: DataFrame) -> DataFrame:
    """(company_name, slot, url) of non-empty slots, renumbered without gaps."""
    raw = F.array(*[F.col(c) for c in SOURCE_SLOTS])
    filled = F.transform(F.filter(raw, lambda u: u.isNotNull() & (u != "")), strip)
    return load_sources.select("company_name", F.posexplode(filled).alias("slot", "url"))


def place_requests(load_sources: DataFrame, approved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approved requests with the slot their url gets, and the refused ones.

    ``approved``: request_id, company_name, sector, source_url, position
    (processing order). A url a company has needs no slot; new urls fill the
    free slots in order of their first request; beyond five they are refused.
    Requests are reduced to distinct urls first, then to five per company, so
    a company with a third of all requests costs no task more than the others.
    """
    existing = filled_slots(load_sources)
    used = existing.groupBy("company_name").agg(F.count("*").alias("used"))
    wanted = approved.groupBy("company_name", F.col("source_url").alias("url")).agg(F.min("position").alias("first"))
    new = wanted.join(existing.select("company_name", "url").distinct(), ["company_name", "url"], "left_anti")
    order = Window.partitionBy("company_name").orderBy("first")
    ranked = new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= len(SOURCE_SLOTS))
    slot = F.coalesce("used", F.lit(0)) + F.col("rank") - 1
    placed = ranked.join(used, "company_name", "left").withColumn("slot", slot).where(F.col("slot") < len(SOURCE_SLOTS))
    slots = existing.unionByName(placed.select("company_name", "slot", "url"))

    accepted_urls = slots.select("company_name", F.col("url").alias("source_url")).distinct()
    keys = ["company_name", "source_url"]
    marked = approved.join(accepted_urls.withColumn("ok", F.lit(True)), keys, "left")
    return slots, marked.withColumn("reject_reason", F.when(F.col("ok").isNull(), SLOTS_FULL)).drop("ok")


def apply_requests(
    load_sources: DataFrame, load_config: DataFrame, approved: DataFrame, flow_name: str, as_of
) -> dict[str, DataFrame]:
    """New source and configuration tables after approved requests.

    A company touched by an accepted request gets compact slots, the sector of
    its last accepted request, an active configuration row, and keeps its load
    type.
    """
    slots, marked = place_requests(load_sources, approved)
    accepted = marked.where("reject_reason IS NULL")
    touched = accepted.groupBy("company_name").agg(F.max_by("sector", "position").alias("industry_sector"))
    pivoted = slots.groupBy("company_name").agg(
        *[F.max(F.when(F.col("slot") == i, F.col("url"))).alias(name) for i, name in enumerate(SOURCE_SLOTS)]
    )
    sources = touched.join(pivoted, "company_name")
    current = load_config.where(F.col("flow_name") == flow_name).select("company_name", "load_type")
    kept_type = F.coalesce(F.when(F.col("load_type") != "", blank_to_null(F.trim("load_type"))), F.lit(DEFAULT_LOAD_TYPE))
    config = touched.join(current, "company_name", "left").select(
        F.lit(flow_name).alias("flow_name"),
        "company_name",
        kept_type.alias("load_type"),
        F.lit("Y").alias("active_flag"),
        "industry_sector",
    )
    return {
        "load_sources": upsert_columns(load_sources, sources, ["company_name"], moment(as_of)),
        "load_config": upsert_columns(load_config, config, ["flow_name", "company_name"], moment(as_of)),
        "rejected": marked.where("reject_reason IS NOT NULL"),
    }
