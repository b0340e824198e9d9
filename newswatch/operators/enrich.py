"""Enrichment: extractive summaries, topics, refresh decisions, model replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newswatch.functions.text import (
    IMPACT_CHARS,
    SPACE_CLASS,
    SUMMARY_CHARS,
    blank_to_null,
    content_hash,
    extractive_summary,
    geography,
    moment,
    squash_spaces,
    topic_class,
)

# ---- fixed values ----
FALLBACK_MODEL = "fallback-extractive-v1"
PROMPT_CONTENT_CHARS = 6000
REPLY_FIELDS = ["article_summary", "key_topic", "business_impact", "geography", "signal_type"]
TOPIC_LABELS = ["regulatory", "clinical", "partnership", "manufacturing", "financial", "m&a", "product", "corporate"]
SIGNAL_LABELS = [
    "approval", "trial-readout", "partnership", "plant-expansion", "earnings", "leadership-change", "launch", "acquisition"
]
# ---- end of fixed values ----

PROMPT_VERSION = "nw-v1"
INSTRUCTIONS = (
    "Summarise the article below for a business reader in two to four plain sentences. Answer with one JSON object "
    "with the keys article_summary, key_topic, business_impact, geography and signal_type; use null where nothing fits. "
    f"key_topic is one of: {', '.join(TOPIC_LABELS)}. "
    f"signal_type is a label like: {', '.join(SIGNAL_LABELS)}. "
    "business_impact is one short sentence, geography a country or region."
)

Summarizer = Callable[[Sequence[str]], Sequence[str]]


def model_tag(provider: str, model: str, version: str = PROMPT_VERSION) -> str:
    """The tag stored with a model's summaries."""
    return f"{provider}:{model}:{version}"


def body_hash(body: Column) -> Column:
    """The hash of a squashed body, '' when it holds nothing (X4, X5): what a load keeps beside the body."""
    return F.when(_filled(body), content_hash(squash_spaces(body))).otherwise(F.lit(""))


def _filled(body: Column) -> Column:
    return body.rlike(f"(?U)[^{SPACE_CLASS}]")


def selected(articles: DataFrame, company: str | None = None, limit: int | None = None) -> DataFrame:
    """The articles of a company, or the first ones by id; only ids are sorted."""
    rows = articles if company is None else articles.where(F.upper("company_name") == company.strip().upper())
    return rows if limit is None else rows.join(rows.select("id").orderBy("id").limit(limit), "id", "left_semi")


def due_articles(
    hashed: DataFrame, existing: DataFrame, target_model: str | None = None, company: str | None = None, limit: int | None = None
) -> DataFrame:
    """The articles to summarise, decided on stored hashes alone (E5, E6, J10): no body is read.

    ``hashed`` has ``id``, ``company_name`` and ``content_hash``, '' or NULL for articles without a body.
    """
    rows = selected(hashed, company, limit).where("content_hash <> ''")
    return refresh_decisions(rows, existing, target_model).where("refresh_reason IS NOT NULL").drop("refresh_reason")


def cleaned(articles: DataFrame) -> DataFrame:
    """Articles with squashed title and body, and the body's hash."""
    rows = articles.withColumns(
        {
            "title": squash_spaces(F.coalesce("title", F.lit(""))),
            "content": squash_spaces(F.coalesce("article_content", F.lit(""))),
        }
    ).drop("article_content")
    return rows.withColumn("content_hash", content_hash(F.col("content")))


def structured_summary(company: Column, title: Column, content: Column) -> dict[str, Column]:
    """Rule-based summary fields; all three inputs are squashed already."""
    text = F.trim(F.concat(company, F.lit(". "), title, F.lit(". "), content))
    topic = topic_class(text)
    return {
        "article_summary": extractive_summary(content, SUMMARY_CHARS),
        "key_topic": topic,
        "business_impact": extractive_summary(content, IMPACT_CHARS),
        "geography": geography(text),
        "signal_type": topic,
    }


def with_structured_summary(clean: DataFrame) -> DataFrame:
    """``structured_summary`` as columns of ``cleaned`` rows, body kept."""
    return clean.withColumns(
        structured_summary(squash_spaces(F.coalesce("company_name", F.lit("None"))), F.col("title"), F.col("content"))
    )


def refresh_reason(target_model: str | None) -> Column:
    """Why an article is (re)summarised, NULL when it is not (E5).

    Expects the article's ``content_hash`` and the stored summary's
    ``old_hash``, ``old_status``, ``old_model`` (all NULL without one).
    """
    same = F.col("content_hash") == F.col("old_hash")
    reason = F.when(F.col("old_hash").isNull(), F.lit("new")).when(~same, F.lit("changed"))
    if target_model:
        worse = ~F.col("old_status").eqNullSafe("ai") | ~F.col("old_model").eqNullSafe(target_model)
        reason = reason.when(worse, F.lit("model"))
    return reason


def refresh_decisions(hashed: DataFrame, existing: DataFrame, target_model: str | None = None) -> DataFrame:
    """Rows with content and whether to summarise them again.

    ``hashed`` has ``id`` and ``content_hash``; its other columns travel
    through the join, so callers drop bodies before.
    """
    old = existing.select(
        F.col("article_id").alias("id"),
        F.col("content_hash").alias("old_hash"),
        F.col("summary_status").alias("old_status"),
        F.col("summary_model").alias("old_model"),
    )
    joined = hashed.join(old, "id", "left")
    return joined.withColumn("refresh_reason", refresh_reason(target_model)).drop("old_hash", "old_status", "old_model")


def prompt(company: Column, title: Column, content: Column, chars: int = PROMPT_CONTENT_CHARS) -> Column:
    """The text a model gets; the article is cut to ``chars`` characters."""
    return F.concat(
        F.lit(f"{INSTRUCTIONS}\n\nCompany: "),
        company,
        F.lit("\nTitle: "),
        title,
        F.lit("\nArticle Content:\n"),
        F.substring(content, 1, chars),
    )


def reply_json(reply: Column) -> Column:
    """The JSON object of a reply: all of it, else from the first ``{`` to the last ``}``; NULL if neither."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    text = F.when(F.try_parse_json(reply).isNotNull(), reply).when(F.try_parse_json(inner).isNotNull(), inner)
    return F.when(text.rlike(r"^\s*\{"), text)


def reply_fields(json: Column) -> dict[str, Column]:
    """Squashed fields of a reply; blank ones NULL, a blank summary '' (E8)."""
    fields = {}
    for name in REPLY_FIELDS:
        value = squash_spaces(F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit("")))
        fields[name] = value if name == "article_summary" else blank_to_null(value)
    return fields


def parse_replies(replies: DataFrame) -> DataFrame:
    """Replies as fields; ``parsed`` is false for text without a JSON object."""
    rows = replies.withColumn("json", reply_json(F.col("reply")))
    fields = reply_fields(F.col("json"))
    return rows.select(
        *[c for c in replies.columns if c != "reply"],
        F.col("json").isNotNull().alias("parsed"),
        *[F.when(F.col("json").isNotNull(), fields[name]).alias(name) for name in REPLY_FIELDS],
    )


def _ask(summarizer: Summarizer):
    """Batches of prompts through the user's function; a failed batch is asked row by row."""

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return summarizer([text])[0], None
        except Exception as error:  # noqa: BLE001 - any failure falls back for this row
            return None, str(error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                answers = [(text, None) for text in summarizer(list(batch["prompt"]))]
            except Exception:  # noqa: BLE001
                answers = [one(text) for text in batch["prompt"]]
            replies, errors = zip(*answers, strict=True) if answers else ((), ())
            yield batch.drop(columns="prompt").assign(reply=list(replies), hook_error=list(errors))

    return run


def enrich(
    articles: DataFrame,
    existing: DataFrame,
    as_of,
    summarizer: Summarizer | None = None,
    target_model: str | None = None,
    company: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Summary rows to upsert (E6). Rows with an empty summary are dropped.

    For stored articles ``due_articles`` decides first, so that only their bodies come here.
    Everything that needs the body is computed before the join with the stored
    summaries, so bodies never shuffle. ``summarizer`` maps prompts to replies;
    a failure or an unreadable reply falls back to the rules, with the error.
    ``limit`` takes the first articles by id.
    """
    rows = selected(articles, company, limit)
    # tested on the raw body: a filter on the cleaned one would clean it twice
    clean = with_structured_summary(cleaned(rows.where(_filled(F.col("article_content")))))
    if summarizer is not None:
        clean = clean.withColumn("prompt", prompt(F.col("company_name"), F.col("title"), F.col("content")))
    narrow = clean.select(
        "id", "company_name", "url", "title", "content_hash", *REPLY_FIELDS, *(["prompt"] if summarizer else [])
    )
    due = refresh_decisions(narrow, existing, target_model if summarizer else None)
    due = due.where("refresh_reason IS NOT NULL").drop("refresh_reason")
    if summarizer is None:
        done = due.withColumns(
            {
                "summary_model": F.lit(FALLBACK_MODEL),
                "summary_status": F.lit("fallback"),
                "error_message": F.lit(None).cast("string"),
            }
        )
    else:
        done = _from_replies(due, summarizer, target_model or model_tag("custom", "summarizer"))
    return done.select(
        F.col("id").alias("article_id"),
        "company_name",
        "url",
        blank_to_null(F.col("title")).alias("title"),
        *REPLY_FIELDS,
        "content_hash",
        "summary_model",
        "summary_status",
        "error_message",
        moment(as_of).alias("summarized_at"),
    )


def _from_replies(due: DataFrame, summarizer: Summarizer, tag: str) -> DataFrame:
    schema = due.drop("prompt").schema.add("reply", "string").add("hook_error", "string")
    asked = due.mapInPandas(_ask(summarizer), schema).withColumn("json", reply_json(F.col("reply")))
    ok = F.col("json").isNotNull()
    fields = reply_fields(F.col("json"))
    chosen = {name: F.when(ok, fields[name]).otherwise(F.col(name)) for name in REPLY_FIELDS}
    error = F.coalesce("hook_error", F.lit("the reply holds no JSON object"))
    return asked.withColumns(
        {
            **chosen,
            "summary_model": F.when(ok, F.lit(tag)).otherwise(F.lit(FALLBACK_MODEL)),
            "summary_status": F.when(ok, F.lit("ai")).otherwise(F.lit("fallback")),
            "error_message": F.when(~ok, error),
        }
    ).where("article_summary <> ''")
