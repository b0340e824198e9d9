"""Registered enrichment queries: whole article texts, every article."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newswatch.functions.text import content_hash, extractive_summary, geography, squash_spaces, topic_class
from newswatch.operators import enrich
from newswatch.plans.queries_load import Inputs
from newswatch.sources.driver_tables import AS_OF

MODEL = "local:model:v1"


def on_texts(fn):
    return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))


def full_text(t: Inputs) -> DataFrame:
    text = F.concat("company_name", F.lit(". "), "title", F.lit(". "), "article_content")
    return t.articles.select("id", squash_spaces(text).alias("text"))


def decisions(t: Inputs, model: str | None) -> DataFrame:
    hashed = enrich.cleaned(t.articles).select("id", "content_hash")
    return enrich.refresh_decisions(hashed, t.summary_hashes, model)


def stub_model(prompts):
    """Replies by the number in the title: JSON, an error, or prose without JSON."""
    replies = []
    for text in prompts:
        number = int(re.search(r"^Title: .*?([0-9]+)$", text, re.MULTILINE)[1])
        if number % 3 == 1:
            raise ValueError("no answer")
        good = f'{{"article_summary": "Model text {number}", "key_topic": "product", "geography": "Europe", "signal_type": "launch"}}'
        replies.append(good if number % 3 == 0 else "no object here")
    return replies


def queries() -> dict:
    recipes = {
        "extractive_summary": lambda t: t.articles.select(
            "id", extractive_summary(squash_spaces(F.col("article_content"))).alias("summary")
        ),
        "topic_class": lambda t: full_text(t).select("id", topic_class(F.col("text")).alias("topic")),
        "geography": lambda t: full_text(t).select("id", geography(F.col("text")).alias("geography")),
        "content_hash": lambda t: t.articles.select(
            "id", content_hash(squash_spaces(F.col("article_content"))).alias("content_hash")
        ),
        "structured_summary": lambda t: enrich.with_structured_summary(enrich.cleaned(t.articles)).select(
            "id", *enrich.REPLY_FIELDS
        ),
        "refresh_decision": lambda t: decisions(t, None),
        "refresh_decision_model": lambda t: decisions(t, MODEL),
        "reply_parse": lambda t: enrich.parse_replies(t.replies),
        "prompt_text": lambda t: enrich.cleaned(t.articles).select(
            "id", F.sha2(enrich.prompt(F.col("company_name"), F.col("title"), F.col("content")), 256).alias("prompt_hash")
        ),
        "enrich_model_batch": lambda t: enrich.enrich(
            t.articles, t.summary_hashes, AS_OF, stub_model, enrich.model_tag("local", "model", "v1")
        ),
        "enrich_batch": lambda t: enrich.enrich(t.articles, t.summary_hashes, AS_OF),
    }
    return {name: on_texts(fn) for name, fn in recipes.items()}
