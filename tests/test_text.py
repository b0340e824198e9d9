"""Column functions against plain Python models on random and edge input."""

import hashlib
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newswatch.functions import text

WORDS = ["The", "board", "approval", "Remain", "study", "Phase", "France", "global", "plant", "x y", "a.b", "Sales!", "ok?", "1", "é", "\x1f"]


def texts(n=300):
    rng = random.Random(7)
    seps = [" ", "  ", ". ", "! ", "\n", "\t ", "? ", ". "]
    return ["".join(rng.choice(WORDS) + rng.choice(seps) for _ in range(rng.randrange(0, 60))) for _ in range(n)] + ["", " ", "."]


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def squash(v):
    return re.sub(r"\s+", " ", v).strip()


def summary(v, limit):
    clean = squash(v)
    found = " ".join(re.split(r"(?<=[.!?])\s+", clean)[:2]).strip()
    return found if len(found) <= limit else found[: limit - 3].rstrip() + "..."


def test_squash_and_hash(spark):
    values = texts()
    assert column(spark, values, text.squash_spaces) == [squash(v) for v in values]
    got = column(spark, values, lambda c: text.content_hash(text.squash_spaces(c)))
    assert got == [hashlib.sha256(squash(v).encode()).hexdigest() for v in values]


@pytest.mark.parametrize("limit", [40, 260, 700])
def test_summary(spark, limit):
    values = texts()
    got = column(spark, values, lambda c: text.extractive_summary(text.squash_spaces(c), limit))
    assert got == [summary(v, limit) for v in values]


def test_topic_and_geography(spark):
    values = texts()

    def topic(v):
        return next((t for t, ws in text.TOPIC_KEYWORDS if any(w in v.lower() for w in ws)), text.DEFAULT_TOPIC)

    assert column(spark, values, text.topic_class) == [topic(v) for v in values]
    places = [next((g for g in text.GEOGRAPHIES if g.lower() in v.lower()), None) for v in values]
    assert column(spark, values, text.geography) == places


def test_identifiers(spark):
    names = ["Ceva Santé", "3M Company", "", "__A--b__", "x" * 200, "ÉCOLE", "a.b c"]
    slugs = column(spark, names, text.normalize_identifier)
    assert slugs == ["ceva_sant", "x_3m_company", "x_", "a_b", "x" * 128, "cole", "a_b_c"]
    assert column(spark, ["Life Science"], text.staging_name) == ["stg_life_science"]
    assert column(spark, ["STG_air_space", "other"], text.label_from_name) == ["AIR SPACE", "OTHER"]
    assert column(spark, [None, " ", " banking "], text.normalize_sector) == ["LIFESCIENCE", "LIFESCIENCE", "BANKING"]


def test_dates(spark):
    values = ["2024-05-01", "2024-05-01T10:00:00Z", "2024-05-01 10:00:00+02:00", "2024-05-01T10:00", "2024-13-01", "soon", "2024", None, "2024-05-01T10:00:00.250+00:00"]
    got = column(spark, values, text.parse_utc)
    day = datetime(2024, 5, 1)
    ten = day.replace(hour=10)
    assert got == [day, ten, day.replace(hour=8), ten, None, None, None, None, ten.replace(microsecond=250000)]
    assert column(spark, ["2024-05-01", None], lambda c: text.date_label(text.parse_utc(c))) == ["2024-05-01", ""]


def test_dates_do_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = column(spark, ["2024-03-10T02:30:00Z", "2024-03-10"], text.parse_utc)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10)]


def test_priority_rules_are_ordered(spark):
    rows = [
        ("approval", "clinical", "x", 95),
        ("launch", "regulatory", "x", 88),
        ("partnership", "partnership", "x", 80),
        (None, "product", "FDA", 72),
        (None, None, "Phase 3 and FDA", 84),
        ("", "", "fda notice", 90),
        (None, "corporate", "Acquisition", 92),
        (None, None, "earnings", 90),
        (None, None, None, 55),
    ]
    df = spark.createDataFrame(rows, "s string, t string, title string, want int")
    score = text.priority_score(F.col("s"), F.col("t"), F.col("title"))
    assert df.where(score != F.col("want")).count() == 0
    bands = spark.sql("SELECT explode(array(95, 90, 89, 75, 74, 60, 59)) AS s").select(text.priority_band(F.col("s")))
    assert [r[0] for r in bands.collect()] == ["critical", "critical", "high", "high", "medium", "medium", "standard"]


def test_half_up_rounding_and_links(spark):
    assert spark.range(1).select(text.round_half_up(F.lit(72.25))).head()[0] == 72.3
    assert column(spark, ["https://a", "HTTP://a", "ftp://a", None], text.safe_url) == ["https://a", "", "", ""]
