"""Text, label, date and score column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: must equal the published rules for equal results ----
DEFAULT_SECTOR = "LIFESCIENCE"
INDUSTRY_SECTORS = [
    "LIFESCIENCE",
    "BANKING",
    "TELECOMMUNICATION",
    "ENERGY",
    "DEFENSE",
    "AIR",
    "SPACE",
    "TRANSPORT",
]
TOPIC_KEYWORDS = [
    ("regulatory", ["approval", "fda", "ema", "authorized", "regulatory", "clearance", "label"]),
    ("clinical", ["trial", "phase", "study", "efficacy", "safety", "patient", "clinical"]),
    ("partnership", ["partnership", "collaboration", "alliance", "license", "agreement"]),
    ("manufacturing", ["manufacturing", "plant", "facility", "production", "capacity", "supply"]),
    ("financial", ["revenue", "earnings", "results", "guidance", "sales", "investor"]),
    ("m&a", ["acquisition", "acquire", "merger", "divest", "spin-off"]),
    ("product", ["launch", "product", "portfolio", "brand", "device"]),
]
DEFAULT_TOPIC = "corporate"
GEOGRAPHIES = [
    "Global",
    "United States",
    "Europe",
    "France",
    "Germany",
    "United Kingdom",
    "India",
    "China",
    "Japan",
    "Canada",
    "Brazil",
]
# (column, values or title keyword, score), first match wins
PRIORITY_RULES = [
    ("signal", ["approval", "acquisition", "merger", "trial-readout", "earnings"], 95),
    ("topic", ["regulatory", "m&a", "financial"], 88),
    ("signal", ["partnership", "plant-expansion", "launch"], 80),
    ("topic", ["clinical", "partnership", "manufacturing", "product"], 72),
    ("title", "phase 3", 84),
    ("title", "fda", 90),
    ("title", "acquisition", 92),
    ("title", "earnings", 90),
]
DEFAULT_PRIORITY = 55
PRIORITY_BANDS = [(90, "critical"), (75, "high"), (60, "medium")]
DEFAULT_BAND = "standard"
ATTENTION_LEVELS = [(3, "high"), (1, "medium")]
DEFAULT_ATTENTION = "watch"
HIGH_PRIORITY = 75
SUMMARY_CHARS = 700
IMPACT_CHARS = 260
# ---- end of fixed values ----

# Unicode white space as regular expressions over text usually understand it:
# the White_Space property plus the four ASCII separators.
SPACE_CLASS = r"\s\x1c-\x1f"
SPACE = f"(?U)[{SPACE_CLASS}]"
_ISO_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})$"


def first_match(rules, otherwise) -> Column:
    """``rules`` is a list of (condition, value); the first true one wins."""
    head, *tail = rules
    chain = reduce(lambda acc, rule: acc.when(*rule), tail, F.when(*head))
    return chain.otherwise(otherwise)


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, f"(?U)^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$", "")


def squash_spaces(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def or_uncategorized(c: Column) -> Column:
    """NULL or '' become 'uncategorized' (F15)."""
    return F.coalesce(blank_to_null(c), F.lit("uncategorized"))


def normalize_sector(c: Column) -> Column:
    """Upper-cased, trimmed sector; NULL and blank become the default."""
    return F.coalesce(blank_to_null(F.upper(strip(c))), F.lit(DEFAULT_SECTOR))


def normalize_identifier(c: Column) -> Column:
    """A safe table identifier: lower case, digits, single underscores."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    safe = F.when(slug.rlike("^[a-z]"), slug).otherwise(F.concat(F.lit("x_"), slug))
    return F.substring(safe, 1, 128)


def staging_name(c: Column) -> Column:
    """``stg_<identifier>`` for a sector or company label."""
    return F.concat(F.lit("stg_"), normalize_identifier(c))


def label_from_name(c: Column) -> Column:
    """The upper-cased label behind a ``stg_`` name."""
    return F.upper(F.replace(F.regexp_replace(c, "(?i)^stg_", ""), F.lit("_"), F.lit(" ")))


def content_hash(c: Column) -> Column:
    """SHA-256 in hex of the UTF-8 text."""
    return F.sha2(c, 256)


def safe_url(c: Column) -> Column:
    """The url when it has an http(s) scheme, else '' (X12)."""
    return F.when(c.rlike("^https?://"), c).otherwise(F.lit(""))


def date_label(c: Column) -> Column:
    """``YYYY-MM-DD``, '' for NULL."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def parse_utc(c: Column) -> Column:
    """ISO text to a zone-less UTC timestamp; text without a zone is UTC.

    NULL for anything that is not a full ISO date. Independent of the session
    time zone.
    """
    full = F.regexp_replace(strip(c), r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00Z")
    timed = F.regexp_replace(full, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?![:\d])", "$1:00")
    zoned = F.regexp_replace(timed, r"^(.{10}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)$", "$1Z")
    return utc_ntz(F.try_to_timestamp(F.regexp_extract(zoned, _ISO_ZONED, 0)))


def utc_ntz(c: Column) -> Column:
    """A zone-aware timestamp as zone-less UTC."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def round_half_up(c: Column, digits: int = 1) -> Column:
    """Half-up rounding on the decimal value, as DOUBLE."""
    return F.round(c.cast("decimal(18,6)"), digits).cast("double")


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(word) for word in words])


def topic_class(c: Column) -> Column:
    """The first topic with a keyword in the text, else the default."""
    lowered = F.lower(c)
    return first_match(
        [(contains_any(lowered, words), F.lit(topic)) for topic, words in TOPIC_KEYWORDS], F.lit(DEFAULT_TOPIC)
    )


def geography(c: Column) -> Column:
    """The first listed place whose name is in the text, else NULL."""
    lowered = F.lower(c)
    return first_match([(lowered.contains(name.lower()), F.lit(name)) for name in GEOGRAPHIES], F.lit(None))


def extractive_summary(clean: Column, max_chars: int = SUMMARY_CHARS) -> Column:
    """The first two sentences of white-space-squashed text, cut to a limit.

    The split stops after the second sentence, so a long body is not cut up.
    """
    sentences = F.slice(F.split(clean, r"(?<=[.!?])\s+", 3), 1, 2)
    text = F.trim(F.array_join(sentences, " "))
    cut = F.concat(F.rtrim(F.substring(text, 1, max_chars - 3)), F.lit("..."))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def priority_score(signal: Column, topic: Column, title: Column) -> Column:
    """Rule-based priority, first match wins."""
    values = {
        "signal": F.coalesce(signal, F.lit("")),
        "topic": F.coalesce(topic, F.lit("")),
        "title": F.lower(F.coalesce(title, F.lit(""))),
    }
    rules = [
        (values[name].contains(what) if name == "title" else values[name].isin(what), F.lit(score))
        for name, what, score in PRIORITY_RULES
    ]
    return first_match(rules, F.lit(DEFAULT_PRIORITY))


def priority_band(score: Column) -> Column:
    """Band label of a priority score (F8)."""
    return first_match([(score >= low, F.lit(label)) for low, label in PRIORITY_BANDS], F.lit(DEFAULT_BAND))


def attention_level(high_count: Column) -> Column:
    """Attention label of a company's high-priority count."""
    return first_match([(high_count >= low, F.lit(label)) for low, label in ATTENTION_LEVELS], F.lit(DEFAULT_ATTENTION))


def meta_field(c: Column, name: str) -> Column:
    """One field of a JSON text column."""
    return F.get_json_object(c, f"$.{name}")


def moment(as_of) -> Column:
    """An explicit reporting time (text or datetime) as a zone-less literal."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these columns behind a step that no filter passes.

    A filter on a computed column is else moved below it and computes it again, as often as it names it.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names)))).select(*df.columns)
