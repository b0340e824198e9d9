"""SQL oracle of the enrichment queries."""

from __future__ import annotations

from newswatch.plans.oracle_load import with_tables
from newswatch.sources.driver_tables import AS_OF

# ---- fixed values, written out once more so that a wrong word in the code turns a row red ----
KEYWORDS = {
    "regulatory": "approval fda ema authorized regulatory clearance label",
    "clinical": "trial phase study efficacy safety patient clinical",
    "partnership": "partnership collaboration alliance license agreement",
    "manufacturing": "manufacturing plant facility production capacity supply",
    "financial": "revenue earnings results guidance sales investor",
    "m&a": "acquisition acquire merger divest spin-off",
    "product": "launch product portfolio brand device",
}
PLACES = [
    "Global", "United States", "Europe", "France", "Germany", "United Kingdom", "India", "China", "Japan", "Canada", "Brazil"
]
INSTRUCTIONS = (
    "Summarise the article below for a business reader in two to four plain sentences. Answer with one JSON object "
    "with the keys article_summary, key_topic, business_impact, geography and signal_type; use null where nothing fits. "
    "key_topic is one of: regulatory, clinical, partnership, manufacturing, financial, m&a, product, corporate. "
    "signal_type is a label like: approval, trial-readout, partnership, plant-expansion, earnings, leadership-change, "
    "launch, acquisition. business_impact is one short sentence, geography a country or region."
)
# ---- end of fixed values ----

CLEAN = r"""clean AS (SELECT *, trim(regexp_replace(article_content, '\s+', ' ', 'g')) AS content,
       trim(regexp_replace(concat(company_name, '. ', title, '. ', article_content), '\s+', ' ', 'g')) AS text FROM articles)"""


def summary(limit: int) -> str:
    # no look-behind in this dialect: mark the sentence ends, split on the mark
    marked = r"regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g')"
    text = f"trim(array_to_string(string_split({marked}, chr(1))[1:2], ' '))"
    return f"CASE WHEN length({text}) > {limit} THEN concat(rtrim({text}[1:{limit - 3}]), '...') ELSE {text} END"


TOPIC = (
    "CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words.split()) + f" THEN '{topic}'"
        for topic, words in KEYWORDS.items()
    )
    + " ELSE 'corporate' END"
)
PLACE = "CASE " + " ".join(f"WHEN contains(lower(text), '{g.lower()}') THEN '{g}'" for g in PLACES) + " END"
FIELDS = (
    f"{summary(700)} AS article_summary, {TOPIC} AS key_topic, {summary(260)} AS business_impact, "
    f"{PLACE} AS geography, {TOPIC} AS signal_type"
)


def reason(model: str | None) -> str:
    extra = f" WHEN h.summary_status <> 'ai' OR h.summary_model <> '{model}' THEN 'model'" if model else ""
    return (
        "CASE WHEN h.content_hash IS NULL THEN 'new' WHEN h.content_hash <> c.content_hash THEN 'changed'" f"{extra} END"
    )


HASHED = "hashed AS (SELECT *, sha256(content) AS content_hash FROM clean)"


def _decision(model: str | None) -> str:
    return with_tables(
        "articles summary_hashes",
        f"""SELECT c.id, c.content_hash, {reason(model)} AS refresh_reason
FROM hashed AS c LEFT JOIN summary_hashes AS h ON h.article_id = c.id""",
        CLEAN,
        HASHED,
    )


def oracle() -> dict[str, str]:
    def over_clean(columns: str) -> str:
        return with_tables("articles", f"SELECT id, {columns} FROM clean", CLEAN)

    def field(name: str) -> str:
        value = f"trim(coalesce(json_extract_string(js, '$.{name}'), ''))"
        return f"CASE WHEN js IS NOT NULL THEN {value if name == 'article_summary' else f"nullif({value}, '')"} END AS {name}"

    names = ["article_summary", "key_topic", "business_impact", "geography", "signal_type"]
    return {
        "extractive_summary": over_clean(f"{summary(700)} AS summary"),
        "topic_class": over_clean(f"{TOPIC} AS topic"),
        "geography": over_clean(f"{PLACE} AS geography"),
        "content_hash": over_clean("sha256(content) AS content_hash"),
        "structured_summary": over_clean(FIELDS),
        "refresh_decision": _decision(None),
        "refresh_decision_model": _decision("local:model:v1"),
        "reply_parse": with_tables(
            "replies",
            f"SELECT article_id, js IS NOT NULL AS parsed, {', '.join(field(n) for n in names)} FROM objects",
            r"""objects AS (SELECT article_id, CASE WHEN json_valid(reply) THEN reply
     WHEN json_valid(regexp_extract(reply, '(?s)\{.*\}')) THEN regexp_extract(reply, '(?s)\{.*\}') END AS js FROM replies)""",
        ),
        "prompt_text": over_clean(
            f"sha256(concat('{INSTRUCTIONS}', chr(10), chr(10), 'Company: ', company_name, chr(10), 'Title: ', title, "
            "chr(10), 'Article Content:', chr(10), content[1:6000])) AS prompt_hash"
        ),
        "enrich_model_batch": with_tables(
            "articles summary_hashes",
            f"""SELECT article_id, company_name, url, title, CASE k WHEN 0 THEN concat('Model text ', article_id) ELSE article_summary END
       AS article_summary, CASE k WHEN 0 THEN 'product' ELSE key_topic END AS key_topic,
       CASE WHEN k <> 0 THEN business_impact END AS business_impact, CASE k WHEN 0 THEN 'Europe' ELSE geography END AS geography,
       CASE k WHEN 0 THEN 'launch' ELSE signal_type END AS signal_type, content_hash,
       CASE k WHEN 0 THEN 'local:model:v1' ELSE 'fallback-extractive-v1' END AS summary_model,
       CASE k WHEN 0 THEN 'ai' ELSE 'fallback' END AS summary_status,
       CASE k WHEN 1 THEN 'no answer' WHEN 2 THEN 'the reply holds no JSON object' END AS error_message,
       TIMESTAMP '{AS_OF}' AS summarized_at
FROM (SELECT c.id AS article_id, c.company_name, c.url, c.title, {FIELDS}, c.content_hash, CAST(c.id AS BIGINT) % 3 AS k
      FROM hashed AS c LEFT JOIN summary_hashes AS h ON h.article_id = c.id
      WHERE content <> '' AND {reason("local:model:v1")} IS NOT NULL)""",
            CLEAN,
            HASHED,
        ),
        "enrich_batch": with_tables(
            "articles summary_hashes",
            f"""SELECT c.id AS article_id, c.company_name, c.url, c.title, {FIELDS}, c.content_hash,
       'fallback-extractive-v1' AS summary_model, 'fallback' AS summary_status, CAST(NULL AS VARCHAR) AS error_message,
       TIMESTAMP '{AS_OF}' AS summarized_at
FROM hashed AS c LEFT JOIN summary_hashes AS h ON h.article_id = c.id
WHERE content <> '' AND {reason(None)} IS NOT NULL""",
            CLEAN,
            HASHED,
        ),
    }
