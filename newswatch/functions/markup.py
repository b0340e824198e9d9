"""Column functions over page source: title, dates, main text, embedded JSON."""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from newswatch.functions import dom
from newswatch.functions.dom import DATE_METAS, JSONLD_TYPE
from newswatch.functions.text import once, parse_utc, squash_spaces, strip

# ---- fixed values ----
MAX_TEXT_CHARS = 50_000
MIN_TEXT_CHARS = 50
DATE_SCAN_CHARS = 200_000
# the word boundary is looked for after the literal, which is far cheaper to find
ISO_DATE = r"20(?iU)(?<=\b20)\d{2}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})?)?\b"
# ---- end of fixed values ----

# Named entities decoded in place; a page with any other goes through the page reader.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " ", "amp": "&"}

_ENTITY_NAMES = "|".join(ENTITIES)
_OTHER_ENTITY = rf"&(?!(?:{_ENTITY_NAMES});)[a-zA-Z#]"
# comments, and elements whose content does not count; the look-ahead skips fast over text
_CODE = r"(?is)(?=<[!s])(?:<!--.*?-->|<(script|style)(?=[\s/>])[^>]*>.*?</\1\s*>)"
_ASIDES = r"(?is)(?=<[nhfa])<(nav|header|footer|aside)(?=[\s/>])[^>]*>.*?</\1\s*>"
# three article tags or more
_MANY_ARTICLES = r"(?is)</?article(?=[\s/>]).*</?article(?=[\s/>]).*</?article(?=[\s/>])"
_LEFTOVER = r"(?i)</?(?:script|style|nav|header|footer|aside)(?=[\s/>])"
_SPECIAL = r"(?i)</?(?:template|rt|rp|textarea|title|iframe|noembed|noframes|xmp|plaintext)(?=[\s/>])|<!\[CDATA"
_ARTICLE = r"(?is)<article(?:\s[^>]*)?(?<!/)>(.*?)</article\s*>"
# a tag whose quotes are still open at its first '>'
_BROKEN_TAG = r"""<[a-zA-Z][^<>"']*(?:(?:"[^"<>]*"|'[^'<>]*')[^<>"']*)*(?:"[^"<>]*|'[^'<>]*)>"""
_TAG = r"(?s)</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>"


def decode_entities(c: Column) -> Column:
    """The common named entities as characters, the ampersand last."""
    text = c
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.when(c.contains("&"), text).otherwise(c)


@F.pandas_udf(StringType())
def _decode_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: dom.decode(t) if isinstance(t, str) else None)


@F.pandas_udf(StringType())
def _decode_value(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unescape(v) if isinstance(v, str) else None)


@F.pandas_udf(StringType())
def _tree_text(pages: pd.Series) -> pd.Series:
    return pages.map(lambda html: dom.article_text(html) if isinstance(html, str) else None)


READING = (
    StructType().add("title", StringType()).add("shared_title", StringType()).add("dates", ArrayType(StringType())).add("text", StringType())
)


def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


def _attribute_pattern(name: str) -> str:
    return rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _meta_pattern(key: str, value: str) -> str:
    exact = value.replace(".", r"\.")
    return rf"""(?is)<meta\s(?:[^>]*\s)?{key}\s*=\s*(?-i:["']?{exact}["']?)(?=[\s/>])[^>]*>"""


_TITLE = r"(?is)<title(?=[\s>])[^>]*>(.*?)</title\s*>"
_TIME = r"(?is)<time(?=[\s>])[^>]*>.*?</time\s*>"
_OPENING = r"(?s)^<[^>]*>"


def _odd_page(html: str) -> dom.Reading:
    """The fields of a page that is not of ordinary tags: by the same patterns as columns, and by the tree."""
    head = _python(_CODE).sub(" ", html)

    def content(tag: str) -> str:
        m = _python(_attribute_pattern("content")).search(tag)
        return next((g for g in m.groups() if g is not None), "") if m else ""

    def meta(key: str, value: str) -> str:
        m = _python(_meta_pattern(key, value)).search(head)
        return content(m[0]) if m else ""

    title, shown = _python(_TITLE).search(head), _python(_TIME).search(head)
    inner = title[1] if title and not re.search("<[a-zA-Z/!]", title[1]) else ""
    shared = unescape(meta("property", "og:title"))
    time = content(_python(_OPENING).match(shown[0])[0]) or _python(_TAG).sub("", shown[0]) if shown else ""
    dates = [*(meta(*key) for key in DATE_METAS), time]
    return dom.Reading(dom.decode(inner), shared, dates, dom.article_text(html))


_READING = pa.struct([("title", pa.string()), ("shared_title", pa.string()), ("dates", pa.list_(pa.string())), ("text", pa.string())])


@F.arrow_udf(READING)
def _one_pass(pages: pa.Array) -> pa.Array:
    """Title, dates and main text of each page, read once."""

    def fields(html: str | None) -> dict:
        if html is None:
            return {}
        found = dom.one_pass(html) or _odd_page(html)
        return {"title": found.title, "shared_title": found.shared_title, "dates": found.dates, "text": found.text}

    read = [pa.array(list(map(fields, pages[a:b].to_pylist())), _READING) for a, b in dom.pieces(pages)]
    return pa.concat_arrays(read) if read else pa.array([], _READING)


# Keeps later filters above the step, so that no page is parsed once for the
# filter and once more for the column.
_decode_text = _decode_text.asNondeterministic()
_decode_value = _decode_value.asNondeterministic()
_tree_text = _tree_text.asNondeterministic()
_one_pass = _one_pass.asNondeterministic()


def decoded(c: Column, value: bool = False) -> Column:
    """A text, or an attribute value, with all entities decoded; Python sees only those with uncommon ones."""
    odd = F.when(c.rlike(_OTHER_ENTITY), c)
    return F.coalesce(_decode_value(odd) if value else _decode_text(odd), decode_entities(c))


def without_code(html: Column) -> Column:
    """Comments, scripts and styles replaced by a blank."""
    return F.regexp_replace(html, _CODE, " ")


def article_segment(body: Column) -> Column:
    """Source inside the first article element, '' when there is none."""
    return F.regexp_extract(body, _ARTICLE, 1)


def without_asides(code_free: Column) -> Column:
    """Navigation, header, footer and aside elements replaced by a blank."""
    return F.regexp_replace(code_free, _ASIDES, " ")


def segment_text(segment: Column) -> Column:
    """Text of a piece of source: tags removed, common entities decoded, squashed."""
    return squash_spaces(decode_entities(F.regexp_replace(segment, _TAG, " ")))


def is_plain(html: Column, body: Column, segment: Column, text: Column) -> Column:
    """Whether patterns alone give the article text.

    Not when there is no article element or more than one, when dropped
    elements are unbalanced, when a tag or an entity is unusual, when an end
    tag would close the article early, or when the text is short.
    """
    return (
        (segment != "")
        & (F.length(text) >= dom.MIN_BODY_CHARS)
        & ~html.rlike(_MANY_ARTICLES)
        & ~body.rlike(_LEFTOVER)
        & ~segment.rlike(_SPECIAL)
        & ~body.rlike(_BROKEN_TAG)
        & ~segment.rlike(_OTHER_ENTITY)
        & closes_itself(segment)
    )


def closes_itself(segment: Column) -> Column:
    """No end tag in the text lacks a start tag before it."""
    tags = F.transform(F.regexp_extract_all(segment, F.lit("</?[a-zA-Z][a-zA-Z0-9]*"), F.lit(0)), F.lower)
    ends = F.array_distinct(F.filter(tags, lambda t: t.startswith("</")))

    def stays_open(end: Column) -> Column:
        start = F.concat(F.lit("<"), F.substr(end, F.lit(3)))
        # open elements of this name so far; -1 for good once an end had none
        depth = F.aggregate(
            tags,
            F.lit(0),
            lambda n, t: F.when(n < 0, n).when(t == end, n - 1).when(t == start, n + 1).otherwise(n),
        )
        return depth >= 0

    return F.forall(ends, stays_open)


def with_page_fields(pages: DataFrame, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """Add ``page_title``, ``page_date`` and ``page_text`` (H1, H2), from one pass over the source.

    Needs ``html``, which is dropped. Python hands back short texts only; dates are parsed, and the
    source searched for one where none is named, by expressions.
    """
    read = pages.withColumn("reading", _one_pass(F.col("html")))
    title = F.coalesce(*[F.nullif(strip(F.col(f"reading.{c}")), F.lit("")) for c in ("title", "shared_title")])
    dates = [F.get("reading.dates", F.lit(k)) for k in range(len(DATE_METAS) + 1)]
    date = F.coalesce(first_date(dates), first_date([F.substring("html", 1, DATE_SCAN_CHARS)]))
    read = read.withColumns({"page_title": title, "page_date": date, "page_text": F.substring(squash_spaces(F.col("reading.text")), 1, max_chars)})
    read = read.withColumn("page_text", F.when(F.length("page_text") > MIN_TEXT_CHARS, F.col("page_text")))
    return once(read.drop("reading", "html"), "page_title", "page_date", "page_text")


def with_main_text(pages: DataFrame, max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """Add ``page_text``, the article text, NULL unless longer than 50 characters (H1).

    Needs ``html`` and ``code_free``. Regular pages stay in the JVM; Python
    gets NULL for them and reads only the others. Each step is a projection of
    its own, so no pattern runs twice.
    """
    steps = pages.withColumn("body", without_asides(F.col("code_free")))
    steps = steps.withColumn("segment", article_segment(F.col("body")))
    steps = steps.withColumn("plain", segment_text(F.col("segment")))
    plain = is_plain(F.col("html"), F.col("body"), F.col("segment"), F.col("plain"))
    steps = steps.withColumn("plain", F.when(plain, F.col("plain"))).drop("body", "segment")
    steps = steps.withColumn("read", _tree_text(F.when(F.col("plain").isNull(), F.col("html"))))
    text = F.coalesce(F.col("plain"), squash_spaces(F.col("read")))
    steps = steps.withColumn("page_text", F.substring(text, 1, max_chars)).drop("plain", "read")
    return steps.withColumn("page_text", F.when(F.length("page_text") > MIN_TEXT_CHARS, F.col("page_text")))


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag's source, '' when missing."""
    return F.concat(*[F.regexp_extract(tag, _attribute_pattern(name), i) for i in (1, 2, 3)])


def meta_content(code_free: Column, key: str, value: str) -> Column:
    """Content of the first meta tag with the attribute, '' when missing."""
    return attribute(F.regexp_extract(code_free, _meta_pattern(key, value), 0), "content")


def page_title(head: Column) -> Column:
    """The title element when it holds text only, else the og:title, of code-free source (H2)."""
    inner = F.regexp_extract(head, _TITLE, 1)
    title = F.when(~inner.rlike("<[a-zA-Z/!]"), F.nullif(strip(decoded(inner)), F.lit("")))
    shared = F.nullif(strip(decoded(meta_content(head, "property", "og:title"), value=True)), F.lit(""))
    return F.coalesce(title, shared)


def first_date(texts: list[Column]) -> Column:
    """The first readable ISO date of each text in turn, as a UTC timestamp."""
    found = F.filter(F.transform(F.array(*texts), lambda t: F.regexp_extract(t, ISO_DATE, 0)), lambda d: d != "")
    dates = F.transform(found, lambda d: parse_utc(F.regexp_replace(d, r"(?i)^(.{10})[T\s]", "$1T")))
    return F.try_element_at(F.array_compact(dates), F.lit(1))


def page_date(head: Column, html: Column) -> Column:
    """Publication date from the known tags in order, else the first date in the source (H2)."""
    candidates = [meta_content(head, key, value) for key, value in DATE_METAS]
    time = F.regexp_extract(head, _TIME, 0)
    opening = F.regexp_extract(time, _OPENING, 0)
    shown = F.regexp_replace(time, _TAG, "")
    candidates.append(F.coalesce(F.nullif(attribute(opening, "content"), F.lit("")), shown))
    return F.coalesce(first_date(candidates), first_date([F.substring(html, 1, DATE_SCAN_CHARS)]))


def jsonld_texts(html: Column) -> Column:
    """Texts of the embedded JSON-LD scripts in order; comments and other scripts are passed over."""
    kind = JSONLD_TYPE.replace("+", r"\+")
    typed = rf"""(?i:type)\s*=\s*(?:"{kind}"|'{kind}'|{kind}(?=[\s>]))"""
    script = rf"<(?i:script)\s(?:[^>]*\s)?{typed}[^>]*>(.*?)</(?i:script)\s*>"
    pattern = rf"(?s)(?=<[!sS])(?:<!--.*?-->|{script}|<(?i:script)(?=[\s>]).*?</(?i:script)\s*>)"
    return F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda t: t != "")
