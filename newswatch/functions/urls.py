"""Url column functions: resolving, parts, article-like test."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newswatch.functions.text import strip

# ---- fixed values ----
SKIP_EXTENSIONS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".jpg", ".jpeg", ".png", ".gif"]
PAGINATION_KEYS = ["l", "o", "cat", "page", "pagenum", "offset", "sort"]
SHARED_NETWORK = ".orange.fr"
# (host contains, path pattern, text must be longer than)
HOST_RULES = [
    ("alliance-healthcare.com", r"/magazine/|/newsroom/press-releases/", -1),
    ("sebia.com", r"/ressources/", 10),
    ("eurofins.com", r"/media-centre/press-releases/\d{4}-\d{2}-\d{2}/?$", -1),
    ("newsroom.viatris.com", r"/20\d{2}-\d{2}-\d{2}-", -1),
    ("delpharm.com", r"/article/", -1),
    ("ceva.com", r"/press-release/|/wildlife-research-fund/", -1),
    ("hsbc.com", r"/news-and-views/views/hsbc-views/.+|/news-and-views/news/media-releases/.+", -1),
]
SHARED_NETWORK_PATH = r"/.+-cnt[0-9a-z]+\.html$"
ARTICLE_PATHS = [
    r"/news/",
    r"/news-and-views/",
    r"/press-release",
    r"/article/",
    r"/story/",
    r"/post/",
    r"/media-centre/press-releases/\d{4}-\d{2}-\d{2}",
    r"/magazine/",
    r"/ressources/",
    r"/20\d{2}-\d{2}-\d{2}-",
]
ARTICLE_WORDS = ["press", "news", "article", "release"]
# (host contains, same path with this query key, or path pattern)
EXTRA_LISTINGS = [
    ("newsroom.viatris.com", "o", None),
    ("eurofins.com", None, r"/media-centre/press-releases-\d{4}/?$"),
    ("ceva.com", "cat", None),
]
# ---- end of fixed values ----

_SITE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*"
# no white space, empty query or fragment, dot segment or parameter
_CLEAN_TAIL = r"(?:\?[^\s?#][^\s#]*)?(?:#\S+)?$"
_CLEAN_ABSOLUTE = rf"^https?://[^\s/?#]+(?:/[^\s?#;]*)?{_CLEAN_TAIL}"
_CLEAN_ROOTED = rf"^/(?![/.])[^\s?#;]*{_CLEAN_TAIL}"


def site(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, _SITE, 0)


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    """The path without query, fragment and last-segment parameters."""
    whole = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(whole, ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def query_keys(url: Column) -> Column:
    """Keys of the query's filled parameters; blank values do not count."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p.rlike("(?s)^[^=]*=.+"))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    return F.transform(keys, lambda k: F.coalesce(F.try_url_decode(k), k))


def no_trailing_slash(c: Column) -> Column:
    return F.regexp_replace(c, "/+$", "")


@F.pandas_udf(StringType())
def _urljoin(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    def join(base, href):
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    return pd.Series([join(b, h) if isinstance(h, str) else None for b, h in zip(bases, hrefs, strict=True)], dtype=object)


# keeps filters on the result above it: no link is resolved twice
_urljoin = _urljoin.asNondeterministic()


def resolve(base: Column, href: Column) -> Column:
    """The absolute url of a link (H5). Python joins only what is not plainly absolute or rooted."""
    rooted = href.rlike(_CLEAN_ROOTED) & ~href.contains("/.")
    absolute = href.rlike(_CLEAN_ABSOLUTE)
    native = F.when(absolute, href).when(rooted, F.concat(site(base), href))
    odd = ~F.coalesce(absolute | (rooted & base.isNotNull()), F.lit(False))  # where native is NULL
    return F.coalesce(native, _urljoin(F.when(odd, base), F.when(odd, href)))


def normalize(base: Column, href: Column) -> Column:
    """The resolved link with a doubled base path taken out once (H5)."""
    full = resolve(base, href)
    prefix = no_trailing_slash(path(base))
    doubled = (prefix != "") & path(full).startswith(F.concat(prefix, prefix))
    head = site(full)
    rest = F.substr(full, F.length(head) + F.length(prefix) + 1)
    return F.when(doubled, F.concat(head, rest)).otherwise(full)


def article_like(url: Column, base: Column, text: Column, parts: dict[str, Column] | None = None) -> Column:
    """Whether a link of a listing page leads to an article (H6); ``parts`` are the host and path of both, if there are columns of them."""
    own = parts or {"host": host(url), "base_host": host(base), "path": path(url), "base_path": path(base)}
    name, base_name = F.lower(own["host"]), F.lower(own["base_host"])
    shared = name.endswith(SHARED_NETWORK) & base_name.endswith(SHARED_NETWORK)
    lowered = no_trailing_slash(F.lower(own["path"]))
    keys = query_keys(url)
    pages_only = (F.size(keys) > 0) & F.forall(keys, lambda k: k.isin(PAGINATION_KEYS))
    skipped = reduce(lambda a, b: a | b, [F.lower(url).endswith(e) for e in SKIP_EXTENSIONS])
    rule = F.when(~url.rlike("^(?i)http") | ((own["host"] != own["base_host"]) & ~shared), False)
    rule = rule.when(skipped | pages_only, False)
    rule = rule.when(no_trailing_slash(own["path"]) == no_trailing_slash(own["base_path"]), False)
    for part, pattern, longer_than in HOST_RULES:
        rule = rule.when(name.contains(part), lowered.rlike(pattern) & (F.length(strip(text)) > longer_than))
    rule = rule.when(name.endswith(SHARED_NETWORK), lowered.rlike(SHARED_NETWORK_PATH))
    words = reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in ARTICLE_WORDS])
    return rule.otherwise(lowered.rlike("|".join(ARTICLE_PATHS)) | words)


def extra_listing(url: Column, base: Column) -> Column:
    """Whether a link is a further listing page of a site that splits its list (H7)."""
    name = F.lower(host(base))
    same_path = no_trailing_slash(path(url)) == no_trailing_slash(path(base))
    rule = F.when((host(url) != host(base)) | (url == base), False)
    for part, key, pattern in EXTRA_LISTINGS:
        hit = same_path & F.array_contains(query_keys(url), key) if key else F.lower(path(url)).rlike(pattern)
        rule = rule.when(name.contains(part), hit)
    return rule.otherwise(False)
