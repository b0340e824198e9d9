"""From stored pages to article records: links, embedded items, candidates, fields."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from newswatch.functions import dom
from newswatch.functions.markup import jsonld_texts, with_page_fields
from newswatch.functions.text import once, parse_utc
from newswatch.functions.urls import article_like, extra_listing, host, normalize, path, resolve
from newswatch.operators.load import is_later
from newswatch.operators.robots import fetch_decisions
from newswatch.sources.pages import is_usable

# ---- fixed values ----
MAX_ITEMS = 25
MAX_EXTRA_PAGES = 12
ITEM_TYPES = ["newsarticle", "article", "blogposting", "report"]
# link address tests after the nine containers: all parts inside, and an ending
ADDRESS_SELECTORS = [
    (["/press-release/"], ""),
    (["/news-and-views/"], ""),
    (["/media-centre/press-releases/20"], ""),
    (["/magazine/"], ""),
    (["/ressources/"], ""),
    (["/article/"], ""),
    (["CNT"], ".html"),
    (["20", "-", "Viatris"], ""),
    (["20", "-"], ""),
]
# ---- end of fixed values ----

GRAPH_DEPTH = 2  # levels of nested item graphs read by expressions; texts with more go to a reader without limit
ITEM = (
    "`@type` string, mainEntityOfPage string, url string, headline string, name string, "
    "datePublished string, dateCreated string"
)
_CONTAINERS = 1 + len(dom.LISTING_CLASSES)


def page_fields(pages: DataFrame) -> DataFrame:
    """Title, date and main text of article pages (H1, H2)."""
    return with_page_fields(pages)


READS = "url string, anchors array<struct<pos: bigint, href: string, text: string, container: bigint>>, items array<string>, odd boolean"


def page_reads(pages: DataFrame) -> DataFrame:
    """(url, anchors, items, odd): the links and JSON-LD texts of (url, html) rows, from one pass over each page (H3, H4).

    The links of an ``odd`` page come from the element tree; its items are NULL and left to a pattern.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b[x:y] for b in batches for x, y in dom.pieces(b.column(1))):
            rows = [(url, html) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if html]
            found = [dom.one_pass(html, fields=False) for _, html in rows]
            links = [dom.tree_anchors(html) if f is None else f.anchors for f, (_, html) in zip(found, rows, strict=True)]
            ends = pa.array(np.cumsum([0, *map(len, links)]), pa.int32())
            parts = list(zip(*[a for own in links for a in own], strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            entries = pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(parts, kinds, strict=True)], ["pos", "href", "text", "container"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([url for url, _ in rows], pa.string()), pa.ListArray.from_arrays(ends, entries),
                 pa.array([None if f is None else f.items for f in found], pa.list_(pa.string())), pa.array([f is None for f in found])],
                ["url", "anchors", "items", "odd"],
            )

    return pages.select("url", "html").mapInArrow(read, READS)


def page_anchors(pages: DataFrame) -> DataFrame:
    """(url, pos, href, text, container) of every link of (url, html) rows (H4)."""
    return anchors_of(page_reads(pages))


def anchors_of(reads: DataFrame) -> DataFrame:
    """The links of ``page_reads``, one row each."""
    return reads.select("url", F.inline("anchors"))


def selector_rank(href: Column, container: Column) -> Column:
    """Rank of the first selector a link matches, NULL for none (H4)."""
    rules = [
        (reduce(lambda a, b: a & b, [href.contains(p) for p in parts]) & href.endswith(end), _CONTAINERS + i)
        for i, (parts, end) in enumerate(ADDRESS_SELECTORS)
    ]
    head, *tail = rules
    address = reduce(lambda acc, rule: acc.when(*rule), tail, F.when(*head))
    return F.coalesce(container, address)


def listing_links(anchors: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Article links of listing pages: (page_url, n, url), the first ``max_items`` (H4, H5, H6).

    Ordered by selector, then position. Repeated links are reduced before the
    ranking, and each task passes on at most ``max_items`` per page.
    """
    rows = anchors.withColumn("rank", selector_rank(F.col("href"), F.col("container"))).where("rank IS NOT NULL")
    rows = once(rows.withColumn("full", normalize(F.col("url"), F.col("href"))), "full").where("full IS NOT NULL")
    parts = {"host": host(F.col("full")), "base_host": host(F.col("url")), "path": path(F.col("full")), "base_path": path(F.col("url"))}
    rows = once(rows.withColumns(parts), *parts)
    kept = rows.where(article_like(F.col("full"), F.col("url"), F.col("text"), {name: F.col(name) for name in parts}))
    first = kept.groupBy(F.col("url").alias("page_url"), F.col("full").alias("url")).agg(
        F.min(F.struct("rank", "pos")).alias("place")
    )
    order = Window.partitionBy("page_url").orderBy("place")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_items).select("page_url", "n", "url")


def extra_listing_pages(anchors: DataFrame, max_pages: int = MAX_EXTRA_PAGES) -> DataFrame:
    """Further listing pages: (page_url, n, url) (H7)."""
    rows = once(anchors.withColumn("full", normalize(F.col("url"), F.col("href"))), "full")
    kept = rows.where(extra_listing(F.col("full"), F.col("url")))
    first = kept.groupBy(F.col("url").alias("page_url"), F.col("full").alias("url")).agg(F.min("pos").alias("place"))
    order = Window.partitionBy("page_url").orderBy("place")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_pages).select("page_url", "n", "url")


@F.pandas_udf(ArrayType(StringType()))
def _all_nodes(texts: pd.Series) -> pd.Series:
    """The objects of JSON texts and the nodes of their graphs, however deep, in order."""

    def nodes(text: str) -> list[str] | None:
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return None
        found, waiting = [], list(reversed(value)) if isinstance(value, list) else [value]
        while waiting:
            node = waiting.pop()
            found.append(node if isinstance(node, str) else json.dumps(node, ensure_ascii=False))
            graph = node.get("@graph") if isinstance(node, dict) else None
            waiting.extend(reversed(graph) if isinstance(graph, list) else ())
        return found

    return texts.map(lambda t: nodes(t) if isinstance(t, str) else None)


def _get(obj: Column, key: str) -> Column:
    """A filled field of a JSON object's text; '' and missing are NULL."""
    return F.nullif(F.get_json_object(obj, f"$['{key}']"), F.lit(""))


def _elements(text: Column) -> Column:
    """The elements of a JSON array as texts, empty for anything else."""
    options = {"allowSingleQuotes": "false"}
    array = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>", options))
    return F.coalesce(array, F.array().cast("array<string>"))


def _with_graph(obj: Column, depth: int = GRAPH_DEPTH) -> Column:
    """An object and the nodes of its graph, in order."""
    if depth == 0:
        return F.array(obj)
    return F.concat(F.array(obj), F.flatten(F.transform(_elements(_get(obj, "@graph")), lambda n: _with_graph(n, depth - 1))))


def jsonld_items(pages: DataFrame, reads: DataFrame | None = None) -> DataFrame:
    """Article items of embedded JSON-LD: (page_url, n, url, title, published_date) (H3).

    ``reads`` are the ``page_reads`` of the pages, if there are any already; of odd pages a pattern finds the scripts. A script holds one object, a list, or a graph. Items of another host are left out.
    Graphs nested deeper than expressions unfold go to a reader; a node's fields are parsed once.
    """
    if reads is None:
        found = pages.select("url", jsonld_texts(F.col("html")).alias("items"))
    else:
        odd = pages.join(reads.where("odd").select("url"), "url", "left_semi").select("url", jsonld_texts(F.col("html")).alias("items"))
        found = reads.where("NOT odd").select("url", "items").unionByName(odd)
    blocks = found.select(F.col("url").alias("page_url"), F.posexplode("items").alias("block", "json"))
    valid = blocks.where(F.try_parse_json(F.col("json")).isNotNull())
    text = F.ltrim(F.col("json"))
    levels = (F.length(text) - F.length(F.replace(text, F.lit('"@graph"'), F.lit("")))) / len('"@graph"')
    deep = levels > GRAPH_DEPTH
    objects = F.when(
        text.startswith("["), F.flatten(F.transform(_elements(text), lambda o: _with_graph(o)))
    ).otherwise(_with_graph(text))
    read = valid.withColumn("deep", _all_nodes(F.when(deep, F.col("json"))))
    nodes = read.select(
        "page_url", "block", F.posexplode(F.coalesce("deep", F.when(~deep, objects))).alias("node", "obj")
    ).select("page_url", "block", "node", F.from_json("obj", ITEM, {"allowSingleQuotes": "false"}).alias("obj"))

    def field(name: str) -> Column:
        return F.nullif(F.col(f"obj.`{name}`"), F.lit(""))

    kind = field("@type")
    first_kind = F.when(kind.startswith("["), F.try_element_at(_elements(kind), F.lit(1))).otherwise(kind)
    page = F.from_json("obj.mainEntityOfPage", "`@id` string, url string", {"allowSingleQuotes": "false"})
    nodes = nodes.withColumn("page", page)
    inner = F.coalesce(F.nullif("page.`@id`", F.lit("")), F.nullif("page.url", F.lit("")))
    link = F.coalesce(field("url"), inner)
    items = nodes.where(F.lower(first_kind).isin(ITEM_TYPES)).select(
        "page_url",
        "block",
        "node",
        F.when(~link.rlike(r"^[\[{]"), resolve(F.col("page_url"), link)).alias("url"),
        F.coalesce(field("headline"), field("name")).alias("title"),
        parse_utc(F.coalesce(field("datePublished"), field("dateCreated"))).alias("published_date"),
    )
    same_host = once(items, "url").where(host(F.col("url")) == host(F.col("page_url")))
    order = F.struct("block", "node")
    return same_host.select("page_url", order.alias("n"), "url", "title", "published_date")


def candidates(
    pages: DataFrame, html: DataFrame, max_items: int = MAX_ITEMS, reads: DataFrame | None = None
) -> DataFrame:
    """Article urls to visit per source, in order.

    ``pages``: (company_name, source_url, page_no, page_url), the listing pages
    of each source. ``html``: (url, html) of those pages; ``reads``: their
    ``page_reads``, if they have been read already. Embedded items come first; a page's links count only while the list is shorter than
    ``max_items``. That list only grows, so running counts decide. The counts,
    the grouping and the later ranking share one shuffle by source; a source
    has at most 1 + MAX_EXTRA_PAGES pages.
    """
    source = ["company_name", "source_url"]
    items = jsonld_items(html, reads).select(
        "page_url",
        F.lit(0).alias("kind"),
        F.col("n.block").alias("a"),
        F.col("n.node").alias("b"),
        "url",
        "title",
        "published_date",
    )
    links = listing_links(page_anchors(html) if reads is None else anchors_of(reads), max_items).select(
        "page_url",
        F.lit(1).alias("kind"),
        F.lit(0).alias("a"),
        F.col("n").alias("b"),
        "url",
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("timestamp_ntz").alias("published_date"),
    )
    # a page shared by sources may be in ``html`` more than once
    found = pages.join(items.dropDuplicates(["page_url", "a", "b"]).unionByName(links), "page_url")
    by_page = Window.partitionBy(*source).orderBy("page_no")
    n_items = F.count_if(F.col("kind") == 0).over(by_page.rangeBetween(Window.unboundedPreceding, 0))
    n_links = F.count_if(F.col("kind") == 1).over(by_page.rangeBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("filled", n_items + n_links).where((F.col("kind") == 0) | (F.col("filled") < max_items))
    order = F.struct("page_no", "kind", "a", "b")
    item_order = F.when(F.col("kind") == 0, order)
    return rows.groupBy(*source, "url").agg(
        F.min(order).alias("place"),
        F.max_by(F.struct("title", "published_date"), item_order).alias("item"),
    )


def chosen_candidates(found: DataFrame, cutoffs: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """The first ``max_items`` candidates per source that are not known to be old."""
    dated = found.join(cutoffs, "company_name", "left")
    kept = dated.where(is_later(F.col("item.published_date"), F.col("last_success")))
    order = Window.partitionBy("company_name", "source_url").orderBy("place")
    return kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_items)


def _visit(rows: DataFrame, snapshots: DataFrame, kind: str) -> DataFrame:
    """Look each url up in the snapshots; a missing page is a failed attempt."""
    seen = rows.join(snapshots, "url", "left")
    return seen.withColumns(
        {
            "kind": F.lit(kind),
            "attempted": F.col("status_code").isNotNull(),
            "fetched": F.col("status_code").isNotNull() & is_usable(),
        }
    )


def listing_visits(sources: DataFrame, snapshots: DataFrame, rules: DataFrame) -> DataFrame:
    """Listing pages of all sources, page 0 and further ones.

    A source its robots rules forbid is a failed row without an attempt. Robots
    rules are asked for listing urls only.
    """
    first = first_visits(sources, snapshots, rules)
    opened = first.where("fetched")
    anchors = page_anchors(opened.select("url", F.col("text").alias("html")))
    return first.unionByName(extra_visits(first, anchors, snapshots))


def first_visits(sources: DataFrame, snapshots: DataFrame, rules: DataFrame) -> DataFrame:
    """Page 0 of every source."""
    asked = fetch_decisions(sources.select("company_name", F.col("url"), F.col("url").alias("source_url")), rules)
    first = _visit(asked.withColumn("page_no", F.lit(0)), snapshots, "listing")
    return first.withColumns(
        {"attempted": F.col("attempted") & F.col("allowed"), "fetched": F.col("fetched") & F.col("allowed")}
    ).drop("allowed")


def extra_visits(first: DataFrame, anchors: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Further listing pages that the links of the first ones name (H7)."""
    opened = first.where("fetched")
    more = extra_listing_pages(anchors)
    pages = opened.select("company_name", "source_url").join(
        more.select(F.col("page_url").alias("source_url"), F.col("n").alias("page_no"), "url"), "source_url"
    )
    return _visit(pages, snapshots, "extra").select(*first.columns)


def article_visits(chosen: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Chosen candidates with what their pages say; listing values first (H9)."""
    seen = _visit(chosen, snapshots, "article").withColumn("html", F.when(F.col("fetched"), F.col("text")))
    fields = page_fields(seen.drop("text"))
    return fields.withColumns(
        {
            "title": F.coalesce(F.nullif("item.title", F.lit("")), "page_title"),
            "published": F.coalesce("item.published_date", "page_date"),
        }
    )


def records(visits: DataFrame, fetched_at) -> DataFrame:
    """Article records of the visits, late-filtered once more by page date.

    The id is a hash of company and url, so a repeated job writes the same ids.
    """
    kept = visits.where("fetched").where(is_later(F.col("published"), F.col("last_success")))
    return kept.select(
        "company_name",
        F.sha2(F.concat_ws("|", "company_name", "url"), 256).alias("id"),
        "source_url",
        "url",
        "title",
        F.col("page_text").alias("article_content"),
        F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("published_date"),
        F.lit(str(fetched_at)).alias("s_created_ts"),
        F.round("response_time_ms", 2).alias("response_time_ms"),
        F.struct("company_name", "source_url", "n").alias("seq"),
    )


def visit_log(*visits: DataFrame) -> DataFrame:
    """One fetch-log row per visit for the run metrics."""
    rows = [
        v.select(
            "company_name",
            "attempted",
            "fetched",
            (F.col("fetched") & F.col("title").isNotNull() if "title" in v.columns else F.lit(False)).alias("parsed"),
            F.when(F.col("attempted"), F.col("response_time_ms")).alias("response_time_ms"),
        )
        for v in visits
    ]
    return reduce(DataFrame.unionByName, rows)
