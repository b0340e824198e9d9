"""Page extraction on hand-made pages: listing rules, items, dates, main text, records."""

import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from newswatch.functions import dom, markup, urls
from newswatch.operators import extract, load, robots
from newswatch.schemas import PAGE_SNAPSHOT

LONG = "This is a sentence that is long enough to count as the body of an article. " * 3


def one(spark, html, url="https://example.com/news"):
    return spark.createDataFrame([(url, html)], "url string, html string")


def listing(spark, html, url, n=10):
    rows = extract.listing_links(extract.page_anchors(one(spark, html, url)), n).orderBy("n").collect()
    return [r.url for r in rows]


def test_host_with_its_own_rules(spark):
    html = """<ul><li><a href="/news-and-views/views/hsbc-views/rates-in-spring">Rates</a></li>
    <li><a href="/news-and-views/views/hsbc-views">Overview</a></li><li><a href="/about/people">People</a></li></ul>"""
    url = "https://www.hsbc.com/news-and-views/views"
    assert listing(spark, html, url) == ["https://www.hsbc.com/news-and-views/views/hsbc-views/rates-in-spring"]


def test_shared_network_of_hosts(spark):
    html = """<p><a href="https://elsewhere.example/y-CNT7.html">elsewhere</a><a href="/tv">tv</a></p>
    <a href="https://cinema.orange.fr/sorties/article/film-CNT42.html">film</a>
    <a href="https://finance.orange.fr/bourse/cours-CNT43.html">cours</a>"""
    got = listing(spark, html, "https://finance.orange.fr/")
    assert got == [
        "https://cinema.orange.fr/sorties/article/film-CNT42.html",
        "https://finance.orange.fr/bourse/cours-CNT43.html",
    ]


def test_links_are_ranked_filtered_and_cut(spark):
    html = """<a href="/magazine/late">x</a><div class="news list"><p><a href="/news/b?utm=1">b</a></p></div>
    <article><a href="/news/a">a</a><a href="/news/a">again</a><a href="/news/x.PDF">pdf</a>
    <a href="/news/x?page=2">next</a><a href="/news/x?page=">blank value</a></article>"""
    want = ["https://example.com" + p for p in ("/news/a", "/news/x?page=", "/news/b?utm=1", "/magazine/late")]
    assert listing(spark, html, "https://example.com/list") == want
    assert listing(spark, html, "https://example.com/list", 2) == want[:2]


LINK_CASES = [
    ("https://a.com/x/y", "z", "https://a.com/x/z"),
    ("https://a.com/x/y", "../z?q=1", "https://a.com/z?q=1"),
    ("https://a.com/x", "//b.com/c", "https://b.com/c"),
    ("https://a.com/x", "/p/q#f", "https://a.com/p/q#f"),
    ("https://a.com/x", "?o=20", "https://a.com/x?o=20"),
    ("https://a.com/x", "mailto:me@a.com", "mailto:me@a.com"),
    # a doubled base path is taken out once
    ("https://a.com/en/news/", "en/news/story", "https://a.com/en/news/story"),
    ("https://a.com/news/", "/news/news/story", "https://a.com/news/story"),
]


def test_link_normalisation(spark):
    df = spark.createDataFrame([(i, b, h) for i, (b, h, _) in enumerate(LINK_CASES)], "i int, b string, h string")
    got = df.select("i", urls.normalize(F.col("b"), F.col("h")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [want for _, _, want in LINK_CASES]


def test_further_listing_pages(spark):
    html = "".join(f'<a href="?o={i * 20}">p</a>' for i in range(1, 20)) + '<a href="/other?o=1">q</a>'
    url = "https://newsroom.viatris.com/press"
    got = extract.extra_listing_pages(extract.page_anchors(one(spark, html, url))).orderBy("n").collect()
    assert [r.url for r in got] == [f"{url}?o={i * 20}" for i in range(1, 13)]
    eurofins = '<a href="/media-centre/press-releases-2020/">2020</a><a href="/media-centre/x">x</a>'
    got = extract.extra_listing_pages(extract.page_anchors(one(spark, eurofins, "https://www.eurofins.com/media"))).collect()
    assert [r.url for r in got] == ["https://www.eurofins.com/media-centre/press-releases-2020/"]


def test_embedded_items(spark):
    html = """<!-- <script type="application/ld+json">{"@type":"Article","url":"/no"}</script> -->
    <script>var x = "<!--";</script>
    <script type="application/ld+json">[{"@type":"NewsArticle","url":"/news/a?x=1","headline":"H",
      "datePublished":"2024-05-01T10:00:00+02:00"},
      {"@graph":[{"@type":["report"],"mainEntityOfPage":{"@id":"../c"},"name":"N","dateCreated":"2024-05-02"},
                 {"@type":"Report","url":{"x":1}},{"@graph":[{"@type":"BlogPosting","url":"/deep","headline":""}]}]},
      {"@type":"Article","url":"https://other.org/x"},{"@type":"Person","url":"/p"}]</script>
    <script type="application/ld+json">{'single': quotes}</script>
    <script id="z" type='application/ld+json'>{"@type":"Article","url":"/second"}</script>"""
    rows = extract.jsonld_items(one(spark, html, "https://example.com/news/list")).orderBy("n").collect()
    assert [(r.url, r.title, r.published_date) for r in rows] == [
        ("https://example.com/news/a?x=1", "H", datetime(2024, 5, 1, 8)),
        ("https://example.com/c", "N", datetime(2024, 5, 2)),
        ("https://example.com/deep", None, None),
        ("https://example.com/second", None, None),
    ]


def test_deeply_nested_items(spark):
    """Graphs of any depth are read; the listing keeps the document's order."""
    node = '{"@type":"Article","url":"/d9"}'
    for k in range(8, 0, -1):
        node = f'{{"@type":"Article","url":"/d{k}","@graph":[{node},"text",{{"@type":"Person"}}]}}'
    html = f'<script type="application/ld+json">[{node},{{"@type":"Report","url":"/last"}}]</script>'
    rows = extract.jsonld_items(one(spark, html, "https://example.com/news")).orderBy("n").collect()
    assert [r.url for r in rows] == [f"https://example.com/d{k}" for k in range(1, 10)] + ["https://example.com/last"]


DATE_CASES = [
    ('<meta property="article:published_time" content="2024-05-01T10:00:00Z">', datetime(2024, 5, 1, 10)),
    ("<meta content='2024-05-02' name='pubdate'/>", datetime(2024, 5, 2)),
    ('<meta itemprop="datePublished" content="on 2024-05-03">', datetime(2024, 5, 3)),
    ('<time datetime="2020-01-01">2024-05-04 08:00:00</time>', datetime(2024, 5, 4, 8)),
    ('<meta name="pubdate" content="2024-99-99"><time>2024-05-05</time>', datetime(2024, 5, 5)),
    ('<meta name="pubdate2" content="x"><p>updated 2024-05-06.</p>', datetime(2024, 5, 6)),
    ("<p>12024-05-06 and 1999-01-01</p>", None),
]


def all_fields(spark, pages):
    df = spark.createDataFrame([(str(i), html) for i, html in enumerate(pages)], "url string, html string")
    rows = sorted(extract.page_fields(df).collect(), key=lambda r: int(r.url))
    return [(r.page_title, r.page_date, r.page_text) for r in rows]


def test_page_dates(spark):
    got = all_fields(spark, [f"<html><head><title>T</title>{head}</head><body></body></html>" for head, _ in DATE_CASES])
    assert [g[1] for g in got] == [day for _, day in DATE_CASES]


def test_cut_off_and_unknown_entities(spark):
    title = "<title>A&amp&lt;&am</title>"
    body = f"<article>B&amp <i>C&foo; D&amp-x &#65;&eacute</i> {LONG}</article>"
    got = all_fields(spark, [title + body])[0]
    assert got[0] == "A&<&am"
    assert got[2] == f"B& C&foo D&amp-x Aé {LONG}".strip()


def test_titles(spark):
    shared = '<title></title><meta property="og:title" content=" Shared &eacute; ">'
    got = all_fields(spark, ["<title> A &amp; B </title>", shared, "<svg></svg><p>none</p>"])
    assert [g[0] for g in got] == ["A & B", "Shared é", None]


TEXT_CASES = [
    f"<header><nav>menu</nav></header><article><h1>T</h1><p>{LONG}</p></article><footer>f</footer>",
    f"<nav><nav>in</nav>out</nav><article>{LONG}</article>",
    f"<p>lead<article>{LONG}</p> after the stray end tag {LONG}</article>",
    f'<article title="a>b">{LONG}</article>',
    f"<article>{LONG} AT&T &eacute; &amp; &nbsp; x</article>",
    f'<div class="main-Content">{LONG}<div>inner</div></div><div id="post">{LONG}</div>',
    f'<div id="entry">{LONG}</div>',
    f"<main>{LONG}</main>",
    f"<article>short</article><p>One.<p>Two {LONG}</p></p>",
    f"<article>{LONG}<article>nested {LONG}</article></article>",
    f"<!-- <article>no</article> --><script>'<article>'</script><article>{LONG}</article>",
    f"<article>{LONG}<template>hidden</template></article>",
    f"<article>{LONG}",
    "<p>tiny</p>",
        "",
]


def test_patterns_and_reader_agree(spark):
    wanted = [re.sub(r"\s+", " ", dom.article_text(html) or "").strip() for html in TEXT_CASES]
    got = all_fields(spark, TEXT_CASES)
    assert [g[2] for g in got] == [w if len(w) > 50 else None for w in wanted]


def test_main_text_rules(spark):
    pages = [
    f"<aside>ad</aside><article><p>One &lt;b&gt;</p><p>{LONG}</p><!-- c --><script>x</script></article>",
    f"<p>lead<article>{LONG}</p> dropped</article>",
    f"<article>{'word ' * 20000}</article>",
    ]
    text, stray, huge = (g[2] for g in all_fields(spark, pages))
    assert text == f"One <b> {LONG}".strip()
    assert stray == LONG.strip()  # the end tag of p closes the article too
    assert len(huge) == 50_000


ARTICLE = "<html><head><title>{t}</title>{m}</head><body><article><p>" + LONG + "</p></article></body></html>"
META = '<meta property="article:published_time" content="{d}" />'


def run_crawl(spark, pages, cutoff=None, robots_text=None, max_items=10):
    listing_url = "https://example.com/news"
    snapshots = spark.createDataFrame(pages, PAGE_SNAPSHOT)
    sources = spark.createDataFrame([("TESTCO", listing_url)], "company_name string, url string")
    files = [("https://example.com", robots_text)] if robots_text else []
    rules = robots.site_rules(spark.createDataFrame(files, "site string, text string"), "TestAgent/1.0")
    visits = extract.listing_visits(sources, snapshots, rules)
    opened = visits.where("fetched")
    listing_pages = opened.select("company_name", "source_url", "page_no", F.col("url").alias("page_url"))
    found = extract.candidates(listing_pages, opened.select("url", F.col("text").alias("html")), max_items)
    cutoffs = spark.createDataFrame([("TESTCO", cutoff)] if cutoff else [], "company_name string, last_success timestamp_ntz")
    articles = extract.article_visits(extract.chosen_candidates(found, cutoffs, max_items), snapshots)
    records = extract.records(articles, "2026-05-01T00:00:00+00:00").orderBy("seq").collect()
    return records, load.fetch_metrics(extract.visit_log(visits, articles)).head()


def page(url, text, status=200, kind="text/html; charset=UTF-8"):
    return (url, text, status, kind, 10.0)


def test_record_from_a_listing(spark):
    pages = [
        page("https://example.com/news", '<article><a href="https://example.com/news/article-1">Read</a></article>'),
        page("https://example.com/news/article-1", ARTICLE.format(t="Test Article", m=META.format(d="2026-04-19T09:00:00+00:00"))),
    ]
    records, metrics = run_crawl(spark, pages)
    assert [(r.company_name, r.url, r.title, r.published_date) for r in records] == [
        ("TESTCO", "https://example.com/news/article-1", "Test Article", "2026-04-19T09:00:00+00:00")
    ]
    assert (metrics.urls_attempted, metrics.urls_fetched, metrics.parse_success_count, metrics.error_count) == (2, 2, 1, 0)
    assert metrics.avg_response_time_ms == 10.0


def test_old_items_are_not_visited_and_undated_ones_are_kept(spark):
    items = """<script type="application/ld+json">[{"@type":"NewsArticle","url":"https://example.com/news/old","headline":"Old",
    "datePublished":"2026-04-19T09:00:00+00:00"},{"@type":"NewsArticle","url":"https://example.com/news/new",
    "headline":"Listed title","datePublished":"2026-04-19T11:00:00+00:00"}]</script>
    <article><a href="/news/undated">u</a><a href="/news/late-page">p</a><a href="/news/gone">g</a></article>"""
    pages = [
        page("https://example.com/news", items),
        page("https://example.com/news/old", "never read"),
        page("https://example.com/news/new", ARTICLE.format(t="Page title", m=META.format(d="2026-04-01"))),
        page("https://example.com/news/undated", ARTICLE.format(t="Undated", m="")),
        page("https://example.com/news/late-page", ARTICLE.format(t="Old page", m=META.format(d="2026-04-19T10:00:00Z"))),
        page("https://example.com/news/gone", "x", 404),
    ]
    records, metrics = run_crawl(spark, pages, datetime(2026, 4, 19, 10))
    assert [(r.url.rsplit("/", 1)[1], r.title) for r in records] == [("new", "Listed title"), ("undated", "Undated")]
    # visited: the list, new, undated, the page that turns out old, and the missing one
    assert (metrics.urls_attempted, metrics.urls_fetched, metrics.error_count) == (5, 4, 1)


def test_links_count_only_while_the_list_is_short(spark):
    items = ",".join(f'{{"@type":"Article","url":"/news/i{i}"}}' for i in range(3))
    html = f'<script type="application/ld+json">[{items}]</script><article><a href="/news/link">l</a></article>'
    pages = [page("https://example.com/news", html)] + [
        page(f"https://example.com/news/{n}", ARTICLE.format(t=n, m="")) for n in ("i0", "i1", "i2", "link")
    ]
    assert [r.title for r in run_crawl(spark, pages, max_items=3)[0]] == ["i0", "i1", "i2"]
    assert [r.title for r in run_crawl(spark, pages, max_items=4)[0]] == ["i0", "i1", "i2", "link"]


def test_robots_and_bad_listings(spark):
    pages = [page("https://example.com/news", "<p>x</p>")]
    records, metrics = run_crawl(spark, pages, robots_text="User-agent: *\nDisallow: /news")
    assert not records and (metrics.urls_attempted, metrics.error_count) == (0, 1)
    records, metrics = run_crawl(spark, [page("https://example.com/news", "x", kind="application/pdf")])
    assert (metrics.urls_attempted, metrics.urls_fetched, metrics.error_count) == (1, 0, 1)
    records, metrics = run_crawl(spark, [page("https://elsewhere.com/", "x")])
    assert (metrics.urls_attempted, metrics.error_count) == (0, 1)


def test_reader_anchors():
    html = '<div class="card x"><a href="/a">One <b>two</b><script>no</script></a></div><a>none</a><a href="">e</a><a href="/b">B'
    assert dom.anchors(html) == [(0, "/a", "One two", 5), (1, "/b", "B", None)]


def test_jsonld_pattern_skips_other_scripts(spark):
    html = '<script type="text/x">{"@type":"Article"}</script><SCRIPT data-a="1" type="application/ld+json" >{}</SCRIPT>'
    assert one(spark, html).select(markup.jsonld_texts(F.col("html"))).head()[0] == ["{}"]


PROSE = "some words of the article that go on for long enough to be taken as its text "
PIECES = ("""<a href="/x">|</a>|<a href=y>|<p>|</p>|<div class="news x">|</div>|<article>|</article>|t & u &amp; &copy |<!-- c -->|<br>|<br/>
    |<script>var a="<a href=1>";</script>|<li class=card>|</li>|<template>|</template>|<a>| text |<b/>|<a href="/q"/>|<img src=x>|&#65;|<rt>|</rt>
    |<span CLASS="story">|</span>|<A HREF="&lt;z">|</x>|< b|<style>p{}</style>|<title>a &amp; b</title>|<p title="a>b">|<!doctype html>|<a href="">
    |<main>|</main>|<nav>|</nav>|<div id="content">|<div class="post-body">|<header>|</header>|<p/>|<article/>
    |<meta property="og:title" content="Shared &eacute; title">|<META name="pubdate" content="2024-03-01">|<meta itemprop=datePublished content=2024-04-02T10:00:00Z>
    |<meta property="article:published_time" content="no date">|<time content="2024-05-06">|<time>|</time>|2024-01-31|<title> </title>
    |<script type="application/ld+json">{"@type":"Article"}</script>|<script type='text/x'>{}</script>|<!-- <script type="application/ld+json">{}</script> -->|"""
    + "|".join([PROSE, f"<p>{PROSE}</p>", f"<article>{PROSE}{PROSE}</article>"])).split("|")


def random_pages(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 16))) for _ in range(n)]


def test_one_pass_equals_the_tree():
    quick = 0
    for html in random_pages(6000, 9):
        found = dom.one_pass(html)
        if found is not None:
            quick += 1
            assert found.anchors == dom.tree_anchors(html), html
            assert found.text == dom.article_text(html), html
    assert quick > 2000


def test_one_pass_equals_the_patterns(spark, sf_dir):
    """Title, date, text and embedded items of random pages and of the driver's."""
    made = spark.createDataFrame([(f"https://example.com/{k}", h) for k, h in enumerate(random_pages(300, 4))], "url string, html string")
    pages = made.unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html")).distinct()
    head = pages.withColumn("code_free", markup.without_code(F.col("html")))
    old = head.withColumns({"page_title": markup.page_title(F.col("code_free")), "page_date": markup.page_date(F.col("code_free"), F.col("html"))})
    old = markup.with_main_text(old).select("url", "html", "page_title", "page_date", "page_text").collect()
    new = {r.url: r for r in extract.page_fields(pages.withColumn("source_html", F.col("html"))).collect()}
    for r in old:
        got = new[r.url]
        assert (got.page_title, got.page_date, got.page_text) == (r.page_title, r.page_date, r.page_text), r.html
    items = {r.url: r["items"] for r in extract.page_reads(pages).where("NOT odd").collect()}
    for r in pages.select("url", "html", markup.jsonld_texts(F.col("html")).alias("j")).collect():
        assert items.get(r.url, r.j) == r.j, r.html


@pytest.mark.parametrize("piece", ["<a b ", "<a '", "<!-- ", "<script ", '<p x="', "<p>", "<b", "&amp", "<article><p>"])
def test_one_pass_is_linear(piece):
    start = time.perf_counter()
    dom.one_pass(piece * (400_000 // len(piece)))
    assert time.perf_counter() - start < 5


def test_odd_pages_still_have_fields_and_links(spark):
    html = f'<title>Odd</title><noscript>x</noscript><article><a href="/news/one">One</a> {PROSE}{PROSE}</article>'
    row = extract.page_fields(one(spark, html)).head()
    assert row.page_title == "Odd" and row.page_text.startswith("One some words")
    reads = extract.page_reads(one(spark, html)).head()
    assert reads.odd and [a.href for a in reads.anchors] == ["/news/one"]
