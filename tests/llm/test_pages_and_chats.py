"""Archives, page extraction and chat trees: exact round trips."""

import collections
import hashlib
import time

import pytest

from newswatch.llm import chat_tree, html_extract, warc
from newswatch.llm.common import table
from tests.llm import brute

BIG = "WARC/1.1\r\n\r\n0\r\n\r\n" * 5000


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    odd = [
        (-1, "http://x/é\n", None), (-2, None, ""), (-3, "http://y", BIG), (-4, "http://z", BIG), (-5, "u", "é" * 40), (-6, "u", "é" * 40),
        (-7, "u", "a" * 99), (-8, "u", "a" * 99), (-9, "u", "b" * 100), (-10, "u", "b" * 100), (-11, "u", "twin one"), (-11, "u", "twin two"),
        (-12, "u", "same row"), (-12, "u", "same row"), (None, "u", "no id"), *[(-13, None, "r" * 200)] * 3, *[(None, "", "s" * 200)] * 2, (None, None, "s" * 200),
    ]
    return table(spark, sf_dir, "pages").unionByName(spark.createDataFrame(odd, "page_id long, url string, html string"))


def test_archives_round_trip(spark, pages):
    path = warc.write_archives(pages, segment_bytes=4000, records_per_file=50)
    segments = warc.read_segments(spark, path)
    records = warc.whole_records(segments)
    got = collections.Counter(tuple(r) for r in warc.captures(records).collect())
    source = [(r.page_id, r.url, (r.html or "").encode()) for r in pages.collect()]
    same = collections.defaultdict(list)
    for p, u, h in source:
        same[h].append((p is None, p or 0, u or "", p))
    want = collections.Counter()
    for h, rows in same.items():
        for k, (*_, p) in enumerate(sorted(rows, key=lambda r: r[:3])):
            revisit = k > 0 and len(h) >= 100
            want[(p, len(h), hashlib.sha256(h).hexdigest(), "revisit" if revisit else "response", min(rows)[3] if revisit else None, None)] += 1
    ids = [r.record_id for r in records.select("record_id").collect()]
    assert len(set(ids)) == len(ids) == len(source)
    assert got == want
    assert segments.filter("record_type = 'continuation'").count() > 20
    # A lost segment is noticed.
    lost = segments.filter("NOT (origin_id LIKE '%:-4:%' AND number = 2)")
    assert warc.whole_records(lost).filter("problem IS NOT NULL").count() == 1


def test_many_equal_rows(spark):
    rows = [(1, "u", "x" * 300)] * 25 + [(2, "u", "y")] * 7 + [(3, "u", "x" * 300)]
    captures = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("page_id", "url", "CAST(html AS BINARY) AS payload", "sha2(html, 256) AS digest")
    equal = captures.groupBy("page_id", "url", "digest").count().withColumnRenamed("count", "n").filter("n > 1")
    got = warc.numbered(captures, equal, 100, block=4).collect()
    assert sorted((r.page_id, r.copy) for r in got) == sorted([(1, k) for k in range(25)] + [(2, k) for k in range(7)] + [(3, 0)])
    assert all(bytes(r.payload) == b"y" for r in got if r.page_id == 2) and sum(r.payload is not None for r in got if r.page_id == 1) == 1


def test_tags_that_never_close():
    """Linear time, whatever stays open; what is no tag is text."""
    for n in (20_000, 80_000):
        for odd in ("<a b ", "<a ' ", "<a '>' ", "<a \"'>", "<! ", "<script ", "<p class=it's>"):
            started = time.process_time()
            html_extract.read_page(odd * n + "'")
            assert time.process_time() - started < 10, (odd, n)
    read = lambda source: [t for t, _ in html_extract.read_page(source)[1]]
    assert read("<p>one</p>two <b cut") == ["one", "two <b cut"]
    assert read("<p title=it's>one</p><p>two</p>") == ["one", "two"]
    assert read("<p title='a>b'>one</p>1 < 2 <!-- <p>no") == ["one", "1 < 2"]


def test_chunk_framing():
    for payload in (b"", b"x", b"0\r\n\r\n" * 10, bytes(range(256)) * 9):
        for size in (1, 7, 4096):
            assert warc.unchunked(warc.chunked(payload, size)) == payload
    for broken in (b"", b"5\r\nab", b"zz\r\nab\r\n0\r\n\r\n", b"2\r\nabX\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_main_text_of_the_pages_table(spark, sf_dir, pages):
    got = collections.defaultdict(list)
    for r in html_extract.extract(pages).collect():
        got[r.page_id].append(r)
    for r in table(spark, sf_dir, "pages").collect():
        (own,) = got[r.page_id]
        assert (own.url, own.text, own.n_chars) == (r.url, brute.article_text(r.html), len(brute.article_text(r.html)))
    assert got[-1][0].text == "" and len(got[-11]) == 2


@pytest.mark.parametrize("shard_pages", [2000, 3])
def test_host_boilerplate(spark, shard_pages):
    own = [f"text {k} of its own about a thing no other page of this host has " + " ".join(f"w{k}_{j}" for j in range(30)) for k in range(12)]
    same = "<div>All rights kept by the makers of this fine host of pages and more words</div>"
    rows = [(k, f"http://h.example/{k}", f"<html><body><div>{t}</div>{same}<ul><li><a href=x>home page</a></li></ul></body></html>") for k, t in enumerate(own)]
    rows += [(50, "http://one/", "<body><p>only page</p>"), (51, "http://h.example/copy", rows[3][2])]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_pages=shard_pages).collect()}
    assert all(got[k] == own[k] for k in range(12) if k != 3)
    assert own[3] in got[3] and got[51] == got[3] and got[50] == "only page"


@pytest.mark.parametrize(
    "source,want",
    [
        ("<main><h1>T &amp; x</h1><p>a<b>b</b>&nbsp;c<br>d<p>e<aside>no</aside></main><div class='sidebar'>z", "T & x\n\nab c d\n\ne"),
        ("<article>a &lt; b <p hidden>no</p><article class=comment>reader</article> c</article>", "a < b\n\nc"),
        ("<div class=wrap-sidebar><article><p>kept</p><div class='share-box'>no</div><footer>no</footer></article></div>", "kept"),
        ("<nav>no</nav><article><header><h1>Title</h1></header><p>x</p><form>no</form></article><footer>no</footer>", "Title\n\nx"),
        ("<article><p>a <!-- <p>no</p> -->b</p><script>var x='</p>';</script><style>no</style></article>", "a b"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>c</table>", "one\n\ntwo\n\nc"),
        ("<p>x <!-- y --> \"z' <a b='>'>q</a> <", "x \"z' q <"),
    ],
)
def test_reading_a_page(source, want):
    article, others = html_extract.read_page(source)
    assert "\n\n".join(article or [t for t, _ in others]) == want


@pytest.fixture(scope="module")
def turns(spark, sf_dir):
    odd = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (-8, 0, "user", None),
        (-8, 1, "assistant", "a\\b\\\\ <|text|><|end|> <<SYS>> é\U0001f600 \x00 <|endoftext|> \\"), (-9, 0, "user", None), (-10, 0, None, "x"),
        (-11, None, "user", "b"), (-11, 1, "user", "a"), (-11, 1, "user", "a"), (None, 0, "user", "no id"),
    ] + [(-100 - c, k, "assistant" if k % 2 else "user", f"shared {k}" if k < 5 else f"own {c}") for c in range(6) for k in range(5 + c % 3)]
    return table(spark, sf_dir, "conversations").unionByName(spark.createDataFrame(odd, "conv_id long, turn long, role string, text string"))


def test_chat_trees_round_trip(turns, byte_tokenizer):
    stream = chat_tree.format_conversations(turns, byte_tokenizer)
    got = {r.conv_id: r for r in chat_tree.read_conversations(stream, byte_tokenizer).collect()}
    source = collections.defaultdict(list)
    for r in turns.collect():
        source[r.conv_id].append(((r.turn is not None, r.turn or 0), r.role or "", r.text or ""))
    assert set(got) == set(source)
    for conv, own in source.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        g = got[conv]
        assert g.n_turns == len(own)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    nodes = stream.nodes.orderBy("seq_start").collect()
    prefixes = {tuple((r, t) for _, r, t in own[: k + 1]) for own in source.values() for k in range(len(own))}
    assert len(nodes) == len(prefixes)  # shared turns are there once
    by_name, at = {bytes(n.node): n for n in nodes}, 0
    for n in nodes:
        assert n.seq_start == at
        at += n.n_tokens
        path = [n]
        while path[-1].parent:
            path.append(by_name[bytes(path[-1].parent)])
        seen = [m.seq_start for m in nodes if m.seq_start <= n.seq_start < m.attend_to]
        assert seen == sorted(m.seq_start for m in path)
        assert n.position == sum(m.n_tokens for m in path[1:])


@pytest.mark.parametrize("text", ["", "\\", "</s>", "<|end|>", "[INST][/INST]", "a\\<|\\|>", "<<SYS>><</SYS>>", "\\\\</s>\\"])
def test_escapes(text):
    escaped = chat_tree.escape(text)
    assert not any(c in escaped for c in chat_tree.CONTROLS)
    assert chat_tree.unescape(escaped) == text


@pytest.mark.parametrize(
    "source,want",
    [
        ("<article><h2 id='how-to-search'>How</h2><section id='social-effects'><p>x</p></section></article>", "How\n\nx"),
        ("<article><h2 id='search' class='related'>A</h2><p class='notice'>b</p><div class='social-effects'>c</div></article>", "A\n\nb\n\nc"),
        ("<article><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p></article>", "a x=1 b"),
        ("<article><p>a</p><div class='x share-box'>no</div><div id='comments'>no</div><div role='navigation'>no</div><p hidden>no</p></article>", "a"),
        ("<article><p>a</p><div class='relatedLinks'>no</div><ul class='social-share-buttons'><li>no</ul></article>", "a"),
        ("<article id='ad-blockers'><p>a</p><article class='comment-body'>no</article></article>", "a"),
    ],
)
def test_parts_of_an_article_are_dropped_by_whole_names(source, want):
    assert "\n\n".join(html_extract.read_page(source)[0]) == want


def _texts(spark, rows, **how):
    pages = spark.createDataFrame([(k, url, source) for k, (url, source) in enumerate(rows)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_extract.extract(pages, **how).collect())]


NOTICE = "Write to the desk of this house if you want to have our news by post each day"
PROMISE = "All rights kept by the makers of this fine host of pages and more words"


def _own(k, n=30):
    return " ".join(f"w{k}_{j}" for j in range(n))


@pytest.mark.parametrize("how", [{}, {"shard_pages": 3}, {"shard_chars": 1500}])
def test_the_host_array_reads_declared_articles_too(spark, how):
    """A notice without a telling name goes; passages that fewer pages share, and copies, stay."""
    own = [[_own(f"{k}a"), f"{_own('quote', 12)}" if k in (2, 5, 9) else _own(f"{k}b", 5), _own(f"{k}c")] for k in range(12)]
    page = "<html><body><div>{0}</div><article><h1>{1}</h1><p>{2}</p><p>{3}</p><p>{4}</p></article><div>{0}</div></body></html>"
    rows = [(f"http://h.example/{k}", page.format(PROMISE, a, b, NOTICE, c)) for k, (a, b, c) in enumerate(own)]
    # A host whose pages are one article with other date lines, and one of too few pages to tell.
    rows += [(f"http://copies/{k}", f"<article><p>printed on day {k}</p><p>{_own('copy', 60)}</p></article>") for k in range(8)]
    rows += [(f"http://small/{k}", f"<article><p>{_own(f's{k}')}</p><p>{NOTICE}</p></article>") for k in range(4)]
    got = _texts(spark, rows, **how)
    assert got[:12] == ["\n\n".join(blocks) for blocks in own]
    assert got[12:20] == [f"printed on day {k}\n\n{_own('copy', 60)}" for k in range(8)]
    assert got[20:] == [f"{_own(f's{k}')}\n\n{NOTICE}" for k in range(4)]


@pytest.mark.parametrize("how", [{}, {"shard_pages": 3}])
def test_what_lies_beside_articles_tells_of_pages_without_one(spark, how):
    rows = [(f"http://h/{k}", f"<div>{PROMISE}</div><article><p>{_own(k)}</p></article><div>read most: {_own(7, 12)}</div>") for k in range(9)]
    rows.append(("http://h/bare", f"<div>{PROMISE}</div><div>{_own('bare')}</div>"))
    got = _texts(spark, rows, **how)
    assert got == [*map(_own, range(9)), _own("bare")]  # the first words of page 7 stand in everybody's list


def test_equal_articles_count_once(spark):
    """Copies on most pages of a host do not turn what they say into a notice."""
    rows = [("http://h/", f"<article><p>{_own('x', 40)}</p><p>{_own('said', 10)}</p></article>")] * 9
    rows += [("http://h/", f"<article><p>{_own(k, 40)}</p><p>{_own('said', 10)}</p></article>") for k in range(2)]
    rows += [("http://h/", f"<article><p>{_own(k, 40)}</p></article>") for k in range(2, 8)]
    got = _texts(spark, rows)
    assert got == [f"{_own(k, 40)}\n\n{_own('said', 10)}" for k in ["x"] * 9 + [0, 1]] + [_own(k, 40) for k in range(2, 8)]


def test_read_page_hands_on_all_blocks():
    article, others = html_extract.read_page("<div>top</div><article><p>a</p><p>b</p></article><p>end</p><nav>no</nav>")
    assert article == ["a", "b"] and [t for t, _ in others] == ["top", "end"]


@pytest.mark.parametrize(
    "source,want",
    [
        ("<html><head><meta charset=x><title>no</title><style>p{}</style><h1>T</h1><p>one", "T\n\none"),
        ("<head><title>no</title><script>var no;</script></head><p>one", "one"),
        ("<article><title-bar>a</title-bar><select-box>b</select-box> c</article>", "ab c"),
        ("<body><form id=all><div>no</div><article><p>one</p><form>no</form></article></form><form>no</form>", "one"),
    ],
)
def test_no_page_is_lost_to_an_open_head_a_name_or_a_form(source, want):
    article, others = html_extract.read_page(source)
    assert "\n\n".join(article or [t for t, _ in others]) == want
