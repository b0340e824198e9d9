"""What one pass over pages holds at a time, and what filters on its results repeat."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from newswatch.functions import dom
from newswatch.functions.markup import with_page_fields
from newswatch.operators import extract


def test_pieces_are_stretches_of_bounded_text():
    texts = pa.array(["a" * 10, None, "b" * 25, "", "c" * 3, "d" * 3])
    assert list(dom.pieces(texts, 16)) == [(0, 2), (2, 6)]
    assert list(dom.pieces(pa.array([], pa.string()))) == []
    covered = [k for a, b in dom.pieces(pa.array(["x" * n for n in range(100)]), 50) for k in range(a, b)]
    assert covered == list(range(100))


class Pages:
    """Takes the step of ``page_reads`` in place of a table."""

    def select(self, *_):
        return self

    def mapInArrow(self, step, _):
        return step


def test_reading_a_batch_of_pages_holds_a_piece_at_a_time():
    links = "".join(f'<a href="/news/{k}">Item {k}</a>' for k in range(40))
    step = extract.page_reads(Pages())

    def peak(n):
        batch = pa.RecordBatch.from_pydict({"url": [f"u{k}" for k in range(n)], "html": [f"<body>{links}<p>{'text ' * 400}</p></body>"] * n})
        tracemalloc.start()
        rows = sum(out.num_rows for out in step(iter([batch])))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n
        return top

    assert peak(8000) < 1.5 * peak(2000)


def test_links_and_items_are_the_same_without_fields():
    page = '<title>T</title><meta name="pubdate" content="2024-01-01"><div class="news"><a href="/a">x &amp; <b>y</b></a><time>1<a href="/b">z</a></time></div><p>p</p>'
    page += '<script type="application/ld+json">{"a": 1}</script><article>text <a href="/c"></a></article>'
    whole, short = dom.one_pass(page), dom.one_pass(page, fields=False)
    assert (whole.anchors, whole.items) == (short.anchors, short.items) and len(short.anchors) == 3 and short.text is None


def test_filters_on_computed_fields_do_not_repeat_them(spark):
    anchors = spark.createDataFrame([], "url string, pos long, href string, text string, container long")
    plan = extract.listing_links(anchors)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") < 60
    pages = with_page_fields(spark.createDataFrame([], "url string, html string"))
    plan = pages.where(F.coalesce("page_date", F.lit(None)) > F.lit("2024-01-01").cast("timestamp_ntz"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in next(line for line in plan.split("\n") if "Filter" in line)
