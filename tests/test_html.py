"""HTML cleaning: native and parser variants, idempotence, markdown."""

from webrake.functions import html as H
from webrake.operators.htmlclean import clean_and_convert, clean_pages

EDGE = "<p class=a>x<script>y</script></p>"


def test_clean_edge_native_and_parser(spark):
    df = spark.createDataFrame([(EDGE,)], "h string")
    assert df.select(H.clean_html_native("h").alias("c")).first().c == "<p>x</p>"
    assert clean_and_convert(EDGE)[0] == "<p>x</p>"


def test_parser_keeps_comments_and_text_drops_blocks():
    html = ('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>'
            '<body><!-- ad --><h1 id=x>Head</h1><ul><li><a href="/a">A</a></li></ul>'
            '<p>one<img src=x.png>two</p><code>c()</code><svg><g></g></svg></body></html>')
    clean, md = clean_and_convert(html)
    assert "<script" not in clean and "<style" not in clean and "<img" not in clean
    assert "<svg" not in clean and "<code" not in clean and 'id=' not in clean
    assert "<!-- ad -->" in clean and "onetwo" in clean
    assert "# Head" in md and "- [A](/a)" in md


def test_parser_keep_meta_attrs():
    html = '<head><meta charset="utf-8"><meta name="k" content="v"></head><p class="z">t</p>'
    clean, _ = clean_and_convert(html, keep={"meta": None})
    assert '<meta charset="utf-8"/>' in clean and '<p>' in clean


def test_clean_pages_idempotent_and_complete(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    once = clean_pages(pages.select("page_id", "html"))
    twice = clean_pages(once.select("page_id", once.clean_html.alias("html")))
    a = {r.page_id: r.clean_html for r in once.collect()}
    b = {r.page_id: r.clean_html for r in twice.collect()}
    assert a == b
    assert len(a) == pages.count()
    assert all("<script" not in v for v in a.values())


def test_native_text_has_no_tags(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = pages.select(H.html_text_native("html").alias("t"), H.html_title("html").alias("ti")).collect()
    assert all("<p>" not in r.t and "<script" not in r.t and "</a>" not in r.t for r in rows)
    assert all(r.ti for r in rows)
