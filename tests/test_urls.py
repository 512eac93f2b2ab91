"""URL expressions: literal edge cases and a brute-force comparison with the
standard library's URL parser on every stored page URL."""

import os
from urllib.parse import quote, urlparse

import pytest
from pyspark.sql import functions as F

from webrake.functions import urls as U


def _eval(spark, expr, *vals, schema="a string, b string"):
    rows = [tuple(v) if isinstance(v, tuple) else (v, None) for v in vals]
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def py_key(url, include_query=False, no_ext=False):
    """Brute force from the standard library: key = netloc + path with
    slashes as underscores (+ query), ``.html`` when splitext finds none."""
    parts = urlparse(url)
    name = parts.path.replace("/", "_") + (parts.query if include_query else "")
    if not no_ext and os.path.splitext(name)[1] == "":
        name = name + ".html"
    return parts.netloc + name


@pytest.mark.parametrize("url,kw,expected", [
    ("https://www.google.com/search?q=python", {}, "www.google.com_search.html"),
    ("http://h", {}, "h.html"),
    ("http://h/a.b/c", {}, "h_a.b_c"),
    ("http://u:p@h:80/x.", {}, "u:p@h:80_x."),
    ("http://h/a;p?q", {}, "h_a.html"),
    ("http://h/s?q=1", {"include_query": True}, "h_sq=1.html"),
    ("http://h/s", {"no_ext": True}, "h_s"),
])
def test_url_key_edges(spark, url, kw, expected):
    assert _eval(spark, U.url_key(F.col("a"), **kw), url) == [expected]
    assert py_key(url, **kw) == expected


TRICKY = [
    "http://h/a/b.c/d", "https://h/.hidden", "https://h/..x", "https://h/a.", "http://h/a;x/b;y",
    "//net/path", "relative/path.x", "/abs?x=/y.z", "http://h/p?next=/a/b", "http://h/p?x=1#f.g",
    "http://h#frag?x", "mailto:a@b", "HTTP://H/A", "http://h:8080", "http://h/a%20b", "ftp://h/f;type=a",
    "a_b://h/x",
]


def test_url_key_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url")
    urls = [r.url for r in pages.collect()] + TRICKY
    df = spark.createDataFrame([(u,) for u in urls], "a string")
    for kw in ({}, {"include_query": True}, {"no_ext": True}):
        got = [r.x for r in df.select(U.url_key("a", **kw).alias("x")).collect()]
        want = [py_key(u, **kw) for u in urls]
        bad = [(u, g, w) for u, g, w in zip(urls, got, want) if g != w]
        assert not bad, bad[:5]


def test_url_param_last_wins(spark):
    got = _eval(spark, U.url_param(F.col("a"), "user"),
                "/c?user=A&user=B", "/c?xuser=A", "https://s.org/citations?hl=en&user=Q1")
    assert got == ["B", None, "Q1"]


def test_strip_query(spark):
    assert _eval(spark, U.strip_query(F.col("a")), "http://h/a?b?c", "http://h/a") == ["http://h/a", "http://h/a"]


@pytest.mark.parametrize("link,expected", [
    ("/p", "https://h.org/p"),
    ("p", "https://h.org/a/bp"),
    ("https://z/q", "https://z/q"),
    ("", ""),
])
def test_absolutize(spark, link, expected):
    base = "https://h.org/a/b?x"
    got = _eval(spark, U.absolutize(U.strip_query(F.col("a")), F.col("b")), (base, link))
    assert got == [expected]


def test_url_join_forms(spark):
    from urllib.parse import urljoin
    base = "https://s.org/x/y?z=1"
    links = ["/citations?user=A", "https://o.org/p", "//cdn.org/q", "?user=B", "c?d=1", "#frag",
             "../a", "../../../a", "./b/", ".", "..", "a/./b/../c", "/x/../y", "a//b", "", "/", "/x//y/./z", "../", "g;x?y#s"]
    bases = [base, "https://s.org", "https://s.org/", "https://s.org/a/b/c/", "http://h/a/b.html#t"]
    pairs = [(b, lk) for b in bases for lk in links]
    got = _eval(spark, U.url_join(F.col("a"), F.col("b")), *pairs)
    want = [urljoin(b, lk) for b, lk in pairs]
    bad = [(p, g, w) for p, g, w in zip(pairs, got, want) if g != w]
    assert not bad, bad[:6]


def test_entity_key(spark):
    assert _eval(spark, U.entity_key(F.col("a"), F.col("b")), ("a/b", "c:d"), ("x", None)) == ["a_b-c_d", "x-"]


def test_percent_encode_matches_quote(spark):
    samples = ["a b/c~d*e+f", "Zoë Ωmega &amp; 100%", "name at x.org", "ü/ß?=&#", "plain_text-1.2"]
    got = _eval(spark, U.percent_encode(F.col("a")), *samples)
    assert got == [quote(s) for s in samples]


def test_url_param_required_fails_on_missing(spark):
    df = spark.createDataFrame([("/c?user=A",), ("/c?x=1",)], "a string")
    with pytest.raises(Exception):
        df.select(U.url_param("a", "user", required=True).alias("x")).collect()
    ok = spark.createDataFrame([("/c?user=A",)], "a string")
    assert ok.select(U.url_param("a", "user", required=True).alias("x")).first().x == "A"
