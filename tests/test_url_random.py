"""Randomised brute force: URL expressions against the standard library on
generated URLs (one DataFrame per check, fixed seed)."""

import os
import random
from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from webrake.functions import urls as U

SEGS = ["a", "b.c", "x.", ".h", "..", ".", "s;p", "e%20f", "", "idx.html", "z~y"]
QUERIES = ["", "?q=1", "?user=A&user=B", "?a=/b.c", "?x", "?user=", "?k=v&user=U1#f"]
FRAGS = ["", "#top", "#a?b"]


def _url(rnd):
    scheme = rnd.choice(["http://", "https://", "HTTP://", "//", "", "ftp://", "mailto:"])
    host = rnd.choice(["h", "a.b.org", "u:p@h:8080", "h:80", ""]) if scheme.endswith("//") else ""
    path = "/".join(rnd.choice(SEGS) for _ in range(rnd.randint(0, 4)))
    if scheme.endswith("//") and path and not path.startswith("/"):
        path = "/" + path
    return scheme + host + path + rnd.choice(QUERIES) + rnd.choice(FRAGS)


def _py_key(url, include_query=False, no_ext=False):
    p = urlparse(url)
    name = p.path.replace("/", "_") + (p.query if include_query else "")
    if not no_ext and os.path.splitext(name)[1] == "":
        name += ".html"
    return p.netloc + name


def _py_param(url, name):
    vals = [kv.split("=", 1)[1] for kv in urlparse(url).query.split("&")
            if "=" in kv and kv.split("=", 1)[0] == name]
    return vals[-1] if vals else None


def test_random_url_keys_and_params(spark):
    rnd = random.Random(2024)
    urls = sorted({_url(rnd) for _ in range(2500)})
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    out = df.select("u", U.url_key("u").alias("k"), U.url_key("u", include_query=True).alias("kq"),
                    U.url_key("u", no_ext=True).alias("kn"), U.url_param("u", "user").alias("p")).collect()
    bad = [(r.u, r.k, _py_key(r.u)) for r in out if r.k != _py_key(r.u)]
    bad += [(r.u, r.kq, _py_key(r.u, include_query=True)) for r in out
            if r.kq != _py_key(r.u, include_query=True)]
    bad += [(r.u, r.kn, _py_key(r.u, no_ext=True)) for r in out if r.kn != _py_key(r.u, no_ext=True)]
    bad += [(r.u, r.p, _py_param(r.u, "user")) for r in out if r.p != _py_param(r.u, "user")]
    assert not bad, bad[:5]


def test_random_url_join(spark):
    rnd = random.Random(7)
    bases = ["https://s.org/x/y?z=1", "http://h/a/b/c.html#t", "https://s.org", "https://s.org/d/"]
    links = set()
    for _ in range(1500):
        path = "/".join(rnd.choice(["a", "..", ".", "b.c", "", "d"]) for _ in range(rnd.randint(1, 4)))
        lead = rnd.choice(["", "/", "./", "../"])
        links.add(lead + path + rnd.choice(["", "?q=1", "#f"]))
    pairs = sorted((b, lk) for b in bases for lk in links)
    df = spark.createDataFrame(pairs, "b string, l string")
    got = [r.j for r in df.select(U.url_join("b", "l").alias("j")).collect()]
    bad = [(p, g, urljoin(*p)) for p, g in zip(pairs, got) if g != urljoin(*p)]
    assert not bad, bad[:5]
