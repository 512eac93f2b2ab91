"""HTML extraction, URL filters and WARC archives."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from webrake.llm import html_extract, urltree, warc
from webrake.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return html_extract.train(spark.read.parquet(f"{SF}/pages.parquet"))


def plain_article(page):
    """The article of the given pages, by their own fixed layout."""
    import html
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split())
                                 for p in parts) if x)


def test_every_given_page(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_extract.extract(pages, model).join(pages, "page_id").select("text", "n_chars", "html").collect()
    assert rows and all(r.text == plain_article(r.html) and r.n_chars == len(r.text) for r in rows)


LONG = "This is a sentence of the story that is long enough to be prose, with commas, and more. " * 4
WRAP = ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "<div id='main-content'>{}</div>",
        "<main><section>{}</section></main>", "<div class='post'><div>{}</div></div>"]


@pytest.mark.parametrize("wrap", WRAP)
def test_layouts(model, wrap):
    page = ("<html><head><title>T</title><style>p{}</style></head><body class='has-footer'><header><h1>Site</h1></header>"
            "<nav><ul><li><a href=/a>Home</a><li><a href=/b>About</a></ul></nav>"
            "<div class='cookie-notice'><p>We use cookies.</p></div>"
            + wrap.format(f"<h1>Title &amp; more</h1><p>{LONG}</p><p>Short  &lt;b&gt;\n one&nbsp;two.</p><ul><li>x<li>y</ul>"
                          f"<script>var a='<p>no</p>';</script><div class='ad'>Buy now</div><p class=x>{LONG}"
                          f"<section class=comments><p>{LONG}</p><form>Reply <input></form></section>")
            + f"<aside class=sidebar><p>{LONG}</p></aside><footer>&copy; 2020 <p>{LONG}</p></footer></body></html>")
    want = "\n".join(["Title & more", LONG.strip(), "Short <b> one two.", "x", "y", LONG.strip()])
    assert html_extract.main_text(page, model) == want


def test_broken_and_odd_markup(model):
    f = lambda body: html_extract.main_text(f"<article>{body}</article>", model)
    assert f(f"<p>{LONG}<svg/><p>after</p>").endswith("\nafter")
    assert f(f"<p a=\"x>y\" b='<p>'>{LONG}</p>") == LONG.strip()
    assert f(f"<p>{LONG}<b>bold</p><p>Hello <i>big</i> world <!-- no > --> end").endswith("bold\nHello big world end")
    assert f(f"<p>{LONG}</p>1 < 2 && 3 > 2 &unknown; &#65;&#x42;").endswith("1 < 2 && 3 > 2 &unknown; AB")
    assert f("<p>only short") in ("only short", "")
    for odd in (None, "", "<", "<p", "<!--", "<script>", "</p></p>", "<a <b \"> '", "\x00", "<" * 3000, "<p>" * 3000):
        assert isinstance(html_extract.main_text(odd, model), str)


def test_marginals_are_exact(model):
    """Sum-product against summing over all labellings."""
    import itertools
    tree = html_extract.Tree("<nav><a>x</a></nav><article><p>" + LONG + "</p><div class=ad>buy</div></article>")
    n, total, ones = len(tree.tag), 0.0, [0.0] * len(tree.tag)
    for labels in itertools.product((0, 1), repeat=n - 1):
        y, w = (0, *labels), 1.0
        for i in range(1, n):
            e = model.edge[html_extract.kind_of(tree.tag[i]), tree.hint[i]]
            size, link = tree.evidence(i)
            kind = html_extract.kind_of(tree.tag[i])
            w *= e[2 * y[tree.parent[i]] + y[i]] * model.size[kind][size][y[i]] * model.link[kind][link][y[i]]
        total += w
        for i in range(n):
            ones[i] += w * y[i]
    assert model.marginals(tree) == pytest.approx([x / total for x in ones])


def test_extract_edges(spark, model):
    rows = [(1, None, "u"), (None, "", None), (2, "<p>x", "u"), (2, "<p>x", "u")]
    df = spark.createDataFrame(rows, "page_id int, html string, url string").withColumn("text", F.lit("clash"))
    got = html_extract.extract(df, model).collect()
    assert len(got) == 4 and got[0].text == "" and got[0].n_chars == 0
    empty = df.where("false")
    assert html_extract.extract_main_text(empty).count() == 0       # no labelled page at all


def slow_rule(host, path):
    best = None
    for r in URL_RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
            if best is None or len(r.target) > len(best.target):
                best = r
    return best


def test_url_filter_brute_force(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://Example.ORG/es/1?x", "http://a.example.org/en/12", "x://org",
            "http://b.org/", "http://borg/", "http://c.com/fr/x#y", "http://c.com/de", "http://c.com/de/", "a://b://c/d",
            "http://h.org?q=/es/", "http://example.org/en/2/1", "http://é.com/de/ü", "http://x.com/a\nb/c"]
    urls += [f"http://s.com/{d}/{i}" for d in ("fr", "de", "en") for i in range(30)]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id int, url string, _rule string")
    df = df.unionByName(df.where("page_id < 9"))
    got = urltree.url_filter(df, URL_RULES).collect()
    assert len(got) == len(urls) + 9
    for r in got:
        u = r.url or ""
        rest = u.partition("://")[2] if "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        rule = slow_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.target if rule else None), u
        assert r.verdict == (rule.verdict if rule else r.verdict) and r.verdict in ("allow", "block")
    unlabelled = [r for r in got if r.path.startswith("/en/") and r.host == "s.com"]
    assert {r.template for r in unlabelled} == {"/en/*"} and {r.verdict for r in unlabelled} == {"allow"}
    assert urltree.url_filter(df.where("false"), URL_RULES).count() == 0


def test_template_purity_rejects_bad_branches(spark):
    """An unlabelled page below a branch whose labelled pages are blocked."""
    rules = [urltree.Rule("block", "h.net/bad/1"), urltree.Rule("allow", "h.net/good/1")]
    urls = [f"http://h.net/{b}/{d}{i}" for b in ("good", "bad") for d in (1, 2) for i in range(40)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.verdict for r in urltree.url_filter(df, rules).collect()}
    assert {v for u, v in got.items() if "/bad/" in u} == {"block"}
    assert {v for u, v in got.items() if "/good/" in u} == {"allow"}
    # many different names below one node become a wildcard, few do not
    names = "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([("h", f"/u/{a}{b}/p") for a in names for b in "xy"] + [("h", "/about")],
                               "host string, path string")
    t = {tuple(r.template) for r in urltree.template_tree(df).collect()}
    assert t == {("u", "*", "p"), ("about",)}


def slow_tree(paths, z=1.96, weight=4.0):
    """{(host, path): (template, purity)} by recursion over plain dicts;
    ``paths``: {(host, path): (labelled, blocked)}."""
    out = {}
    general = lambda x: "*" if re.search("[0-9]", x) else x
    total = lambda group: tuple(sum(x) for x in zip(*(v for _, _, v in group)))

    def grow(host, node, group, level, purity):
        going = []
        for path, seg, v in group:
            if len(group) == 1 or len(seg) <= level:
                out[host, path] = (node + tuple(map(general, seg[level:])), purity)
            else:
                going.append((path, seg, v))
        if not going:
            return
        kids = {}
        for x in going:
            kids.setdefault(general(x[1][level]), []).append(x)
        if len(kids) >= 20 and len(kids) > 0.5 * len(going):
            kids = {"*": going}
        nl, nb = total(going)
        own = {}
        for name, xs in kids.items():
            l, b = total(xs)
            p1, p2, p = (b + 1) / (l + 2), (nb - b + 1) / (nl - l + 2), (nb + 1) / (nl + 2)
            own[name] = l > 0 and abs(p1 - p2) / (p * (1 - p) * (1 / (l + 2) + 1 / (nl - l + 2))) ** 0.5 > z
        rest = [n for n in kids if not own[n]]
        branches = {n: kids[n] for n in kids if own[n] or len(rest) == 1 or not nl}
        if len(rest) > 1 and nl:
            branches["~"] = [x for n in rest for x in kids[n]]
        for name, xs in branches.items():
            l, b = total(xs)
            grow(host, (*node, name), xs, level + 1, purity if l == nl else (b + weight * purity) / (l + weight))

    for host in {h for h, _ in paths}:
        group = [(p, [x for x in p.split("/") if x], v) for (h, p), v in paths.items() if h == host]
        l, b = total(group)
        grow(host, (), group, 0, (b + weight * 0.25) / (l + weight))
    return out


def test_template_tree_brute_force(spark):
    """Random trees of any depth, labels that follow some branches, a wide node."""
    rng, paths = random.Random(21), {}
    for host in ("a", "b", "hot"):
        for _ in range(500 if host == "hot" else 100):
            seg = [rng.choice(["blog", "news", "shop"])]
            while rng.random() < 0.6 and len(seg) < 8:
                seg.append(rng.choice(["spam", "ok", "x", "y", f"p{rng.randrange(9)}", f"n{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]))
            bad = "spam" in seg and seg[0] != "shop"
            label = rng.random() < 0.4
            paths[host, "/" + "/".join(seg) + rng.choice(["", "/", "//"])] = (int(label), int(label and rng.random() < (0.95 if bad else 0.05)))
    paths["none", ""] = paths["none", "/"] = paths["none", "/" + "deep/" * 60] = paths["none", "/" + "deep/" * 30] = (0, 0)
    df = spark.createDataFrame([(h, p, *v) for (h, p), v in paths.items()], "host string, path string, n_label long, n_block long")
    rows = urltree.template_tree(df).collect()
    want = slow_tree(paths)
    assert len(rows) == len(want)
    for r in rows:
        template, purity = want[r.host, r.path]
        assert tuple(r.template) == template and abs(r.purity - purity) < 1e-9, (r.host, r.path)
    assert {"~", "*", "spam"} <= {x for t, _ in want.values() for x in t}


def test_siblings_are_told_apart_at_any_depth(spark):
    """Blocked and allowed pages two levels down, unlabelled ones in both."""
    for top in ("/blog", "/a/b/c/d/e/f/g/h"):
        rules = [urltree.Rule("block", f"h.net{top}/spam/1"), urltree.Rule("allow", f"h.net{top}/news/1")]
        urls = [f"http://h.net{top}/{b}/{d}{i:02d}" for b in ("spam", "news") for d in (1, 2) for i in range(15)]
        got = urltree.url_filter(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
        assert {r.verdict for r in got if "/spam/" in r.url} == {"block"}
        assert {r.verdict for r in got if "/news/" in r.url} == {"allow"}


def test_warc_round_trip(spark, tmp_path):
    body = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n</p>" + "x" * 100
    big = "y" * 5_000_000
    rows = [(4, "http://a/ b\n", body), (2, None, body), (9, "u", body), (7, "u", "short"), (8, "u", "short"), (1, "u", None),
            (3, "u", ""), (5, "u", big), (6, "u", big + "z"), (None, "u", body), (11, "u", "m" * 70_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    for comp in ("none", "gzip"):
        path = str(tmp_path / comp)
        warc.write_archive(df.repartition(3), path, compression=comp)
        got = warc.read_archive(spark, path, with_content=True).collect()
        by = {r.row_id: r for r in got}
        assert len(got) == len(rows) == len(by)
        for i, _, h in rows:
            r, raw = by[None if i is None else str(i)], (h or "").encode()
            revisit = h == body and i != 2
            assert r.record_type == ("revisit" if revisit else "response")
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            assert r.content == (b"" if revisit else raw) and r.refers_to_row == ("2" if revisit else None)
            if revisit:
                assert r.refers_to_record == by["2"].record_id
        assert by["4"].target_uri == "http://a/%20b%0A"
    warc.write_archive(df.where("false"), str(tmp_path / "empty"))
    assert warc.read_archive(spark, str(tmp_path / "empty")).count() == 0


def test_warc_parser_refuses_damage():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [c for _, c in warc.parse(good * 2)] == [b"abc", b"abc"]
    for bad in (good[:-1], good[:20], b"HTTP" + good, good.replace(b": 3", b": 2")):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
