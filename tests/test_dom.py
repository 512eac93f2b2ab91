"""Node table and selectors against an HTML-parser brute force."""

import random
from html.parser import HTMLParser

import pytest

from webrake.operators import dom
from webrake.operators.dom import Field
from webrake.plans import profiles as PF

KEY = "id long, html string"


class Tree(HTMLParser):
    """Elements by a stack: an end tag closes the last open element of its
    name and what is open inside of it; ends left out are implied."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.open, self.all = [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in dom.IMPLIED_END and self.open and self.open[-1][0] == tag:
            self.open.pop()
        e = (tag, dict(attrs), [x for x in self.open], [])
        self.all.append(e)
        if tag not in dom.VOID:
            self.open.append(e)

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        for e in self.open if self.open and self.open[-1][0] != "script" else ():
            e[3].append(data)

    def texts(self, selector):
        return [" ".join(" ".join(e[3]).split()) for e in self.select(selector)]

    def select(self, selector):
        steps = dom.parse_selector(selector)
        return [e for e in self.all if fits(e, steps[-1]) and has(e[2], steps[:-1])]


def fits(e, step):
    attrs = {k: v or "" for k, v in e[1].items()}
    return ((not step.tag or e[0] == step.tag) and (not step.id or attrs.get("id") == step.id)
            and set(step.classes) <= set(attrs.get("class", "").split())
            and all(k in attrs and (v is None or attrs[k] == v) for k, v in step.attrs))


def has(path, steps):
    """Whether ``steps`` match elements of ``path``, outermost first."""
    for e in path:
        if steps and fits(e, steps[0]):
            steps = steps[1:]
    return not steps


def random_page(rng, depth=0):
    """Properly nested elements with equal names inside one another, void
    elements, list items and paragraphs without end tags, stray end tags."""
    out = []
    for _ in range(rng.randint(0, 4 if depth < 5 else 1)):
        kind = rng.random()
        if kind < 0.3:
            out.append(rng.choice(["one", " two ", "3 &lt; 4", "a < b", "<!-- <div> -->", "<script>'</div>'</script>", "é"]))
        elif kind < 0.4:
            out.append(rng.choice(["<br>", "<img src='x>y'>", "<hr/>", "</span>", "</section>"]))
        elif kind < 0.5:
            items = "".join(f"<li class=i{rng.randint(0, 2)}>" + rng.choice(["x", "<a href=/l>l</a>", "<b>y</b>"]) for _ in range(3))
            out.append(f"<ul id=l{rng.randint(0, 2)}>{items}</ul>")
        else:
            tag = rng.choice(["div", "div", "div", "a", "UL", "em"])
            cls = rng.choice(["", " class='ad'", ' class="x  ad y"', " id=main", ' class="bad" data-id=main', " href='/q?a=1&amp;b=2' class=ad"])
            out.append(f"<{tag}{cls}>{random_page(rng, depth + 1)}</{tag.lower()}>")
    return "".join(out)


SELECTORS = ["div", "div.ad", "div div.ad", "div.ad a", "#main", "div#main div", "a.ad[href]", "a[href=/l]", "ul li a",
             ".ad.x", "li", "li.i1", "ul#l1 li", "div div div", "* em", "[data-id]"]


def test_selectors_brute_force(spark):
    rng = random.Random(11)
    pages = [(i, random_page(rng)) for i in range(150)] + [(1000, None), (1001, "")]
    fields = {f"s{k}": s for k, s in enumerate(SELECTORS)} | {"first": Field("div.ad a"), "href": Field("a", "href", many=True)}
    got = {r.id: r for r in dom.extract_fields(spark.createDataFrame(pages, KEY).repartition(4), ["id"], fields).collect()}
    hits = 0
    for i, html in pages:
        tree = Tree(html or "")
        for k, s in enumerate(SELECTORS):
            assert got[i][f"s{k}"] == tree.texts(s), (s, html)
            hits += len(got[i][f"s{k}"])
        assert got[i]["first"] == (tree.texts("div.ad a") or [""])[0]
        assert got[i]["href"] == [e[1].get("href") or "" for e in tree.select("a")]
    assert hits > 500


def test_nodes_brute_force(spark):
    rng = random.Random(12)
    pages = [(i, random_page(rng)) for i in range(60)]
    rows = dom.nodes(spark.createDataFrame(pages, KEY), ["id"]).orderBy("id", "pre").collect()
    for i, html in pages:
        mine = [r for r in rows if r.id == i]
        tree = [e for e in Tree(html).all if e[0] != "script"]
        assert [r.tag for r in mine] == [e[0] for e in tree], html
        # ancestors by intervals are the parser's
        for r, e in zip(mine, tree):
            around = [a for a in mine if a.pre < r.pre < a.post]
            assert [a.tag for a in around] == [x[0] for x in e[2]], html
            assert r["classes"] == (e[1].get("class") or "").split() and r.element_id == e[1].get("id")


def test_nested_equal_tags_and_crossing(spark):
    html = "<div class=ad><div>one</div> two</div><p>a<p>b</p>c<b>x<i>y</b>z</i><td>1<td>2"
    df = spark.createDataFrame([(1, html)], KEY)
    r = dom.extract_fields(df, ["id"], {"ad": Field("div.ad"), "inner": "div div", "p": "p", "b": "b", "i": "i", "td": "td"}).first()
    assert (r.ad, r.inner, r.p, r.b, r.td) == ("one two", ["one"], ["a", "b"], ["x y"], ["1", "2"])
    assert r.i == ["y z"]           # crossing tags keep their own ends


def test_records(spark):
    block = lambda k, extra="": f"<div class=g jscontroller jsaction=x><div><h3>t{k}</h3></div><a href=/{k}>u</a>{extra}</div>"
    html = f"<div id=search><h3>no</h3>{block(1, '<span>s1</span><span>s</span>')}{block(2)}<div class=g><h3>no</h3></div>" \
           f"{block(3, block(4))}</div>{block(5)}"
    rows = dom.extract_records(spark.createDataFrame([(1, html), (2, "<p>none"), (3, None)], KEY), ["id"],
                               "div#search div.g[jscontroller][jsaction]",
                               {"title": Field("h3"), "url": Field("a", "href"), "snippet": Field("span"),
                                "all": Field("h3", many=True)}).orderBy("block_no").collect()
    assert [(r.id, r.block_no, r.title, r.url, r.snippet, r["all"]) for r in rows] == [
        (1, 0, "t1", "/1", "s1", ["t1"]), (1, 1, "t2", "/2", "", ["t2"]), (1, 2, "t3", "/3", "", ["t3", "t4"])]


def test_profile_page(spark):
    html = """<div id=gsc_prf_in>Ann <b>Lee</b></div><div id="gsc_prf_w">Prof<br>mail at x.org</div>
    <a class="gsc_prf_ila" href="http://h/">Homepage</a><a class="gsc_prf_inta gs_ibl" href=#>ml</a>
    <a class="gs_ibl gsc_prf_inta">db</a><a class=gs_ibl>no</a><a class=gsc_a_at>Paper &amp; one</a>
    <table id=gsc_rsb_st><tr><td>Citations<td>10<td>5</table>
    <ul class="gsc_rsb_a x"><li><span><a href="/u?user=B&amp;hl=en">Bo</a></span><li><a href=/c>Cy</a></ul><ul><li><a>no</a></ul>"""
    df = spark.createDataFrame([("a", html), ("b", "<p>nothing")], "uid string, html string")
    a, b = PF.parse_profiles(df).orderBy("uid").collect()
    assert (a.name, a.brief, a.homepage, a.articles, a.tags) == ("Ann Lee", "Prof mail at x.org", "http://h/", ["Paper & one"], ["ml", "db"])
    assert a.cited_stats == "Citations 10 5"
    assert [tuple(c) for c in a.co_authors] == [("Bo", "/u?user=B&hl=en"), ("Cy", "/c")]
    assert (b.name, b.homepage, b.articles, b.co_authors) == ("", "", [], [])
    old = spark.createDataFrame([("a", '[{"name": ["B"], "url": "/b"}]', ["old"]), ("z", None, ["old"])],
                                "uid string, co_authors_json string, articles array<string>")
    rows = {r.uid: r for r in PF.refresh_profiles(old, df).collect()}
    assert rows["a"].articles == ["Paper & one"] and rows["a"].tags == ["ml", "db"] and rows["a"].co_authors[0].name == "B"
    assert rows["z"].articles == [] and rows["z"].co_authors == []


def test_long_and_odd_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    odd = "<" * 20000 + "<a href='" + "q" * 50000 + "'>l</a>" + "<b title=\"open>y</b>" + "<!--" + "c" * 50000
    rows = spark.createDataFrame([(1, deep), (2, odd)], KEY)
    got = {r.id: r for r in dom.extract_fields(rows, ["id"], {"d": "div", "a": "a"}).collect()}
    assert len(got[1].d) == 3000 and set(got[1].d) == {"x"} and got[2].a == ["l"]


def test_one_exchange(spark):
    df = spark.createDataFrame([(1, "<p>x")], KEY)
    plan = dom.extract_fields(df, ["id"], {"a": "ul li a", "b": Field("p")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 2 and "CartesianProduct" not in plan
    assert plan.count("hashpartitioning(id") == plan.count("Exchange hashpartitioning")


def test_selector_errors():
    for bad in ("", "div > a", "a:first", "a,b"):
        with pytest.raises(ValueError):
            dom.parse_selector(bad)
