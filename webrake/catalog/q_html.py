"""Registered queries: HTML cleaning, text and field extraction (T25-T27)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webrake.catalog import query, table
from webrake.catalog import sqlfrag as S
from webrake.functions import html as H
from webrake.operators import dom
from webrake.operators.dom import Field


@query("html_drop_blocks", f"""
SELECT page_id, {S.drop_blocks('html')} AS html FROM pages""")
def q_html_drop_blocks(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.drop_blocks("html").alias("html"))


@query("html_drop_attrs", f"""
SELECT page_id, {S.drop_attrs(S.drop_blocks('html'))} AS html FROM pages""")
def q_html_drop_attrs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.clean_html_native("html").alias("html"))


@query("html_to_text", f"""
SELECT page_id, {S.strip_tags(S.drop_blocks('html'))} AS text FROM pages""")
def q_html_to_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.html_text_native("html").alias("text"))


@query("html_title", f"""
SELECT page_id, {S.html_title('html')} AS title, {S.first_paragraph('html')} AS snippet FROM pages""")
def q_html_title(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.html_title("html").alias("title"),
                    H.first_paragraph("html").alias("snippet"))


@query("html_links", f"""
WITH l AS (SELECT page_id, {S.html_links('html')} AS links FROM pages)
SELECT page_id, CAST(len(links) AS INTEGER) AS n_links, array_to_string(links, '|') AS links FROM l""")
def q_html_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    links = H.html_links("html")
    return p.select("page_id", F.size(links).alias("n_links"), F.array_join(links, "|").alias("links"))


_AD_RE = r'(?is)<div\s[^>]*class="(?:[^"]*\s)?ad(?:\s[^"]*)?"[^>]*>(.*?)</div\s*>'


@query("html_fields", f"""
WITH x AS (SELECT page_id, regexp_extract_all(html, {S.q(_AD_RE)}, 1) AS ads FROM pages)
SELECT page_id, coalesce({S.strip_tags('ads[1]')}, '') AS ad,
       CAST(len(ads) AS INTEGER) AS n_ads FROM x""")
def q_html_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    f = H.extract_fields("html", {"ad": ("div", "ad", False), "ads": ("div", "ad", True)})
    return p.select("page_id", f["ad"].alias("ad"), F.size(f["ads"]).alias("n_ads"))


_ANCHOR_RE = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a\s*>'


@query("html_anchors", f"""
WITH n AS (SELECT page_id, {S.element_text(S.drop_blocks('html', ['script']), 'nav')} AS body FROM pages),
x AS (SELECT page_id, unnest(regexp_extract_all(body, {S.q(_ANCHOR_RE)}, 2)) AS name,
             unnest(regexp_extract_all(body, {S.q(_ANCHOR_RE)}, 1)) AS url,
             unnest(generate_series(0, len(regexp_extract_all(body, {S.q(_ANCHOR_RE)}, 1)) - 1)) AS link_no FROM n)
SELECT page_id, CAST(link_no AS INTEGER) AS link_no, {S.strip_tags('name')} AS name, url FROM x""")
def q_html_anchors(spark, sf_dir):
    """Repeated (name, link) fields inside a container: the links of each
    page's navigation list (the shape of a co-author list)."""
    p = table(spark, sf_dir, "pages")
    x = p.select("page_id", F.posexplode(H.extract_anchors("html", "nav")).alias("link_no", "a"))
    return x.select("page_id", "link_no", F.col("a.name").alias("name"), F.col("a.url").alias("url"))


@query("html_keep_meta", f"""
SELECT page_id, replace(regexp_replace(regexp_replace({S.drop_blocks('html')}, '(?i)<(meta)\\b', '<' || chr(1) || '\\1', 'g'),
         '<([A-Za-z][A-Za-z0-9]*)\\s[^>]*>', '<\\1>', 'g'), '<' || chr(1), '<') AS html
FROM pages""")
def q_html_keep_meta(spark, sf_dir):
    """Cleaning in keep mode: ``<meta>`` keeps its attributes."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.clean_html_native("html", keep_tags=["meta"]).alias("html"))


# stated for the layout of the given pages, apart from the library's patterns
_LI_RE = r"(?is)<li[^>]*>(.*?)</li>"
_A_TEXT = r"(?is)<a[^>]*>(.*?)</a>"
_A_HREF = r'(?is)href="([^"]*)"'


@query("html_blocks", f"""
WITH b AS (SELECT page_id, regexp_extract_all({S.drop_blocks('html', ['script'])}, {S.q(_LI_RE)}, 1) AS bs FROM pages),
x AS (SELECT page_id, unnest(bs) AS blk, unnest(generate_series(0, len(bs) - 1)) AS block_no FROM b)
SELECT page_id, CAST(block_no AS INTEGER) AS block_no,
       {S.strip_tags(f"regexp_extract(blk, {S.q(_A_TEXT)}, 1)")} AS title,
       regexp_extract(blk, {S.q(_A_HREF)}, 1) AS url
FROM x""")
def q_html_blocks(spark, sf_dir):
    """Repeated multi-field records, one per block element (the shape of a
    search-result list): each list item's link text and target."""
    p = table(spark, sf_dir, "pages")
    blocks = H.extract_blocks("html", "li", None, {"title": ("a", None), "url": ("a", "href")})
    x = p.select("page_id", F.posexplode(blocks).alias("block_no", "b"))
    return x.select("page_id", "block_no", F.col("b.title").alias("title"), F.col("b.url").alias("url"))


# -- selectors over the node table: the statements cut the given layout with
# string functions, the library nests tags by running sums
_NAV = "split_part(split_part(html, '<nav>', 2), '</nav>', 1)"
_ARTICLE = "split_part(split_part(html, '<article>', 2), '</article>', 1)"


def _between(text, first, last):
    return f"split_part(split_part({text}, '{first}', 2), '{last}', 1)"


@query("html_select", f"""
WITH x AS (SELECT page_id, {_ARTICLE} AS art, string_split({_NAV}, '<li>')[2:] AS items,
                  string_split({_ARTICLE}, '<p>')[2:] AS paras, split_part(html, '<footer>', 2) AS foot,
                  string_split(html, '<div class="ad">')[2:] AS ads FROM pages)
SELECT page_id, {S.strip_tags(_between('art', '<h1>', '</h1>'))} AS heading,
       array_to_string(list_transform(items, lambda i: {S.strip_tags(_between('i', '">', '</a>'))}), '|') AS names,
       array_to_string(list_transform(items, lambda i: {_between('i', '<a href="', '"')}), '|') AS urls,
       array_to_string(list_transform(ads, lambda i: {S.strip_tags("split_part(i, '</div>', 1)")}), '|') AS ads,
       CAST(len(paras) AS INTEGER) AS n_paragraphs,
       array_to_string(list_transform(paras, lambda i: {S.strip_tags("split_part(i, '</p>', 1)")}), '|') AS paragraphs,
       {S.strip_tags("split_part(foot, '</footer>', 1)")} AS footer
FROM x""")
def q_html_select(spark, sf_dir):
    """Class, attribute and descendant selectors over every page's node table;
    the article's first paragraph has no end tag."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    x = dom.extract_fields(p, ["page_id"], {
        "heading": Field("article h1"), "names": "nav ul li a", "urls": Field("nav li a[href]", "href", many=True),
        "ads": "body div.ad", "paras": "article p", "footer": Field("html body footer")})
    return x.select("page_id", "heading", F.array_join("names", "|").alias("names"), F.array_join("urls", "|").alias("urls"),
                    F.array_join("ads", "|").alias("ads"), F.size("paras").alias("n_paragraphs"),
                    F.array_join("paras", "|").alias("paragraphs"), "footer")


@query("html_records", f"""
WITH x AS (SELECT page_id, unnest(string_split({_NAV}, '<li>')[2:]) AS i,
                  unnest(range(len(string_split({_NAV}, '<li>')) - 1)) AS block_no FROM pages)
SELECT page_id, CAST(block_no AS INTEGER) AS block_no, {S.strip_tags(_between('i', '">', '</a>'))} AS title,
       {_between('i', '<a href="', '"')} AS url, '' AS snippet FROM x""")
def q_html_records(spark, sf_dir):
    """Repeated records by selectors (the shape of a search-result list):
    fields are looked for inside of each block."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return dom.extract_records(p, ["page_id"], "nav ul li", {
        "title": Field("a"), "url": Field("a", "href"), "snippet": Field("span")})


@query("html_nodes", """
WITH x AS (SELECT page_id, html, string_split(split_part(split_part(html, '<nav>', 2), '</nav>', 1), '<a ')[2:] AS a FROM pages)
SELECT page_id, CAST(k AS INTEGER) AS k, 'a' AS tag, '<a ' || split_part(a[k], '>', 1) || '>' AS start_tag,
       CAST(1 AS INTEGER) AS tokens, CAST(2 * (k - 1) AS INTEGER) AS li_ends
FROM x, unnest(range(1, len(a) + 1)) AS r(k)""")
def q_html_nodes(spark, sf_dir):
    """The links of every navigation list in the node table: their number in
    page order, the tokens they span and how many list items and links end
    before them (by ``post``)."""
    n = dom.nodes(table(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"])
    links = n.where("tag = 'a'")
    ended = n.where("tag in ('a', 'li')").select("page_id", F.col("post").alias("at"), F.lit(0).alias("link"))
    both = links.select("page_id", F.col("pre").alias("at"), F.lit(1).alias("link"), "tag", "start_tag", "post") \
        .unionByName(ended, allowMissingColumns=True)
    so_far = Window.partitionBy("page_id").orderBy("at", "link").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("k", F.sum("link").over(so_far)).withColumn("li_ends", F.sum(1 - F.col("link")).over(so_far))
    return out.where("link = 1").select("page_id", F.col("k").cast("int").alias("k"), "tag", "start_tag",
                                        (F.col("post") - F.col("at")).cast("int").alias("tokens"),
                                        F.col("li_ends").cast("int").alias("li_ends"))
