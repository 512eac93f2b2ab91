"""Registered queries: URL expressions (T1-T8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, table
from webrake.catalog import sqlfrag as S
from webrake.functions import html as H
from webrake.functions import text as T
from webrake.functions import urls as U


def _pages(spark, sf_dir, with_html=False):
    cols = ["page_id", "url"] + (["html"] if with_html else [])
    return table(spark, sf_dir, "pages").select(*cols)


@query("url_key", f"SELECT page_id, {S.url_key('url')} AS url_key FROM pages")
def q_url_key(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.url_key("url").alias("url_key"))


@query("url_key_query",
       f"SELECT page_id, {S.url_key('url', include_query=True)} AS url_key FROM pages")
def q_url_key_query(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", U.url_key("url", include_query=True).alias("url_key"))


@query("url_key_noext",
       f"SELECT page_id, {S.url_key('url', no_ext=True)} AS url_key FROM pages")
def q_url_key_noext(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.url_key("url", no_ext=True).alias("url_key"))


@query("url_param", f"""
SELECT page_id, {S.url_param('url', 'page')} AS page, {S.url_param('url', 'ref')} AS ref,
       {S.url_param('url', 'utm_source')} AS utm_source
FROM pages""")
def q_url_param(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "page_id", U.url_param("url", "page").alias("page"),
        U.url_param("url", "ref").alias("ref"),
        U.url_param("url", "utm_source").alias("utm_source"))


@query("url_strip_query", "SELECT page_id, split_part(url, '?', 1) AS base FROM pages")
def q_strip_query(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", U.strip_query("url").alias("base"))


_LINKS_SQL = f"""
WITH l AS (
  SELECT page_id, url, {S.html_links('html')} AS links FROM pages),
x AS (
  SELECT page_id, url, unnest(links) AS link, unnest(generate_series(0, len(links) - 1)) AS link_no
  FROM l)
"""


def _links(spark, sf_dir):
    return (_pages(spark, sf_dir, with_html=True)
            .select("page_id", "url", F.posexplode(H.html_links("html")).alias("link_no", "link")))


@query("url_absolutize", _LINKS_SQL + """
SELECT page_id, CAST(link_no AS INTEGER) AS link_no, link,
  CASE WHEN link IS NULL OR link = '' OR starts_with(link, 'http') THEN link
       WHEN starts_with(link, '/') THEN substr(split_part(url, '?', 1), 1, 8)
            || split_part(substr(split_part(url, '?', 1), 9), '/', 1) || link
       ELSE split_part(url, '?', 1) || link END AS abs_url
FROM x""")
def q_absolutize(spark, sf_dir):
    links = _links(spark, sf_dir)
    return links.select("page_id", "link_no", "link",
                        U.absolutize(U.strip_query("url"), "link").alias("abs_url"))


@query("url_join", _LINKS_SQL + f"""
SELECT page_id, CAST(link_no AS INTEGER) AS link_no,
  (CASE WHEN starts_with(link, '/') AND NOT starts_with(link, '//')
        THEN {S.url_part('url', 1)} || '://' || {S.url_part('url', 2)} || link END)
  || '&view_op=list_works&sortby=pubdate' AS open_url
FROM x""")
def q_url_join(spark, sf_dir):
    links = _links(spark, sf_dir)
    return links.select("page_id", "link_no",
                        U.profile_open_url("url", "link").alias("open_url"))


@query("entity_key", f"""
SELECT page_id, regexp_replace({S.url_part('url', 2)} || '-' || {S.html_title('html')},
                               '[\\\\/:*?"<>|]', '_', 'g') AS entity_key
FROM pages""")
def q_entity_key(spark, sf_dir):
    p = _pages(spark, sf_dir, with_html=True)
    return p.select("page_id", U.entity_key(U.url_netloc("url"), H.html_title("html")).alias("entity_key"))


@query("percent_encode", f"""
SELECT 'part' AS src, p_partkey AS id, replace(url_encode(p_name), '%2F', '/') AS enc FROM part
UNION ALL
SELECT 'page', page_id, replace(url_encode({S.html_title('html')}), '%2F', '/') FROM pages""")
def q_percent_encode(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.lit("part").alias("src"), F.col("p_partkey").alias("id"),
        U.percent_encode("p_name").alias("enc"))
    pages = _pages(spark, sf_dir, with_html=True).select(
        F.lit("page").alias("src"), F.col("page_id").alias("id"),
        U.percent_encode(H.html_title("html")).alias("enc"))
    return part.unionByName(pages)


@query("search_query", """
SELECT s.s_suppkey,
  'professor ' || s.s_name || ' ' || n.n_name || ' (CV or resume or homepage or profile)' AS cv_q,
  s.s_name || ' from ' || n.n_name AS student_q,
  '(research group of ' || s.s_name || ') AND (members or people) AND (graduate or phd or postdoctoral) ' || n.n_name AS group_q,
  'author:"' || s.s_name || '" ' || n.n_name AS author_q
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def q_search_query(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    return j.select(
        "s_suppkey",
        T.search_query("cv", name="s_name", institute="n_name").alias("cv_q"),
        T.search_query("student", name="s_name", institute="n_name").alias("student_q"),
        T.search_query("group", advisor="s_name", institute="n_name").alias("group_q"),
        T.author_query("s_name", F.col("n_name")).alias("author_q"))
