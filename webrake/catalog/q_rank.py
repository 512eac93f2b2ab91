"""Registered queries: ordered dedupe, top-k, sort, slice, required fields,
defaults (W1-W8, R1, R2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, supplied_parts, table
from webrake.catalog import sqlfrag as S
from webrake.functions import text as T
from webrake.functions import urls as U
from webrake.operators import joins as J
from webrake.operators import rank as R

LEX = ["red", "gear"]


@query("dedupe_first", """
SELECT p_partkey, p_name FROM (
  SELECT p_partkey, p_name,
         row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS rn
  FROM part WHERE p_name IS NOT NULL AND p_name <> '')
WHERE rn = 1""")
def q_dedupe_first(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return R.dedupe_first_ci(p, "p_name", ["p_partkey"])


def _members(spark, sf_dir):
    """Group members: each supplier's distinct parts, name = part name,
    title = part type; list order = (supplier, part)."""
    li = supplied_parts(spark, sf_dir)
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("s_suppkey"), "p_partkey",
        F.col("p_name").alias("name"), F.col("p_type").alias("title"))


_MEMBERS_SQL = """
WITH m AS (
  SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey AS p_partkey FROM lineitem),
mem AS (
  SELECT m.s_suppkey, m.p_partkey, p.p_name AS name, p.p_type AS title
  FROM m JOIN part p ON m.p_partkey = p.p_partkey)"""


@query("dedupe_then_filter", _MEMBERS_SQL + f""",
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY s_suppkey, p_partkey) AS rn FROM mem)
  WHERE rn = 1)
SELECT s_suppkey, p_partkey, name, title FROM first
WHERE coalesce(len(list_intersect({S.tokens('lower(name)')}, ['red', 'gear'])) > 0, false)
  AND (coalesce(title, '') = '' OR contains(lower(title), 'small') OR contains(lower(title), 'promo'))""")
def q_dedupe_then_filter(spark, sf_dir):
    m = _members(spark, sf_dir)
    keep = T.any_token_in("name", LEX) & (
        (F.coalesce(F.col("title"), F.lit("")) == "")
        | T.keyword_class("title", ["small", "promo"], None, None))
    return R.dedupe_then_filter(m, [F.lower("name")], ["s_suppkey", "p_partkey"], keep)


_KEYED_SQL = f"""
WITH u AS (
  SELECT page_id AS pos, url FROM pages
  UNION ALL
  SELECT page_id + 1000000, CASE WHEN contains(url, '#') THEN replace(url, '#', '?v=1#')
                                 WHEN contains(url, '?') THEN url || '&v=1' ELSE url || '?v=1' END FROM pages),
k AS (SELECT {S.url_part('url', 2)} AS entity_key, {S.url_key('url')} AS url_key, pos, url FROM u)"""


@query("dedupe_url_key", _KEYED_SQL + """
SELECT entity_key, url_key, pos, url FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_key, url_key ORDER BY pos) AS rn FROM k)
WHERE rn = 1""")
def q_dedupe_url_key(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    variant = (F.when(F.col("url").contains("#"), F.replace("url", F.lit("#"), F.lit("?v=1#")))
               .when(F.col("url").contains("?"), F.concat("url", F.lit("&v=1")))
               .otherwise(F.concat("url", F.lit("?v=1"))))
    u = p.select(F.col("page_id").alias("pos"), "url").unionByName(
        p.select((F.col("page_id") + 1000000).alias("pos"), variant.alias("url")))
    k = u.select(U.url_netloc("url").alias("entity_key"), U.url_key("url").alias("url_key"), "pos", "url")
    return R.dedupe_first(k, ["entity_key", "url_key"], ["pos"])


@query("topk_per_host", f"""
SELECT entity_key, pos, url, CAST(rank AS INTEGER) AS rank FROM (
  SELECT {S.url_part('url', 2)} AS entity_key, page_id AS pos, url,
         row_number() OVER (PARTITION BY {S.url_part('url', 2)} ORDER BY page_id) AS rank
  FROM pages) WHERE rank <= 3""")
def q_topk_per_host(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        U.url_netloc("url").alias("entity_key"), F.col("page_id").alias("pos"), "url")
    return R.topk_per_key(p, ["entity_key"], [F.col("pos")], k=3, rank_col="rank")


HIT_RULES = [("of the", 10), ("que", 7), ("der", 5), ("los", -5)]


@query("score_topk", f"""
WITH h AS ({S.HITS}),
s AS (SELECT entity_key, pos, CAST({S.score_hit('title', 'snippet', HIT_RULES)} AS BIGINT) AS score FROM h)
SELECT entity_key, pos, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY score DESC, pos) AS rank FROM s)
WHERE rank <= 2""")
def q_score_topk(spark, sf_dir):
    from webrake.plans.fetch import hits_from_pages
    h = hits_from_pages(table(spark, sf_dir, "pages"))
    s = h.select("entity_key", "pos", T.score_hit("title", "snippet", HIT_RULES).cast("bigint").alias("score"))
    return R.score_topk(s, ["entity_key"], "score", "pos", k=2)


@query("sort_nulls_last", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
ORDER BY l.quality ASC NULLS LAST, d.doc_id""")
def q_sort_nulls_last(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return R.sort_nulls_last(d.join(lab, "doc_id", "left"), "quality", "doc_id")


@query("slice_rows", """
SELECT o_orderkey, o_orderpriority FROM orders
ORDER BY o_orderpriority NULLS LAST, o_orderkey LIMIT 47 OFFSET 3""")
def q_slice_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return R.slice_rows(o, [F.col("o_orderpriority").asc_nulls_last(), F.col("o_orderkey")],
                        offset=3, limit=50)


@query("page_cap", f"""
SELECT page_id, url, coalesce(TRY_CAST({S.url_param('url', 'page')} AS INTEGER), 1) - 1 AS page_no
FROM pages WHERE coalesce(TRY_CAST({S.url_param('url', 'page')} AS INTEGER), 1) - 1 < 1""")
def q_page_cap(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    p = p.withColumn("page_no", F.coalesce(U.url_param("url", "page").try_cast("int"), F.lit(1)) - 1)
    return R.page_cap(p, "page_no", page_limit=1)


@query("require_fields", """
SELECT doc_id, lang, source FROM documents
WHERE text IS NOT NULL AND text <> '' AND source IS NOT NULL AND source <> ''
  AND lang IS NOT NULL AND lang <> ''""")
def q_require_fields(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return J.require_fields(d, ["text", "source", "lang"]).select("doc_id", "lang", "source")


@query("project_defaults", f"""
SELECT page_id, coalesce({S.url_param('url', 'ref')}, '') AS ref,
       coalesce({S.url_param('url', 'utm_source')}, '') AS utm_source,
       coalesce({S.url_param('url', 'page')}, '1') AS page, false AS is_famous
FROM pages""")
def q_project_defaults(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        "page_id", U.url_param("url", "ref").alias("ref"),
        U.url_param("url", "utm_source").alias("utm_source"),
        U.url_param("url", "page").alias("page"))
    return J.project_defaults(p, {"page_id": None, "ref": "", "utm_source": "", "page": "1",
                                  "is_famous": False})


@query("slice_offset", """
SELECT o_orderkey, o_orderpriority FROM orders
ORDER BY o_orderpriority NULLS LAST, o_orderkey OFFSET 100""")
def q_slice_offset(spark, sf_dir):
    """W7 with limit 0 (no end): every row after the first 100."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return R.slice_rows(o, [F.col("o_orderpriority").asc_nulls_last(), F.col("o_orderkey")],
                        offset=100, limit=0)


@query("slice_far", """
SELECT o_orderkey, o_orderpriority FROM orders
ORDER BY o_orderpriority NULLS LAST, o_orderkey LIMIT 11000 OFFSET 1500""")
def q_slice_far(spark, sf_dir):
    """W7 with an end beyond a small top-k: rows are taken by their positions
    in a range-partitioned sort."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return R.slice_rows(o, [F.col("o_orderpriority").asc_nulls_last(), F.col("o_orderkey")],
                        offset=1500, limit=12500)
