"""Registered queries: joins, resume, append, flatten, overlay, fallback and
quality report (R3-R9, R11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, table
from webrake.catalog import sqlfrag as S
from webrake.functions import html as H
from webrake.functions import urls as U
from webrake.functions.common import tokens
from webrake.operators import joins as J
from webrake.session import scratch_path
from webrake.sources import keystore as KS
from webrake.operators import rank as R


def _index(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("l_suppkey"), "s_name", F.col("n_name").alias("institute"))


@query("enrich_join", """
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, s.s_name, n.n_name AS institute
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def q_enrich_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return J.enrich_join(li, _index(spark, sf_dir), ["l_suppkey"])


@query("enrich_skipped", """
SELECT count(*) AS n_skipped FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment <> 'AUTOMOBILE')""")
def q_enrich_skipped(spark, sf_dir):
    """Children whose index row is missing are skipped and counted: orders
    against a customer index that lacks one market segment."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "AUTOMOBILE").select("c_custkey")
    return J.skipped_children(o, c, ["c_custkey"]).agg(F.count(F.lit(1)).alias("n_skipped"))


@query("anti_processed", """
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def q_anti_processed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.anti_processed(o, done, ["o_orderkey"], null_safe=True)


@query("append_seed", f"""
WITH p AS (SELECT {S.url_part('url', 2)} AS entity_key, page_id AS pos, url,
                  {S.url_part('url', 1)} AS scheme FROM pages),
top AS (SELECT entity_key, pos, url FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY pos) AS rn FROM p) WHERE rn <= 3)
SELECT entity_key, url FROM top
UNION ALL
SELECT DISTINCT entity_key, min(scheme) OVER (PARTITION BY entity_key) || '://' || entity_key || '/' FROM p""")
def q_append_seed(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        U.url_netloc("url").alias("entity_key"), F.col("page_id").alias("pos"), "url",
        U.url_scheme("url").alias("scheme"))
    top = R.topk_per_key(p, ["entity_key"], [F.col("pos")], k=3).select("entity_key", "url")
    seeds = p.groupBy("entity_key").agg(
        F.concat(F.min("scheme"), F.lit("://"), F.col("entity_key"), F.lit("/")).alias("url"))
    return J.append_rows(top, seeds)


@query("flatten_distinct", f"""
SELECT DISTINCT 'link' AS kind, unnest({S.html_links('html')}) AS value FROM pages
UNION
SELECT DISTINCT 'token', unnest({S.tokens('p_name')}) FROM part""")
def q_flatten_distinct(spark, sf_dir):
    links = J.flatten_distinct(table(spark, sf_dir, "pages"), H.html_links("html"))
    toks = J.flatten_distinct(table(spark, sf_dir, "part"), tokens("p_name"))
    return (links.select(F.lit("link").alias("kind"), "value")
            .unionByName(toks.select(F.lit("token").alias("kind"), "value")))


@query("overlay", """
SELECT s.s_suppkey, coalesce(n.name, s.name) AS name, s.nationkey, s.s_acctbal, n.region
FROM (SELECT s_suppkey, s_name AS name, s_nationkey AS nationkey, s_acctbal FROM supplier) s
LEFT JOIN (SELECT n_nationkey AS nationkey, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_name END AS name,
                  n_regionkey AS region FROM nation) n
ON s.nationkey = n.nationkey""")
def q_overlay(spark, sf_dir):
    base = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), "s_acctbal")
    patch = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nationkey"),
        F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("name"),
        F.col("n_regionkey").alias("region"))
    return J.overlay(base, patch, ["nationkey"])


@query("fallback_value", """
SELECT d.doc_id,
  coalesce(nullif(CASE WHEN l.quality = 1 THEN d.source || '@example.org' WHEN l.quality = 0 THEN '' END, ''),
           nullif(d.lang, '')) AS email
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def q_fallback_value(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = d.join(lab, "doc_id", "left")
    own = (F.when(F.col("quality") == 1, F.concat("source", F.lit("@example.org")))
           .when(F.col("quality") == 0, F.lit("")))
    return j.select("doc_id", J.fallback_value(own, "lang").alias("email"))


@query("missing_report", f"""
WITH h AS ({S.HITS})
SELECT entity_key, count(*) AS n_rows, count(*) FILTER (WHERE snippet IS NULL OR snippet = '') AS n_missing
FROM h GROUP BY entity_key""")
def q_missing_report(spark, sf_dir):
    from webrake.plans.fetch import hits_from_pages
    h = hits_from_pages(table(spark, sf_dir, "pages"))
    return J.missing_report(h, ["entity_key"], "snippet")


@query("anti_stored", """
SELECT o_orderkey, o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber > 2)""")
def q_anti_stored(spark, sf_dir):
    """R5 against a keyed table: only the hash buckets that the orders touch
    are read, and of those the key columns."""
    stored = table(spark, sf_dir, "lineitem").where("l_linenumber > 2") \
        .select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber"))
    path = scratch_path(spark, "processed")
    KS.write_keyed(stored, path, ["o_orderkey"])
    return KS.anti_stored(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), path, ["o_orderkey"])
