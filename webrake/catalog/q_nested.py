"""Registered queries: nested lists and per-entity aggregates (A1-A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, table
from webrake.catalog import sqlfrag as S
from webrake.functions import text as T
from webrake.functions import urls as U
from webrake.functions.common import lines, strip_ws
from webrake.operators import nested as N


@query("explode_filter", f"""
WITH d AS (SELECT doc_id, lang, {S.lines('text')} AS ls FROM documents),
x AS (SELECT doc_id, lang, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS line_no FROM d)
SELECT doc_id, lang, CAST(line_no AS INTEGER) AS line_no, line FROM x
WHERE {S.strip_ws('line')} <> '' AND contains(line, ', ')""")
def q_explode_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return N.explode_filter(d, lines("text"), ["doc_id", "lang"],
                            keep=lambda v: (strip_ws(v) != "") & v.contains(", "),
                            pos_col="line_no", value_col="line")


@query("weighted_score", """
SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 10 ELSE 1 END) AS BIGINT) AS score
FROM lineitem GROUP BY l_orderkey""")
def q_weighted_score(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return N.weighted_count_rows(li, ["l_orderkey"], F.col("l_returnflag") == "R")


_DOCS_SQL = """
WITH per_order AS (
  SELECT o.o_custkey, o.o_orderkey, o.o_totalprice,
         count(l.l_orderkey) AS n_exp,
         count(l.l_orderkey) FILTER (WHERE l.l_linestatus = 'O') AS n_pub
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, o.o_orderkey, o.o_totalprice)"""


def _docs(spark, sf_dir):
    """Documents of a person = orders of a customer (document order =
    size descending, size = total price); lists = its line items
    (experiences) and open line items (publications)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    li = table(spark, sf_dir, "lineitem")
    sizes = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_exp"),
        F.count_if(F.col("l_linestatus") == "O").alias("n_pub"))
    return o.join(sizes, o.o_orderkey == sizes.l_orderkey, "left").select(
        "o_custkey", "o_orderkey", "o_totalprice",
        F.coalesce("n_exp", F.lit(0)).alias("n_exp"), F.coalesce("n_pub", F.lit(0)).alias("n_pub"))


@query("longest_list", _DOCS_SQL + """,
e AS (SELECT o_custkey, n_exp, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY n_exp DESC, o_totalprice DESC, o_orderkey) AS rn FROM per_order),
p AS (SELECT o_custkey, n_pub, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY n_pub DESC, o_totalprice DESC, o_orderkey) AS rn FROM per_order)
SELECT e.o_custkey, e.n_exp AS exp_size, CASE WHEN e.n_exp > 0 THEN e.o_orderkey END AS exp_doc,
       p.n_pub AS pub_size, CASE WHEN p.n_pub > 0 THEN p.o_orderkey END AS pub_doc
FROM e JOIN p ON e.o_custkey = p.o_custkey WHERE e.rn = 1 AND p.rn = 1""")
def q_longest_list(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    order = [-F.col("o_totalprice"), F.col("o_orderkey")]
    both = N.longest_lists(docs, ["o_custkey"], {"exp_": "n_exp", "pub_": "n_pub"}, order, ["o_orderkey"])
    return both.select("o_custkey", "exp_size", F.col("exp_o_orderkey").alias("exp_doc"),
                       "pub_size", F.col("pub_o_orderkey").alias("pub_doc"))


@query("largest_doc", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
WHERE rn = 1""")
def q_largest_doc(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return N.largest_doc(o, ["o_custkey"], "o_totalprice", "o_orderkey", ["o_orderkey", "o_totalprice"])


@query("rollup_urls", f"""
WITH p AS (SELECT {S.url_part('url', 2)} AS entity_key, page_id AS pos, url FROM pages
           WHERE NOT {S.deny_url('url', ['spam'], [('blog', 'utm_')])}),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY pos) AS rn FROM p) WHERE rn <= 3)
SELECT entity_key, string_agg(url, E'\\r\\n' ORDER BY pos) AS urls FROM t GROUP BY entity_key""")
def q_rollup_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        U.url_netloc("url").alias("entity_key"), F.col("page_id").alias("pos"), "url")
    return N.rollup_first_k(p, ["entity_key"], "pos", "url", k=3, sep="\r\n",
                            keep=T.keep_url("url", ["spam"], [("blog", "utm_")]), out_col="urls")


@query("first_per_category", f"""
WITH p AS (SELECT {S.url_part('url', 2)} AS entity_key, page_id AS pos, url FROM pages),
a AS (SELECT entity_key, min(pos) FILTER (WHERE contains(url, '/en/')) AS a_pos FROM p GROUP BY entity_key),
b AS (SELECT p.entity_key, min(p.pos) FILTER (WHERE contains(p.url, '?') AND p.pos IS DISTINCT FROM a.a_pos) AS b_pos
      FROM p JOIN a ON p.entity_key = a.entity_key GROUP BY p.entity_key)
SELECT a.entity_key, pa.url AS first_0, pb.url AS first_1
FROM a JOIN b ON a.entity_key = b.entity_key
LEFT JOIN p pa ON pa.pos = a.a_pos LEFT JOIN p pb ON pb.pos = b.b_pos""")
def q_first_per_category(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(
        U.url_netloc("url").alias("entity_key"), F.col("page_id").alias("pos"), "url")
    return N.first_per_category(p, "entity_key", "pos", "url", ["/en/", "?"])


def _width_sql(tbl, col, cap):
    s = S.strip_ws(f"coalesce(CAST({col} AS VARCHAR), 'None')")
    w = f"CASE WHEN {s} = '' THEN 0 ELSE coalesce(list_max(list_transform({S.lines(s)}, lambda x: length(x))), 0) END"
    return (f"SELECT '{col}' AS \"column\", CAST(greatest(max(least({w}, {cap})), {len(col)}) + 1 AS BIGINT) AS width "
            f"FROM {tbl}")


@query("column_widths", " UNION ALL ".join(
    [_width_sql("part", c, 150) for c in ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]]
    + [_width_sql("documents", c, 150) for c in ["doc_id", "text", "lang", "source"]]))
def q_column_widths(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return N.column_widths(part, cap=150).unionByName(N.column_widths(docs, cap=150))


@query("surrogate_id", "SELECT c_custkey, sha256(c_name) AS id FROM customer")
def q_surrogate_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", N.surrogate_id("c_name").alias("id"))
