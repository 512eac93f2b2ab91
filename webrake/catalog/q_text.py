"""Registered queries: text predicates, classifiers and small parsers
(T9-T20, T31, T32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, table
from webrake.catalog import sqlfrag as S
from webrake.functions import html as H
from webrake.functions import text as T
from webrake.functions.common import tokens
from webrake.operators import lexicon as L
from webrake.operators import patterns as PT

LEX_ANY = ["red", "gear"]
LEX_LAST = ["ring", "bolt"]
ALLOW = ["mail", "licen"]
DENY = ["que"]
VOCAB = ["red", "blue", "green", "small", "large", "ring", "bolt", "gear", "widget"]
ACCENT_RANGE = ("à", "ÿ")


def _lst(words):
    return "[" + ", ".join(S.q(w) for w in words) + "]"


@query("script_range", f"""
SELECT doc_id,
  coalesce(regexp_matches(text, '[{ACCENT_RANGE[0]}-{ACCENT_RANGE[1]}]'), false) AS accented,
  coalesce(regexp_matches(text, '[一-龥]'), false) AS cjk
FROM documents""")
def q_script_range(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.script_range("text", *ACCENT_RANGE).alias("accented"),
                    T.script_range("text").alias("cjk"))


@query("lexicon_any", f"""
SELECT p_partkey, coalesce(len(list_intersect({S.tokens('lower(p_name)')}, {_lst(LEX_ANY)})) > 0, false) AS hit
FROM part""")
def q_lexicon_any(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.any_token_in("p_name", LEX_ANY).alias("hit"))


@query("lexicon_last", f"""
SELECT p_partkey,
  coalesce(regexp_matches(p_name, '[一-龥]'), false)
  OR coalesce(list_contains({_lst(LEX_LAST)}, lower({S.tokens('p_name')}[-1])), false) AS hit
FROM part""")
def q_lexicon_last(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.last_token_in("p_name", LEX_LAST).alias("hit"))


@query("lexicon_table", f"""
SELECT p_partkey, p_name,
  coalesce(len(list_intersect({S.tokens('lower(p_name)')},
      (SELECT list(DISTINCT lower(p_type)) FROM part))) > 0, false) AS hit
FROM part""")
def q_lexicon_table(spark, sf_dir):
    """Lexicon held as a table derived from the data (the distinct part
    types, lowercased) joined against part-name tokens."""
    p = table(spark, sf_dir, "part")
    lex = p.select(F.lower("p_type").alias("word"))
    return L.any_token_in_table(p.select("p_partkey", "p_name"), "p_partkey", "p_name",
                                lex, out_col="hit")


@query("keyword_class", """
SELECT o_orderkey,
  contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high')
  OR (contains(lower(o_orderpriority), 'specified') AND NOT contains(lower(o_orderpriority), 'not')) AS cls
FROM orders""")
def q_keyword_class(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.keyword_class("o_orderpriority", ["urgent", "high"],
                                                  "specified", "not").alias("cls"))


@query("url_deny_any", f"""
SELECT page_id, url FROM pages WHERE NOT {S.deny_url('url', ['.html', 'spam'])}""")
def q_url_deny_any(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.where(T.keep_url("url", [".html", "spam"]))


@query("url_deny_pair", f"""
SELECT page_id, {S.deny_url('url', [], [('blog', 'utm_')])} AS denied,
  {S.deny_url('url', ['.pdf', 'researchgate', 'ir.pku.edu.cn', '4amap.arizona.edu'], [('linkedin', 'search')])} AS student_denied,
  {S.deny_url('url', T.GROUP_DENY)} AS group_denied
FROM pages""")
def q_url_deny_pair(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select("page_id", T.deny_url("url", [], [("blog", "utm_")]).alias("denied"),
                    (~T.valid_student_url("url")).alias("student_denied"),
                    (~T.valid_group_url("url")).alias("group_denied"))


HIT_RULES = [("of the", 10), ("que", 7), ("der", 5), ("los", -5)]


@query("hit_score", f"""
WITH h AS ({S.HITS})
SELECT pos AS page_id, CAST({S.score_hit('title', 'snippet', HIT_RULES)} AS BIGINT) AS score,
       CAST({S.score_hit('title', 'snippet', T.GROUP_HIT_RULES)} AS BIGINT) AS group_score
FROM h""")
def q_hit_score(spark, sf_dir):
    from webrake.plans.fetch import hits_from_pages
    h = hits_from_pages(table(spark, sf_dir, "pages"))
    return h.select(F.col("pos").alias("page_id"),
                    T.score_hit("title", "snippet", HIT_RULES).cast("bigint").alias("score"),
                    T.score_hit("title", "snippet").cast("bigint").alias("group_score"))


@query("screen", f"""
WITH d AS (SELECT doc_id, lower(text) AS t FROM documents),
f AS (SELECT doc_id,
   list_filter({_lst(ALLOW)}, lambda w: contains(t, w))[1] AS a,
   list_filter({_lst(DENY)}, lambda w: contains(t, w))[1] AS d
   FROM d)
SELECT doc_id, CASE WHEN a IS NOT NULL THEN true WHEN d IS NOT NULL THEN false ELSE true END AS accept,
       coalesce(a, d) AS rule
FROM f""")
def q_screen(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = T.screen(F.lower("text"), ALLOW, DENY)
    return d.select("doc_id", s.accept.alias("accept"), s.rule.alias("rule"))


_BRIEF_SQL = """(CASE WHEN s_acctbal < 0 THEN s_name || ' - no email listed'
  ELSE s_name || E'\\nVerified email at ' || lower(replace(s_name, '#', '')) || '.example.org - Homepage' END)"""


def _brief(s):
    return F.when(F.col("s_acctbal") < 0, F.concat("s_name", F.lit(" - no email listed"))).otherwise(
        F.concat("s_name", F.lit("\nVerified email at "),
                 F.lower(F.replace("s_name", F.lit("#"), F.lit(""))),
                 F.lit(".example.org - Homepage")))


@query("regex_extract", f"""
SELECT s_suppkey, CASE WHEN regexp_matches(b, 'Verified email at (\\S+)')
                       THEN regexp_extract(b, 'Verified email at (\\S+)', 1) END AS email
FROM (SELECT s_suppkey, {_BRIEF_SQL} AS b FROM supplier)""")
def q_regex_extract(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", T.email_domain(_brief(s)).alias("email"))


def _stats_text():
    return F.when(F.col("c_acctbal") < 0,
                  F.concat("c_name", F.lit("\nCitations n/a\nsince 2019"))).otherwise(
        F.concat("c_name", F.lit("\nCitations "), F.col("c_custkey").cast("string"), F.lit(" "),
                 F.col("c_nationkey").cast("string"), F.lit("\nsince 2019")))


_STATS_SQL = """(CASE WHEN c_acctbal < 0 THEN c_name || E'\\nCitations n/a\\nsince 2019'
  ELSE c_name || E'\\nCitations ' || CAST(c_custkey AS VARCHAR) || ' ' || CAST(c_nationkey AS VARCHAR) || E'\\nsince 2019' END)"""


@query("stats_parse", f"""
WITH t AS (SELECT c_custkey, {S.tokens(S.lines(_STATS_SQL) + '[2]')} AS toks FROM customer),
v AS (SELECT c_custkey,
  CASE WHEN len(toks) = 3 THEN TRY_CAST(toks[2] AS BIGINT) END AS a,
  CASE WHEN len(toks) = 3 THEN TRY_CAST(toks[3] AS BIGINT) END AS r FROM t)
SELECT c_custkey, CASE WHEN a IS NOT NULL AND r IS NOT NULL THEN a END AS cited_all,
       CASE WHEN a IS NOT NULL AND r IS NOT NULL THEN r END AS cited_recent
FROM v""")
def q_stats_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    st = T.cited_stats(_stats_text())
    return c.select("c_custkey", st["all"].alias("cited_all"), st["recent"].alias("cited_recent"))


@query("safe_ratio", """
SELECT l_orderkey, l_linenumber,
  round(CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE 0.0 END, 6) AS ratio
FROM lineitem""")
def q_safe_ratio(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.round(T.safe_ratio("l_discount", "l_tax"), 6).alias("ratio"))


@query("last_line", "SELECT doc_id, string_split(text, E'\\n')[-1] AS last FROM documents")
def q_last_line(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.last_line("text").alias("last"))


@query("join_list", f"""
SELECT p_partkey, array_to_string({S.tokens('p_name')}, E'\\r\\n') AS joined FROM part""")
def q_join_list(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", T.join_list(tokens("p_name"), "\r\n").alias("joined"))


@query("flag_interstitial", f"""
SELECT page_id, coalesce(contains(lower({S.html_title('html')}), 'of the'), false) AS interstitial
FROM pages""")
def q_flag_interstitial(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.is_interstitial(H.html_title("html"), ["of the"]).alias("interstitial"))


@query("vocab_violations", f"""
SELECT p_partkey,
  array_to_string(list_sort(list_distinct(list_filter({S.tokens('p_name')},
      lambda x: NOT list_contains({_lst(VOCAB)}, x)))), '|') AS violations
FROM part""")
def q_vocab(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v = L.vocab_violations(tokens("p_name"), VOCAB)
    return p.select("p_partkey", F.array_join(F.array_sort(v), "|").alias("violations"))


@query("lexicon_table_join", f"""
WITH lex AS (SELECT list(DISTINCT lower(t)) AS words FROM (SELECT unnest({S.tokens('p_name')}) AS t FROM part))
SELECT doc_id, coalesce(len(list_intersect({S.tokens('lower(text)')}, (SELECT words FROM lex))) > 0, false) AS hit
FROM documents""")
def q_lexicon_table_join(spark, sf_dir):
    """The table lexicon over long texts: every token of every whole document against the distinct
    part-name words."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lex = table(spark, sf_dir, "part").select(F.explode(tokens("p_name")).alias("word"))
    return L.any_token_in_table(d, "doc_id", "text", lex, out_col="hit").select("doc_id", "hit")


@query("screen_table", """
WITH words AS (SELECT unnest(string_split(text, ' ')) AS word, false AS accept, item_id AS pos FROM benchmark
               UNION ALL SELECT unnest(string_split(p_name, ' ')), true, p_partkey FROM part),
rule AS (SELECT word, accept, min(pos) AS pos FROM words WHERE word IS NOT NULL AND length(word) > 4 GROUP BY word, accept),
hit AS (SELECT doc_id, word, accept, row_number() OVER (PARTITION BY doc_id ORDER BY accept DESC, pos, word) AS rn
        FROM documents JOIN rule ON contains(text, word))
SELECT d.doc_id, coalesce(h.accept, true) AS accept, h.word AS rule
FROM documents d LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h ON d.doc_id = h.doc_id""")
def q_screen_table(spark, sf_dir):
    """T15 with lists from tables: all longer words of the part names accept,
    those of the benchmark reject, in the order of their ids."""
    split = lambda t, c, p, ok: table(spark, sf_dir, t).select(
        F.explode(F.split(c, " ")).alias("word"), F.lit(ok).alias("accept"), F.col(p).cast("long").alias("pos"))
    rules = split("benchmark", "text", "item_id", False).unionByName(split("part", "p_name", "p_partkey", True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return PT.screen_table(docs, "doc_id", "text", rules.where(F.length("word") > 4))
