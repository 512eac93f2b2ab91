"""Registered queries: composite jobs (P1-P10) and incremental ingest (I1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, supplied_parts, table
from webrake.catalog import sqlfrag as S
from webrake.functions import html as H
from webrake.functions import text as T
from webrake.functions import urls as U
from webrake.functions.common import lines, tokens
from webrake.plans import extract as X
from webrake.plans import fetch
from webrake.plans import fileset as FS
from webrake.plans import profiles as PF
from webrake.plans import records as PR
from webrake.session import scratch_path
from webrake.sources import pagestore as PS
from webrake.sources import sinks as SK

# Stand-in parameters (pages play search hits): score keywords, deny-lists.
HIT_RULES = [("of the", 10), ("que", 7), ("der", 5), ("los", -5)]
DENY_ANY = [".html", "spam"]
DENY_PAIRS = [("blog", "utm_")]


def _fetch_plan_sql() -> str:
    return f"""
WITH hits AS ({S.HITS}),
scored AS (
  SELECT entity_key, pos, url,
         CAST({S.score_hit('title', 'snippet', HIT_RULES)} AS BIGINT) AS score
  FROM hits),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY score DESC, pos) AS rank
  FROM scored WHERE NOT {S.deny_url('url', DENY_ANY, DENY_PAIRS)}),
keyed AS (
  SELECT entity_key, CAST(rank AS BIGINT) AS rank, pos, url, score, {S.url_key('url')} AS url_key
  FROM ranked WHERE rank <= 3),
dd AS (
  SELECT *, row_number() OVER (PARTITION BY entity_key, url_key ORDER BY rank) AS rn FROM keyed)
SELECT entity_key, rank, pos, url, score, url_key FROM dd WHERE rn = 1
"""


@query("p_fetch_plan", _fetch_plan_sql())
def p_fetch_plan(spark, sf_dir):
    hits = fetch.hits_from_pages(table(spark, sf_dir, "pages"))
    return fetch.fetch_plan(hits, kind="group", k=3, rules=HIT_RULES,
                            deny_any=DENY_ANY, deny_pairs=DENY_PAIRS)


_STORED = "contains(h.url, '/en/')"


@query("p_fetch_resume", f"""
WITH plan AS ({_fetch_plan_sql()}), h AS (SELECT url FROM pages)
SELECT plan.* FROM plan WHERE NOT EXISTS (
  SELECT 1 FROM h WHERE {_STORED} AND {S.url_part('h.url', 2)} = plan.entity_key AND {S.url_key('h.url')} = plan.url_key)""")
def p_fetch_resume(spark, sf_dir):
    """The fetch plan less the pages that a page store holds (here: the
    English ones); the store's side is read in its buckets, without exchange."""
    pages = table(spark, sf_dir, "pages")
    stored = pages.where(F.col("url").contains("/en/")) \
        .select(U.url_netloc("url").alias("entity_key"), U.url_key("url").alias("url_key"), "html")
    path = scratch_path(spark, "store")
    PS.write_store(stored, path)
    plan = fetch.fetch_plan(fetch.hits_from_pages(pages), kind="group", k=3, rules=HIT_RULES,
                            deny_any=DENY_ANY, deny_pairs=DENY_PAIRS)
    return PS.not_stored(plan, PS.open_store(spark, path))


# ---------------------------------------------------------------- shared stand-ins

A_RE = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a\s*>'
LANG_RE = r'<html[^>]*lang="([^"]*)"'
ROSTER_LEX = ["the", "and", "to", "de", "la", "der", "para"]


def _roster_inputs(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    index = p.select(F.col("page_id").alias("entity_key"), F.col("url").alias("page_url"),
                     U.url_netloc("url").alias("institute"),
                     F.regexp_extract("html", LANG_RE, 1).alias("department"))
    h = H.drop_blocks("html", ["script"])
    pairs = F.arrays_zip(F.regexp_extract_all(h, F.lit(A_RE), 1).alias("href"),
                         F.regexp_extract_all(h, F.lit(A_RE), 2).alias("name"))
    fac = p.select(F.col("page_id").alias("entity_key"), F.explode(pairs).alias("a")).select(
        "entity_key", F.col("a.name").alias("name"),
        F.when(F.length("a.name") > 5, F.lit("Professor")).otherwise(F.lit("")).alias("title"),
        F.col("a.href").alias("profile_url"))
    return index, fac


_ROSTER_SQL = f"""
WITH p AS (SELECT page_id AS entity_key, url AS page_url, {S.url_part('url', 2)} AS institute,
                  regexp_extract(html, {S.q(LANG_RE)}, 1) AS department,
                  {S.drop_blocks('html', ['script'])} AS h FROM pages),
f AS (SELECT entity_key, page_url, institute, department,
             unnest(regexp_extract_all(h, {S.q(A_RE)}, 1)) AS href,
             unnest(regexp_extract_all(h, {S.q(A_RE)}, 2)) AS name FROM p),
c AS (SELECT entity_key, name, CASE WHEN length(name) > 5 THEN 'Professor' ELSE '' END AS title,
  CASE WHEN href = '' OR starts_with(href, 'http') THEN href
       WHEN starts_with(href, '/') THEN substr(split_part(page_url, '?', 1), 1, 8)
            || split_part(substr(split_part(page_url, '?', 1), 9), '/', 1) || href
       ELSE split_part(page_url, '?', 1) || href END AS profile_url,
  page_url AS src, coalesce(institute, '') AS institute, coalesce(department, '') AS department FROM f)"""


@query("p_roster", _ROSTER_SQL + f"""
SELECT * FROM c WHERE coalesce(len(list_intersect({S.tokens('lower(name)')},
   [{', '.join(S.q(w) for w in ROSTER_LEX)}])) > 0, false)""")
def p_roster(spark, sf_dir):
    index, fac = _roster_inputs(spark, sf_dir)
    cands, _report = PR.roster_candidates(index, fac, keep=T.any_token_in("name", ROSTER_LEX))
    return cands


@query("p_roster_missing", _ROSTER_SQL + """
SELECT src, count(*) AS n_rows, count(*) FILTER (WHERE title IS NULL OR title = '') AS n_missing
FROM c GROUP BY src""")
def p_roster_missing(spark, sf_dir):
    index, fac = _roster_inputs(spark, sf_dir)
    _cands, report = PR.roster_candidates(index, fac)
    return report


@query("p_advisors", """
WITH cv AS (SELECT o.o_orderkey AS cv_id, c.c_name AS member,
                   CASE WHEN c.c_acctbal > 5000 THEN lower(c.c_mktsegment) || '@example.org' ELSE '' END AS email
            FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
            WHERE c.c_name IS NOT NULL AND c.c_name <> ''),
ex AS (SELECT l.l_orderkey AS cv_id, l.l_linestatus AS title, n.n_name AS institute,
              'part-' || CAST(l.l_partkey AS VARCHAR) AS "group",
              CASE WHEN l.l_returnflag = 'R' THEN s.s_name ELSE '' END AS advisor
       FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey)
SELECT cv.member, cv.email, coalesce(ex.title, '') AS title, coalesce(ex.institute, '') AS institute,
       coalesce(ex."group", '') AS "group", ex.advisor
FROM cv JOIN ex ON cv.cv_id = ex.cv_id WHERE ex.advisor IS NOT NULL AND ex.advisor <> ''""")
def p_advisors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    cvs = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("cv_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lower("c_mktsegment"), F.lit("@example.org")))
        .otherwise(F.lit("")).alias("email"))
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    ex = (li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
          .select(F.col("l_orderkey").alias("cv_id"), F.col("l_linestatus").alias("title"),
                  F.col("n_name").alias("institute"),
                  F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("group"),
                  F.when(F.col("l_returnflag") == "R", F.col("s_name")).otherwise(F.lit("")).alias("advisor")))
    return PR.advisor_edges(cvs, ex)


@query("p_groups", f"""
WITH h AS (SELECT {S.url_part('url', 2)} AS entity_key, page_id AS pos, url FROM pages),
ix AS (SELECT DISTINCT entity_key, regexp_extract(entity_key, '[^.]*$', 0) AS institute,
          split_part(entity_key, '.', 1) AS "group", entity_key AS advisor FROM h),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY pos) AS rn
      FROM h WHERE NOT {S.deny_url('url', T.GROUP_DENY)}) WHERE rn <= 3),
u AS (SELECT entity_key, string_agg(url, E'\\r\\n' ORDER BY pos) AS urls FROM t GROUP BY entity_key)
SELECT ix.institute, ix."group", ix.advisor, coalesce(u.urls, '') AS urls
FROM ix LEFT JOIN u ON ix.entity_key = u.entity_key""")
def p_groups(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select(
        U.url_netloc("url").alias("entity_key"), F.col("page_id").alias("pos"), "url")
    ix = h.select("entity_key").distinct().select(
        "entity_key", F.regexp_extract("entity_key", r"[^.]*$", 0).alias("institute"),
        F.split_part("entity_key", F.lit("."), F.lit(1)).alias("group"),
        F.col("entity_key").alias("advisor"))
    return PR.group_rollup(ix, h)


_CAND_LEX = ["red", "gear"]


@query("p_candidates", f"""
WITH m AS (SELECT DISTINCT l_suppkey AS entity_key, l_partkey AS p_partkey FROM lineitem),
mem AS (SELECT m.entity_key, m.entity_key AS group_ord, 0 AS file_ord, m.p_partkey AS line_no,
               coalesce(p.p_name, '') AS name, p.p_type AS title, p.p_brand AS description
        FROM m JOIN part p ON m.p_partkey = p.p_partkey),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY group_ord, file_ord, line_no) AS rn
      FROM mem) WHERE rn = 1),
k AS (SELECT * FROM f WHERE coalesce(len(list_intersect({S.tokens('lower(name)')}, ['red', 'gear'])) > 0, false)
      AND (coalesce(title, '') = '' OR contains(lower(coalesce(title, '')), 'small') OR contains(lower(coalesce(title, '')), 'promo')))
SELECT k.name, coalesce(k.title, '') AS title, '' AS email, s.s_name AS advisor,
       'group-' || CAST(s.s_suppkey AS VARCHAR) AS "group", n.n_name AS institute, coalesce(k.description, '') AS description
FROM k JOIN supplier s ON k.entity_key = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def p_candidates(spark, sf_dir):
    li = supplied_parts(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    mem = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("entity_key"), F.col("l_suppkey").alias("group_ord"),
        F.lit(0).alias("file_ord"), F.col("p_partkey").alias("line_no"),
        F.col("p_name").alias("name"), F.col("p_type").alias("title"),
        F.lit(None).cast("string").alias("email"), F.col("p_brand").alias("description"))
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    ix = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("entity_key"), F.col("s_name").alias("advisor"),
        F.concat(F.lit("group-"), F.col("s_suppkey").cast("string")).alias("group"),
        F.col("n_name").alias("institute"))
    return PR.group_candidates(ix, mem, keep_flag=T.any_token_in("name", _CAND_LEX),
                               title_ok=T.keyword_class("title", ["small", "promo"], None, None))


def _title_ok(c):
    return T.keyword_class(c, ["urgent", "high"], "specified", "not")


@query("p_scores", """
WITH st AS (SELECT l_orderkey, count(*) AS n_exp, sum(CASE WHEN l_returnflag = 'R' THEN 10 ELSE 1 END) AS exp_score,
                   count(*) FILTER (WHERE l_linestatus = 'O') AS n_pub,
                   coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 10 ELSE 1 END) FILTER (WHERE l_linestatus = 'O'), 0) AS pub_score
            FROM lineitem GROUP BY l_orderkey),
d AS (SELECT o.o_custkey AS entity_key, o.o_orderkey AS doc_id, o.o_totalprice AS size, o.o_orderpriority AS title,
             CASE WHEN o.o_orderstatus = 'F' THEN 'f' || CAST(o.o_orderkey AS VARCHAR) || '@example.org' ELSE '' END AS email,
             coalesce(st.n_exp, 0) AS n_exp, coalesce(st.exp_score, 0) AS exp_score,
             coalesce(st.n_pub, 0) AS n_pub, coalesce(st.pub_score, 0) AS pub_score
      FROM orders o LEFT JOIN st ON st.l_orderkey = o.o_orderkey),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY size DESC, doc_id) AS rn FROM d) WHERE rn = 1
      AND (contains(lower(title), 'urgent') OR contains(lower(title), 'high')
           OR (contains(lower(title), 'specified') AND NOT contains(lower(title), 'not')))),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY n_exp DESC, size DESC, doc_id) AS rn FROM d) WHERE rn = 1),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY n_pub DESC, size DESC, doc_id) AS rn FROM d) WHERE rn = 1),
ix AS (SELECT c.c_custkey AS entity_key, n.n_name AS institute, lower(c.c_mktsegment) || '@example.org' AS email
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
SELECT b.entity_key, b.doc_id AS base_doc, b.title,
       CASE WHEN e.n_exp > 0 THEN e.doc_id END AS exp_doc, CAST(e.n_exp AS BIGINT) AS n_exp,
       CASE WHEN p.n_pub > 0 THEN p.doc_id END AS pub_doc, CAST(p.n_pub AS BIGINT) AS n_pub,
       CAST((CASE WHEN e.n_exp > 0 THEN e.exp_score ELSE 0 END) + (CASE WHEN p.n_pub > 0 THEN p.pub_score ELSE 0 END) AS BIGINT) AS score,
       sha256(CAST(b.entity_key AS VARCHAR)) AS id, coalesce(ix.institute, '') AS institute,
       coalesce(nullif(b.email, ''), nullif(ix.email, '')) AS email
FROM b JOIN e ON b.entity_key = e.entity_key JOIN p ON b.entity_key = p.entity_key
JOIN ix ON b.entity_key = ix.entity_key""")
def p_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    st = PR.list_stats(li, "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    o = table(spark, sf_dir, "orders")
    docs = o.join(st, o.o_orderkey == st.l_orderkey, "left").select(
        F.col("o_custkey").alias("entity_key"), F.col("o_orderkey").alias("doc_id"),
        F.col("o_totalprice").alias("size"), F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderstatus") == "F",
               F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit("@example.org")))
        .otherwise(F.lit("")).alias("email"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_exp", "exp_score", "n_pub", "pub_score")])
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    ix = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("entity_key"), F.col("n_name").alias("institute"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.org")).alias("email"))
    return PR.student_scores(ix, docs, title_ok=_title_ok)


# ---------------------------------------------------------------- P5
ALLOW = ["mail", "licen"]
DENY = ["que"]


def _profiles_from_documents(spark, sf_dir):
    """Profiles stand-in: a document is a profile; its lines are the
    articles, (lang, source) the tags; brief and stats are built from the
    document and its label (no label: stats do not parse)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(
        "doc_id",
        F.concat(F.lit("Author "), F.col("doc_id").cast("string"), F.lit(" "), F.col("source")).alias("name"),
        F.when(F.col("quality") == 1, F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/")))
        .alias("homepage"),
        F.concat(F.when(F.col("quality") == 1, F.concat(F.lit("Verified email at "), F.col("source"),
                                                          F.lit(".example.org")))
                 .otherwise(F.lit("No verified email")), F.lit("\n"), F.col("lang")).alias("brief"),
        F.when(F.col("quality").isNull(), F.lit("Cited by\nCitations n/a")).otherwise(
            F.concat(F.lit("Cited by\nCitations "), F.col("n_chars").cast("string"), F.lit(" "),
                     F.floor(F.col("n_chars") / 3).cast("string"))).alias("cited_stats"),
        lines("text").alias("articles"), F.array("lang", "source").alias("tags"),
        F.coalesce(F.col("toxic"), F.lit(0)).alias("toxic"))


_PROFILES_SQL = f"""
WITH pr AS (
  SELECT d.doc_id, 'Author ' || CAST(d.doc_id AS VARCHAR) || ' ' || d.source AS name,
    CASE WHEN l.quality = 1 THEN 'https://' || d.source || '.example.org/' END AS homepage,
    (CASE WHEN l.quality = 1 THEN 'Verified email at ' || d.source || '.example.org' ELSE 'No verified email' END)
      || chr(10) || d.lang AS brief,
    CASE WHEN l.quality IS NULL THEN 'Cited by' || chr(10) || 'Citations n/a'
         ELSE 'Cited by' || chr(10) || 'Citations ' || CAST(d.n_chars AS VARCHAR) || ' ' || CAST(floor(d.n_chars / 3) AS BIGINT) END AS cited_stats,
    {S.lines('d.text')} AS articles, [d.lang, d.source] AS tags, coalesce(l.toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
sc AS (
  SELECT *, lower(array_to_string(list_concat(articles, tags), chr(10))) AS ft FROM pr WHERE toxic = 0),
sc2 AS (
  SELECT *, list_filter([{', '.join(S.q(w) for w in ALLOW)}], lambda w: contains(ft, w))[1] AS a,
            list_filter([{', '.join(S.q(w) for w in DENY)}], lambda w: contains(ft, w))[1] AS dn FROM sc),
acc AS (SELECT *, coalesce(a, dn) AS rule,
          {S.tokens(S.lines('cited_stats') + '[2]')} AS toks FROM sc2 WHERE a IS NOT NULL OR dn IS NULL),
st AS (SELECT *, CASE WHEN len(toks) = 3 THEN TRY_CAST(toks[2] AS BIGINT) END AS c_all,
                 CASE WHEN len(toks) = 3 THEN TRY_CAST(toks[3] AS BIGINT) END AS c_5,
                 CASE WHEN regexp_matches(brief, 'Verified email at (\\S+)') THEN regexp_extract(brief, 'Verified email at (\\S+)', 1) END AS email
       FROM acc)"""


@query("p_report", _PROFILES_SQL + """
SELECT name, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS DOUBLE) AS score, coalesce(homepage, '') AS homepage,
       rule AS keyword, array_to_string(tags, chr(10)) AS tags, c_all AS cited_all, c_5 AS cited_5yr,
       round(CASE WHEN c_all > 0 THEN c_5 / c_all ELSE 0.0 END, 6) AS cited_5yr_ratio,
       string_split(brief, chr(10))[-1] AS brief, array_to_string(articles, chr(10)) AS articles,
       'https://www.google.com/search?q=' || replace(url_encode(CASE WHEN email IS NOT NULL AND email <> '' THEN name || ' at ' || email ELSE name END), '%2F', '/') AS search_link
FROM st WHERE c_all IS NOT NULL AND c_5 IS NOT NULL""")
def p_report(spark, sf_dir):
    prof = _profiles_from_documents(spark, sf_dir)
    report, _bad = PF.screened_report(prof, ALLOW, DENY, keep_flag=F.col("toxic") == 0)
    return report.withColumn("cited_5yr_ratio", F.round("cited_5yr_ratio", 6))


@query("p_report_quarantine", _PROFILES_SQL + """
SELECT name, cited_stats FROM st WHERE c_all IS NULL OR c_5 IS NULL""")
def p_report_quarantine(spark, sf_dir):
    prof = _profiles_from_documents(spark, sf_dir)
    _report, bad = PF.screened_report(prof, ALLOW, DENY, keep_flag=F.col("toxic") == 0)
    return bad


# ---------------------------------------------------------------- P6
_AD_SPEC = {"ads": "div.ad"}
_AD_RE = r'(?is)<div\s[^>]*class="(?:[^"]*\s)?ad(?:\s[^"]*)?"[^>]*>(.*?)</div\s*>'


@query("p_refresh", f"""
WITH p AS (SELECT page_id AS uid, {S.url_part('url', 2)} AS host,
                  list_transform(regexp_extract_all(html, {S.q(_AD_RE)}, 1), lambda x: {S.strip_tags('x')}) AS ads
           FROM pages)
SELECT uid, array_to_string(ads, '|') AS ads, CAST(len(ads) AS INTEGER) AS n_ads,
       CASE WHEN uid % 3 = 0 THEN '' ELSE host || '|c' || CAST(uid AS VARCHAR) END AS co_authors FROM p""")
def p_refresh(spark, sf_dir):
    """Stored profiles (uid, a list of co-authors whose names are a list or a
    scalar) refreshed from stored HTML, written as a new version and read back."""
    pages = table(spark, sf_dir, "pages")
    host = U.url_netloc("url")
    uid = F.col("page_id")
    second = F.concat(F.lit(', {"name": "c'), uid.cast("string"), F.lit('"}]'))
    co = F.when(uid % 3 == 0, F.lit("[]")) \
        .when(uid % 2 == 0, F.concat(F.lit('[{"name": ["'), host, F.lit('", "x"]}'), second)) \
        .otherwise(F.concat(F.lit('[{"name": "'), host, F.lit('"}'), second))
    profiles = pages.select(uid.alias("uid"), co.alias("co_authors_json"))
    fresh = PF.refresh_profiles(profiles, pages.select(uid.alias("uid"), "html"), _AD_SPEC)
    from webrake.sources.sinks import write_versioned
    path = write_versioned(fresh.select("uid", "ads", "co_authors"), scratch_path(spark, "profiles"),
                           suffix="refresh", fmt="parquet")
    back = spark.read.parquet(path)
    return back.select("uid", F.array_join("ads", "|").alias("ads"), F.size("ads").alias("n_ads"),
                       F.array_join("co_authors.name", "|").alias("co_authors"))


@query("p_refresh_stored", f"""
WITH p AS (SELECT page_id AS uid, {S.url_part('url', 2)} AS host,
                  list_transform(regexp_extract_all(html, {S.q(_AD_RE)}, 1), lambda x: {S.strip_tags('x')}) AS ads
           FROM pages WHERE page_id % 11 <> 0)
SELECT uid, CASE uid % 5 WHEN 0 THEN 'n' || CAST(uid AS VARCHAR) WHEN 1 THEN 'm' || CAST(uid AS VARCHAR)
                         WHEN 2 THEN CAST(uid AS VARCHAR) END AS name,
       CASE uid % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' ELSE '' END AS tags,
       CASE WHEN uid % 3 = 2 THEN 0 WHEN uid % 3 = 1 THEN 1 ELSE 2 END AS n_co_authors,
       CASE uid % 3 WHEN 2 THEN '' WHEN 1 THEN host ELSE host || '|c' END AS co_authors,
       array_to_string(ads, '|') AS ads FROM p""")
def p_refresh_stored(spark, sf_dir):
    """Profiles stored as JSON lines with union-typed fields (name: list, text,
    number, null or missing; tags: list, text or null; co-authors: list, one
    object or null), every eleventh line cut short, refreshed from stored HTML."""
    pages = table(spark, sf_dir, "pages")
    uid, host = F.col("page_id").cast("string"), U.url_netloc("url")
    k = F.col("page_id") % 5
    name = F.when(k == 0, F.concat(F.lit(', "name": ["", "n'), uid, F.lit('"]'))) \
        .when(k == 1, F.concat(F.lit(', "name": " m'), uid, F.lit('"'))) \
        .when(k == 2, F.concat(F.lit(', "name": '), uid)).when(k == 3, ', "name": null').otherwise("")
    k = F.col("page_id") % 4
    tags = F.when(k == 0, ', "tags": ["a", null, "b"]').when(k == 1, ', "tags": "a"').otherwise(', "tags": null')
    k = F.col("page_id") % 3
    mate = F.concat(F.lit('{"name": ["'), host, F.lit('", "x"], "url": "u"}'))
    co = F.when(k == 0, F.concat(F.lit("["), mate, F.lit(', {"name": "c"}]'))).when(k == 1, mate).otherwise("null")
    line = F.concat(F.lit('{"uid": '), uid, name, tags, F.lit(', "co_authors": '), co, F.lit("}"))
    line = F.when(F.col("page_id") % 11 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    path = scratch_path(spark, "stored-profiles")
    pages.select(line.alias("value")).write.text(path)
    profiles, _ = PF.stored_profiles(spark, path, {"uid": "number", "name": "string", "tags": "strings"})
    fresh = PF.refresh_profiles(profiles.withColumn("uid", F.col("uid").cast("long")),
                                pages.select(F.col("page_id").cast("long").alias("uid"), "html"), _AD_SPEC)
    return fresh.select("uid", "name", F.array_join("tags", "|").alias("tags"), F.size("co_authors").alias("n_co_authors"),
                        F.array_join("co_authors.name", "|").alias("co_authors"), F.array_join("ads", "|").alias("ads"))


# ---------------------------------------------------------------- P8
REQ_TEMPLATE = "Extract the people listed on this page of $HOST. Answer in JSON lines."


_TQ = '"' * 3
_REQ_SQL = (
    "SELECT page_id, CAST(2 AS INTEGER) AS n_messages, "
    f"replace({S.q(REQ_TEMPLATE)}, '$HOST', coalesce({S.url_part('url', 2)}, '')) AS system, "
    f"{S.q('Markdown: ' + _TQ)} || chr(10) || {S.strip_tags(S.drop_blocks('html'))} || chr(10) || {S.q(_TQ)} AS user_text "
    "FROM pages")


@query("p_requests", _REQ_SQL)
def p_requests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    req = X.extract_requests(pages, ["page_id"], REQ_TEMPLATE, native=True, HOST=U.url_netloc("url"))
    return req.select("page_id", F.size("messages").alias("n_messages"),
                      F.col("messages")[0]["content"].alias("system"),
                      F.col("messages")[1]["content"].alias("user_text"))


@query("p_requests_markdown")
def p_requests_markdown(spark, sf_dir):
    """Parser-based variant (mapInPandas markdown); checked in tests."""
    pages = table(spark, sf_dir, "pages")
    req = X.extract_requests(pages, ["page_id"], REQ_TEMPLATE, native=False, HOST=U.url_netloc("url"))
    return req.select("page_id", F.col("messages")[0]["content"].alias("system_text"),
                      F.col("messages")[1]["content"].alias("user_text"))


def _answers(spark, sf_dir):
    from webrake.catalog.q_records import _block
    e = table(spark, sf_dir, "events").select("event_id", "props", "user_id")
    return e.select("event_id", F.concat(F.lit("Sure.\n```json\n"), _block(), F.lit("\n```")).alias("answer"))


def _answers_sql():
    from webrake.catalog.q_records import JSONL_BLOCK_SQL
    # the fence is added and removed again: the records equal the block's
    return JSONL_BLOCK_SQL


@query("p_answers", _answers_sql())
def p_answers(spark, sf_dir):
    return X.parse_answers(_answers(spark, sf_dir), ["event_id"], "k BIGINT, u BIGINT")


# ---------------------------------------------------------------- P9
@query("p_clean")
def p_clean(spark, sf_dir):
    """Bulk clean + convert of every page (parser pass), written to a new
    location and read back.  Checked by idempotence and edge tables."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = X.clean_corpus(pages, scratch_path(spark, "clean"))
    return out.select("page_id", U.url_key("url").alias("url_key"),
                      "clean_html", "markdown")


# ---------------------------------------------------------------- P10
def _results(spark, sf_dir):
    from webrake.catalog.q_records import _endnote_text
    p = table(spark, sf_dir, "part")
    res = p.select(F.concat(F.lit("https://example.org/article/"), F.col("p_partkey").cast("string")).alias("url"),
                   _endnote_text().alias("endnote"),
                   F.transform(tokens("p_name"), lambda t: F.struct(F.upper(t).alias("name"), F.concat(
                       F.lit("https://scholar.example.org/citations?hl=en&user="), t).alias("url"))).alias("profiles"))
    done = p.where(F.col("p_size") < 5).select(
        F.concat(F.lit("https://example.org/article/"), F.col("p_partkey").cast("string")).alias("url"))
    return PF.citation_index(res, done)


_CIT_BASE = """
WITH r AS (SELECT p_partkey, 'https://example.org/article/' || CAST(p_partkey AS VARCHAR) AS url, p_name, p_type, p_size
           FROM part WHERE NOT p_size < 5)"""


@query("p_citations", _CIT_BASE + f"""
SELECT url, CASE WHEN p_size > 45 THEN NULL ELSE p_type END AS type,
       CASE WHEN p_size > 45 THEN NULL ELSE {S.strip_ws('p_name')} END AS title,
       CASE WHEN p_size > 45 THEN NULL ELSE array_to_string({S.tokens('p_name')}, '|') END AS authors,
       CASE WHEN p_size > 45 THEN NULL ELSE CAST(p_size + 1 AS VARCHAR) END AS volume,
       CAST(len({S.tokens('p_name')}) AS INTEGER) AS n_profiles, upper(array_to_string({S.tokens('p_name')}, '|')) AS names
FROM r""")
def p_citations(spark, sf_dir):
    a = _results(spark, sf_dir)
    return a.select("url", F.col("citation.type").alias("type"), F.col("citation.title").alias("title"),
                    F.array_join("citation.authors", "|").alias("authors"),
                    F.col("citation.volume").alias("volume"), F.size("profiles").alias("n_profiles"),
                    F.array_join("profiles.name", "|").alias("names"))


@query("p_citation_profiles", _CIT_BASE + f"""
SELECT DISTINCT 'https://scholar.example.org/citations?hl=en&user=' || t AS url, t AS uid
FROM (SELECT unnest({S.tokens('p_name')}) AS t FROM r)""")
def p_citation_profiles(spark, sf_dir):
    return PF.distinct_profiles(_results(spark, sf_dir))


@query("p_citation_authors", _CIT_BASE + f"""
SELECT DISTINCT unnest({S.tokens('p_name')}) AS author FROM r WHERE NOT p_size > 45""")
def p_citation_authors(spark, sf_dir):
    return PF.distinct_authors(_results(spark, sf_dir))


# ---------------------------------------------------------------- P7 (cv kind, resume + seed)
@query("p_fetch_plan_cv", f"""
WITH h AS ({S.HITS}),
ranked AS (SELECT entity_key, pos, url, row_number() OVER (PARTITION BY entity_key ORDER BY pos) AS rank
           FROM h WHERE NOT {S.deny_url('url', T.CV_DENY + ['spam'])}),
top AS (SELECT entity_key, CAST(rank AS BIGINT) AS rank, pos, url FROM ranked WHERE rank <= 3
        UNION ALL
        SELECT DISTINCT entity_key, CAST(4 AS BIGINT), CAST(NULL AS BIGINT), 'http://' || entity_key || '/people' FROM h),
keyed AS (SELECT *, CAST(0 AS BIGINT) AS score, {S.url_key('url')} AS url_key FROM top),
dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_key, url_key ORDER BY rank) AS rn FROM keyed) WHERE rn = 1)
SELECT entity_key, rank, pos, url, score, url_key FROM dd
WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.entity_key = dd.entity_key AND contains(h.url, '/en/') AND
                  {S.url_key('h.url')} = dd.url_key)""")
def p_fetch_plan_cv(spark, sf_dir):
    """cv kind: deny-list, first 3 hits, a seed page per entity, resume
    against pages already stored (here: the English pages)."""
    hits = fetch.hits_from_pages(table(spark, sf_dir, "pages"))
    seeds = hits.select("entity_key").distinct().select(
        "entity_key", F.concat(F.lit("http://"), F.col("entity_key"), F.lit("/people")).alias("url"))
    done = hits.where(F.col("url").contains("/en/")).select("entity_key", U.url_key("url").alias("url_key"))
    return fetch.fetch_plan(hits, kind="cv", k=3, deny_any=T.CV_DENY + ["spam"],
                            seeds=seeds, done=done)


# ---------------------------------------------------------------- I1
SPLIT_TS = "2024-01-10 00:00:00"


@query("ingest_new", f"""
WITH a AS (SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT_TS}'),
b AS (SELECT * FROM events WHERE NOT (ts < TIMESTAMP '{SPLIT_TS}') OR ts IS NULL),
fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM a) WHERE rn = 1),
fb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM b) WHERE rn = 1)
SELECT user_id, event_id, event_type, value FROM fa
UNION ALL
SELECT user_id, event_id, event_type, value FROM fb WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.user_id = fb.user_id)""")
def ingest_new(spark, sf_dir):
    """Two arrivals of event files (before and after a cut-off time), each
    ingested by one incremental run; a user is ingested once, with the
    first event of the first run that saw the user."""
    from webrake.streaming.ingest import ingest_new as run, read_target
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    landing, target, ckpt = (scratch_path(spark, n) for n in ("landing", "target", "ingest-ckpt"))
    cut = F.lit(SPLIT_TS).cast("timestamp_ntz")
    schema = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE"
    e.where(F.col("ts") < cut).write.parquet(f"{landing}/a")
    run(spark, f"{landing}/*", schema, target, ckpt, ["user_id"], ["ts", "event_id"])
    e.where(~(F.col("ts") < cut) | F.col("ts").isNull()).write.parquet(f"{landing}/b")
    run(spark, f"{landing}/*", schema, target, ckpt, ["user_id"], ["ts", "event_id"])
    return read_target(spark, target).select("user_id", "event_id", "event_type", "value")


@query("ingest_bounded", "SELECT DISTINCT user_id FROM events WHERE ts IS NOT NULL")
def ingest_bounded(spark, sf_dir):
    """Two arrivals of events through the bounded-state stream; the delay
    covers all of them, so a user comes once."""
    from webrake.streaming.ingest import ingest_bounded as run
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    landing, target, ckpt = (scratch_path(spark, n) for n in ("landing", "target", "ingest-ckpt"))
    cut = F.col("ts") < F.lit(SPLIT_TS).cast("timestamp_ntz")
    for name, part in (("a", e.where(cut)), ("b", e.where(~cut | F.col("ts").isNull()))):
        part.write.parquet(f"{landing}/{name}")
        run(spark, f"{landing}/*", "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT", target, ckpt, ["user_id"], "ts",
            delay="3650 days")
    return spark.read.parquet(target).select("user_id")


# ---------------------------------------------------------------- P9 over files
@query("sink_clean_files", f"""
SELECT page_id, page_id || '.html' AS file_name, {S.drop_attrs(S.drop_blocks('html'))} AS html FROM pages""")
def sink_clean_files(spark, sf_dir):
    """Pages as stored files, cleaned in two runs (the second finds the files
    that came since) and a third that has nothing to do."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    src, dst = scratch_path(spark, "html-files"), scratch_path(spark, "cleaned")
    runs = []
    for k in range(2):
        SK.write_keyed_files(pages.where(F.col("page_id") % 2 == k), f"{src}/{k}", "page_id", lineSep="\n")
        runs.append(FS.clean_files(spark, src, dst, glob="*.txt"))
    assert FS.clean_files(spark, src, dst, glob="*.txt") == 0 and min(runs) >= 0
    page = F.regexp_extract("file_path", r"page_id=(\d+)", 1)
    return FS.cleaned_files(spark, dst).select(page.cast("long").alias("page_id"), F.concat(page, F.lit(".html")).alias("file_name"),
                                               F.regexp_replace("content", r"\n\z", "").alias("html"))


# ---------------------------------------------------------------- T30 on documents
DOC_TEMPLATE = "Extract the records in this $LANG document from $SOURCE as JSON lines."


@query("build_requests", f"""
SELECT doc_id, replace(replace({S.q(DOC_TEMPLATE)}, '$LANG', coalesce(lang, '')), '$SOURCE', coalesce(source, '')) AS system,
       {S.q('Markdown: ' + _TQ)} || chr(10) || text || chr(10) || {S.q(_TQ)} AS user_text
FROM documents""")
def build_requests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    req = X.build_requests(d, ["doc_id"], X.render_template(DOC_TEMPLATE, LANG=F.col("lang"), SOURCE=F.col("source")),
                           F.col("text"))
    return req.select("doc_id", F.col("messages")[0]["content"].alias("system"),
                      F.col("messages")[1]["content"].alias("user_text"))


# ---------------------------------------------------------------- P7 other kinds
@query("p_fetch_plan_student", f"""
WITH h AS ({S.HITS}),
ranked AS (SELECT entity_key, pos, url, row_number() OVER (PARTITION BY entity_key ORDER BY pos) AS rank
           FROM h WHERE NOT {S.deny_url('url', T.STUDENT_DENY + ['/es/'], [('blog', 'utm_')])}),
keyed AS (SELECT entity_key, CAST(rank AS BIGINT) AS rank, pos, url, CAST(0 AS BIGINT) AS score,
                 {S.url_key('url', include_query=True)} AS url_key FROM ranked WHERE rank <= 2)
SELECT entity_key, rank, pos, url, score, url_key FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_key, url_key ORDER BY rank) AS rn FROM keyed) WHERE rn = 1""")
def p_fetch_plan_student(spark, sf_dir):
    """student kind: its deny-list (with the conjunctive pair rule), first 2
    hits, page keys that include the query string."""
    hits = fetch.hits_from_pages(table(spark, sf_dir, "pages"))
    return fetch.fetch_plan(hits, kind="student", k=2, deny_any=T.STUDENT_DENY + ["/es/"],
                            deny_pairs=[("blog", "utm_")], include_query=True)


@query("p_fetch_plan_faculty", f"""
SELECT {S.url_part('url', 2)} AS entity_key, CAST(1 AS BIGINT) AS rank, page_id AS pos, url,
       CAST(0 AS BIGINT) AS score, {S.url_key('url', no_ext=True)} AS url_key FROM pages
QUALIFY row_number() OVER (PARTITION BY {S.url_part('url', 2)}, {S.url_key('url', no_ext=True)} ORDER BY page_id) = 1""")
def p_fetch_plan_faculty(spark, sf_dir):
    """faculty kind: one roster page per target, keyed without extension."""
    hits = fetch.hits_from_pages(table(spark, sf_dir, "pages"))
    return fetch.fetch_plan(hits, kind="faculty")


@query("p_link_pick", f"""
WITH p AS (SELECT {S.url_part('url', 2)} AS entity_key, page_id AS pos, url FROM pages),
a AS (SELECT entity_key, min(pos) FILTER (WHERE contains(url, 'blog.')) AS a_pos FROM p GROUP BY entity_key),
b AS (SELECT p.entity_key, min(p.pos) FILTER (WHERE contains(p.url, '/en/') AND p.pos IS DISTINCT FROM a.a_pos) AS b_pos
      FROM p JOIN a ON p.entity_key = a.entity_key GROUP BY p.entity_key)
SELECT a.entity_key, pa.url AS first_0, pb.url AS first_1
FROM a JOIN b ON a.entity_key = b.entity_key
LEFT JOIN p pa ON pa.pos = a.a_pos LEFT JOIN p pb ON pb.pos = b.b_pos""")
def p_link_pick(spark, sf_dir):
    """Per entity the first hit of one site kind, then the first other hit of
    a second kind (stand-in words for the two profile sites)."""
    hits = table(spark, sf_dir, "pages").select(
        U.url_netloc("url").alias("entity_key"), F.col("page_id").alias("pos"), "url")
    return fetch.link_pick(hits, "blog.", "/en/")


# ---------------------------------------------------------------- P7 from targets
_TARGET_SQL = f"""
WITH t AS (SELECT page_id AS ord, split_part(url, '/', 3) AS host, url FROM pages),
named AS (SELECT ord, split_part(host, '.', 1) AS lower_name, host,
                 CASE WHEN ord % 2 = 0 THEN upper(split_part(host, '.', 1)) ELSE split_part(host, '.', 1) END AS advisor, url FROM t),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower_name ORDER BY ord) AS rn FROM named
                       WHERE lower_name <> '') WHERE rn = 1)"""


def _targets(spark, sf_dir):
    """Targets stand-in: each page names a group (the first label of its
    host, in either case) at its host, with the page as the own url."""
    host = U.url_netloc("url")
    label = F.split_part(host, F.lit("."), F.lit(1))
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ord"), F.when(F.col("page_id") % 2 == 0, F.upper(label)).otherwise(label).alias("advisor"),
        host.alias("institute"), F.col("url").alias("own"))


@query("p_targets", _TARGET_SQL + """
SELECT ord, advisor, host AS institute, advisor || '-' || host AS entity_key,
       '(research group of ' || advisor || ') AND (members or people) AND (graduate or phd or postdoctoral) ' || host AS search_text
FROM one""")
def p_targets(spark, sf_dir):
    """Targets once per name (case ignored) with entity key and search text."""
    return fetch.plan_targets(_targets(spark, sf_dir), "group", ["ord"]) \
        .select("ord", "advisor", "institute", "entity_key", "search_text")


@query("p_fetch_plan_targets", _TARGET_SQL + f""",
h AS (SELECT split_part(split_part(url, '/', 3), '.', 1) || '-' || split_part(url, '/', 3) AS entity_key, page_id AS pos, url FROM pages),
w AS (SELECT h.* FROM h JOIN one ON h.entity_key = one.advisor || '-' || one.host),
ranked AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY pos) AS rank FROM w
           WHERE NOT {S.deny_url('url', T.CV_DENY)}),
top AS (SELECT entity_key, CAST(rank AS BIGINT) AS rank, pos, url FROM ranked WHERE rank <= 2
        UNION ALL SELECT advisor || '-' || host, 3, NULL, url FROM one),
keyed AS (SELECT *, CAST(0 AS BIGINT) AS score, {S.url_key('url')} AS url_key FROM top)
SELECT entity_key, rank, pos, url, score, url_key FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_key, url_key ORDER BY rank) AS rn FROM keyed) WHERE rn = 1""")
def p_fetch_plan_targets(spark, sf_dir):
    """Targets and stored hits to the pages to fetch: hits of planned targets
    only, each target's own page last."""
    p = table(spark, sf_dir, "pages")
    host = U.url_netloc("url")
    hits = p.select(U.entity_key(F.split_part(host, F.lit("."), F.lit(1)), host).alias("entity_key"),
                    F.col("page_id").alias("pos"), "url", F.lit("").alias("title"), F.lit("").alias("snippet"))
    return fetch.target_plan(_targets(spark, sf_dir), hits, "group", ["ord"], profile_url="own", k=2, rules=[],
                             deny_any=T.CV_DENY)


# ---------------------------------------------------------------- P8 students
@query("p_student_requests", f"""
SELECT page_id, 'The below is the markdown file related to ' || split_part(split_part(url, '/', 3), '.', 1) || ' from '
       || split_part(url, '/', 3) || chr(10) || {S.q('Markdown: ' + _TQ)} || chr(10)
       || {S.strip_tags(S.drop_blocks('html'))} || chr(10) || {S.q(_TQ)} AS user_text
FROM pages""")
def p_student_requests(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = U.url_netloc("url")
    preface = X.student_preface(F.split_part(host, F.lit("."), F.lit(1)), host)
    req = X.extract_requests(pages, ["page_id"], REQ_TEMPLATE, preface=preface, HOST=host)
    return req.select("page_id", F.col("messages")[1]["content"].alias("user_text"))


def _student_answers(spark, sf_dir):
    """Answers about students (entities are numbers) and the hits that their
    two profile links come from."""
    e = table(spark, sf_dir, "events")
    fence = F.when(F.col("event_id") % 7 == 0, F.lit("none")).otherwise(
        F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.col("props")), F.lit("\n```")))
    answers = e.select("event_id", (F.col("user_id") % 60).alias("entity_key"),
                       F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("url"), fence.alias("answer"))
    hits = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("entity_key"),
                                                F.col("page_id").alias("pos"), "url")
    return X.student_records(answers, fetch.link_pick(hits, "blog.", "/en/"), "k BIGINT")


_STUDENT_SQL = """
WITH a AS (SELECT event_id, user_id % 60 AS entity_key, 'event/' || CAST(event_id AS VARCHAR) AS src,
                  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ''
                       ELSE trim(props, ' ' || chr(9) || chr(10) || chr(13)) END AS block
           FROM events)"""


@query("p_student_records", _STUDENT_SQL + """,
p AS (SELECT page_id % 50 AS entity_key, page_id AS pos, url FROM pages),
l AS (SELECT entity_key, min(pos) FILTER (WHERE contains(url, 'blog.')) AS l_pos FROM p GROUP BY entity_key),
g AS (SELECT p.entity_key, any_value(l_pos) AS l_pos,
             min(pos) FILTER (WHERE contains(url, '/en/') AND pos IS DISTINCT FROM l_pos) AS g_pos
      FROM p JOIN l ON p.entity_key = l.entity_key GROUP BY p.entity_key)
SELECT event_id, a.entity_key, src, CAST(json_extract(block, '$.k') AS BIGINT) AS k, pl.url AS linkedin, pg.url AS google_scholar
FROM a LEFT JOIN g ON a.entity_key = g.entity_key LEFT JOIN p pl ON pl.pos = g.l_pos LEFT JOIN p pg ON pg.pos = g.g_pos
WHERE coalesce(json_valid(block), false)""")
def p_student_records(spark, sf_dir):
    records, _errors = _student_answers(spark, sf_dir)
    return records.select("event_id", "entity_key", "src", F.col("rec.k").alias("k"), "linkedin", "google_scholar")


@query("p_student_errors", _STUDENT_SQL + """
SELECT event_id, entity_key, src, CASE WHEN block IS NULL THEN 'no fenced block' WHEN block = '' THEN 'empty block'
       ELSE 'not one strict JSON object' END AS error
FROM a WHERE NOT coalesce(json_valid(block), false)""")
def p_student_errors(spark, sf_dir):
    _records, errors = _student_answers(spark, sf_dir)
    return errors.select("event_id", "entity_key", "src", "error")


# ---------------------------------------------------------------- P4 with its lists
@query("p_score_lists", """
WITH li AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS e,
                   string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey)
                     FILTER (WHERE l_linestatus = 'O') AS p,
                   count(*) AS n_e, count(*) FILTER (WHERE l_linestatus = 'O') AS n_p,
                   sum(CASE WHEN l_returnflag = 'R' THEN 10 ELSE 1 END) AS s_e,
                   sum(CASE WHEN l_returnflag = 'R' THEN 10 ELSE 1 END) FILTER (WHERE l_linestatus = 'O') AS s_p
            FROM lineitem GROUP BY l_orderkey),
d AS (SELECT o_custkey AS entity_key, o_orderkey AS doc_id, o_totalprice AS size, o_orderpriority AS title, o_orderstatus AS status,
             coalesce(e, '') AS e, coalesce(p, '') AS p, coalesce(n_e, 0) AS n_e, coalesce(n_p, 0) AS n_p,
             coalesce(s_e, 0) AS s_e, coalesce(s_p, 0) AS s_p
      FROM orders LEFT JOIN li ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_key ORDER BY size DESC, doc_id) AS rb,
             row_number() OVER (PARTITION BY entity_key ORDER BY n_e DESC, size DESC, doc_id) AS re,
             row_number() OVER (PARTITION BY entity_key ORDER BY n_p DESC, size DESC, doc_id) AS rp FROM d)
SELECT b.entity_key, b.doc_id AS base_doc, b.title, b.status, CAST(x.s_e + y.s_p AS BIGINT) AS score,
       x.e AS experiences, y.p AS publications, n.n_name AS institute
FROM r b JOIN r x ON x.entity_key = b.entity_key AND x.re = 1 JOIN r y ON y.entity_key = b.entity_key AND y.rp = 1
JOIN customer c ON c.c_custkey = b.entity_key JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE b.rb = 1 AND (contains(lower(b.title), 'urgent') OR contains(lower(b.title), 'high')
           OR (contains(lower(b.title), 'specified') AND NOT contains(lower(b.title), 'not')))""")
def p_score_lists(spark, sf_dir):
    """The scored people with the base document's fields and both chosen
    lists (a document's lists are its line items, a handful per order)."""
    row = F.struct("l_linenumber", "l_partkey", (F.col("l_returnflag") == "R").alias("is_famous"))
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(row)).alias("experiences"),
        F.array_sort(F.collect_list(F.when(F.col("l_linestatus") == "O", row))).alias("publications"))
    o = table(spark, sf_dir, "orders")
    docs = o.join(lists, o.o_orderkey == lists.l_orderkey, "left").select(
        F.col("o_custkey").alias("entity_key"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("size"),
        F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("email"),
        F.col("o_orderstatus").alias("status"), "experiences", "publications")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    ix = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("entity_key"), F.col("n_name").alias("institute"), F.lit(None).cast("string").alias("email"))
    got = PR.student_records(ix, docs, ["status"], title_ok=_title_ok)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ",")
    return got.select("entity_key", "base_doc", "title", "status", "score", shown("experiences").alias("experiences"),
                      shown("publications").alias("publications"), "institute")
