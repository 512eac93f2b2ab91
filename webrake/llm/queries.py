"""Registered queries of the dealt operators (thin: each derives its contract
columns from its operator's own result) and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrake.llm import (bpe, centroids, decontaminate, html_extract, infill, line_dedup, lm, mixing, quality,
                         simhash, substring, urltree, warc)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-filtered set join of documents with 10-word benchmark windows."""
    found = decontaminate.contamination(_t(spark, sf_dir, "documents").select("doc_id", "text"),
                                        _t(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by sum-product on its DOM tree."""
    return html_extract.extract_main_text(_t(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of links of two bits or fewer."""
    near = simhash.near_duplicates(_t(spark, sf_dir, "documents"), max_bits=2, shingle=3)
    return near.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages of 50 words or more that repeat across documents."""
    rows = substring.passages(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumnRenamed("a", "doc_id").withColumnRenamed("b", "other_doc_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-log-likelihood of every document."""
    return lm.pseudo_likelihood(_t(spark, sf_dir, "documents").select("doc_id", "text"))


#: The fixed rules of the contract, in its order.
URL_RULES = (urltree.Rule("allow", "org/"), urltree.Rule("block", "example.org/es/"),
             urltree.Rule("block", "example.org/en/1"), urltree.Rule("allow", "com/fr/"),
             urltree.Rule("block", "com/de/"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the path-template tree, over every page's url."""
    judged = urltree.url_filter(_t(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    return line_dedup.drop_boilerplate(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written with revisit records and read back."""
    path = warc.archive_path(spark)
    pages = _t(spark, sf_dir, "pages")
    warc.write_archive(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read_archive(spark, path).select(
        F.col("row_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to_row").cast(kind).alias("refers_to"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the calibrated classifier over all documents."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, _t(spark, sf_dir, "labels")).drop("text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 3, 1, 2 and 150 % of all words."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to tokens and decoded again."""
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens = bpe.encode(_t(spark, sf_dir, "documents").select("doc_id", "text"), path, keep_text=False)
    return bpe.decode(tokens, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                           F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds from eight centroids."""
    return centroids.cluster(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form and the text restored from it."""
    made = infill.fill_in_middle(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    text = infill.restore(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_html_extraction, op3_simhash, op4_substring_dedup,
                                   op5_lm_scoring, op6_url_filters, op7_line_dedup,
                                   op8_warc, op9_quality, op10_mixing, op11_bpe, op12_centroids,
                                   op13_fill_in_middle)}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _often(n: str, total: str, ratio: float = 0.05) -> str:
    """Two pages or more, and the Wilson interval above the ratio."""
    z, n, total = line_dedup.Z, f"CAST({n} AS DOUBLE)", f"CAST({total} AS DOUBLE)"
    share, zz = f"({n} / {total})", z * z
    low = f"({share} + {zz} / (2 * {total}) - {z} * sqrt({share} * (1 - {share}) / {total} + {zz} / (4 * {total} * {total})))"
    return f"{n} >= 2 AND {low} / (1 + {zz} / {total}) > {ratio}"


#: What SQL can express; the others are compared with brute force in tests/llm.
SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM cut),
d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
spot AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
occ AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM spot),
hit AS (SELECT doc_id, i, occ.size, item FROM occ JOIN win USING (size, words)),
place AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit),
n AS (SELECT doc_id, count(*) AS n FROM place GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS k, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.k, 0) AS BIGINT) AS n_items, sha256(coalesce(its.names, '')) AS items_sha256,
       coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
    "op7_line_dedup": f"""
WITH RECURSIVE pages AS (SELECT row_number() OVER () AS page, * FROM (SELECT DISTINCT source, text FROM documents)),
total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
line AS (SELECT DISTINCT source, page, trim(unnest(string_split(text, chr(10))), {_BLANK}) AS line FROM pages WHERE text IS NOT NULL),
held AS (SELECT source, page, line, length(line) AS size FROM line WHERE line <> ''),
listed AS (SELECT h.source, line FROM held h JOIN total t ON h.source IS NOT DISTINCT FROM t.source
           GROUP BY h.source, line, pages HAVING {_often('count(*)', 'pages')}),
common AS (SELECT h.* FROM held h SEMI JOIN listed l ON h.source IS NOT DISTINCT FROM l.source AND h.line = l.line),
emptied AS (SELECT a.page FROM (SELECT page, sum(size) AS n FROM held GROUP BY page) a
            JOIN (SELECT page, sum(size) AS n FROM common GROUP BY page) c USING (page) WHERE 2 * c.n > a.n),
lost AS (SELECT * FROM common SEMI JOIN emptied USING (page)),
link AS (SELECT source, page, line FROM lost QUALIFY size >= coalesce(
           nth_value(size, 3) OVER (PARTITION BY page ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
           min(size) OVER (PARTITION BY page))),
hub AS MATERIALIZED (SELECT page, min(page) OVER (PARTITION BY source, line) AS hub FROM link),
edge AS MATERIALIZED (SELECT page AS a, hub AS b FROM hub UNION SELECT hub, page FROM hub),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
grp AS MATERIALIZED (SELECT a AS page, min(b) AS root FROM reach GROUP BY a),
m AS (SELECT root, count(*) AS m FROM grp GROUP BY root),
shape AS (SELECT root, m, sum(k) AS common, sum(size * k) AS chars, sum(CASE WHEN k = m THEN size * k ELSE 0 END) AS fixed
          FROM (SELECT root, line, any_value(size) AS size, count(*) AS k FROM lost JOIN grp USING (page) GROUP BY root, line)
          JOIN m USING (root) GROUP BY root, m),
near AS (SELECT page, root FROM grp SEMI JOIN (SELECT root FROM shape WHERE NOT (m >= {line_dedup.TEMPLATE_PAGES}
         AND 2 * m * m >= common AND fixed >= {line_dedup.TEMPLATE_SHARE} * chars)) s USING (root)),
unit AS (SELECT source, page, coalesce(root, page) AS unit FROM pages LEFT JOIN near USING (page)),
units AS (SELECT source, count(DISTINCT unit) AS pages FROM unit GROUP BY source),
bad AS (SELECT c.source, line FROM common c JOIN unit u USING (page) JOIN units t ON c.source IS NOT DISTINCT FROM t.source
        GROUP BY c.source, line, pages HAVING {_often('count(DISTINCT unit)', 'pages')}),
one AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
               unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
kept AS (SELECT one.doc_id, count(*) AS n, string_agg(one.line, chr(10) ORDER BY i) AS text FROM one LEFT JOIN bad
         ON one.source IS NOT DISTINCT FROM bad.source AND trim(one.line, {_BLANK}) = bad.line WHERE bad.line IS NULL
         GROUP BY one.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) - coalesce(k.n, 0) AS BIGINT) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
    "op8_warc": """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN original IS NULL OR original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN o ON p.payload_digest = o.payload_digest""",
}




def _cluster_sql(rounds: int = 10) -> str:
    """Lloyd rounds as one statement: assignment ``a<r>`` to centroids ``c<r>``."""
    parts = ["""
WITH whole AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id,
                      list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE len(embedding) = 64
                 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64),
x AS MATERIALIZED (SELECT row, unnest(range(64)) AS d, unnest(v) AS x FROM whole),
start AS (SELECT row, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM whole
          QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id)) <= 8),
c0 AS MATERIALIZED (SELECT c, d, x AS y FROM start JOIN x USING (row))"""]
    for r in range(rounds + 1):
        parts.append(f"""
f{r} AS (SELECT row, c, sum((x - y) * (x - y)) AS far FROM x JOIN c{r} USING (d) GROUP BY row, c),
a{r} AS MATERIALIZED (SELECT row, c, far FROM f{r} QUALIFY row_number() OVER (PARTITION BY row ORDER BY far, c) = 1)""")
        if r < rounds:
            parts.append(f"""
m{r} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{r} JOIN x USING (row) GROUP BY c, d),
c{r + 1} AS MATERIALIZED (SELECT k.c, k.d, CAST(CASE WHEN n IS NULL THEN y ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS y
                          FROM c{r} k LEFT JOIN m{r} m ON k.c = m.c AND k.d = m.d)""")
    return ",".join(parts) + f""",
names AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance,
       CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(far) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN whole USING (row) JOIN names USING (c)"""


SQL["op12_centroids"] = _cluster_sql()
SQL["op13_fill_in_middle"] = """
WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
                  sha256('1:' || doc_id) AS h FROM documents),
r AS (SELECT *, CAST(len(unit) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
k AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                  THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(unit[:a], '') AS pre, array_to_string(unit[a + 1:b], '') AS mid,
             array_to_string(unit[b + 1:], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""


def register() -> dict:
    """All queries of the subpackage, by name."""
    return dict(QUERIES)
