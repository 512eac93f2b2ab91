"""Registered queries: sources and sinks (S1-S10), as round trips through a
fresh folder under the session's checkpoint directory (a shared folder on a
cluster).  Each query writes the whole table and returns what reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, table
from webrake.functions import urls as U
from webrake.functions import variants as VR
from webrake.operators.variants import field_kinds, typed_records
from webrake.session import scratch_path
from webrake.sources import commits as CM
from webrake.sources import pagestore as PS
from webrake.sources import readers as RD
from webrake.sources import sinks as SK


@query("src_jsonl", "SELECT event_id, user_id, event_type, value, props FROM events")
def q_src_jsonl(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = scratch_path(spark, "jsonl")
    SK.write_jsonl(e, path)
    return RD.read_jsonl(spark, path, "event_id BIGINT, user_id BIGINT, event_type STRING, "
                                      "value DOUBLE, props STRING")


@query("src_jsonl_permissive", """
SELECT 'ok' AS status, count(*) FILTER (WHERE event_id % 13 <> 0) AS n FROM events
UNION ALL SELECT 'bad', count(*) FILTER (WHERE event_id % 13 = 0) FROM events""")
def q_src_jsonl_permissive(spark, sf_dir):
    """Every 13th line is cut short: PERMISSIVE read keeps it aside."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    line = F.to_json(F.struct("event_id", "props"))
    line = F.when(F.col("event_id") % 13 == 0, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    path = scratch_path(spark, "jsonl-bad")
    e.select(line.alias("value")).write.text(path)
    df = RD.read_jsonl(spark, path, "event_id BIGINT, props STRING", mode="PERMISSIVE")
    good, bad = RD.split_corrupt(df)
    ok = good.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("ok").alias("status"), "n")
    nb = bad.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad").alias("status"), "n")
    return ok.unionByName(nb)


@query("src_json_docs", "SELECT n_nationkey, n_name, n_regionkey, true AS has_file FROM nation")
def q_src_json_docs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = scratch_path(spark, "docs")
    SK.write_keyed_files(n, path, "n_nationkey", "json")
    df = RD.read_json_docs(spark, path, "n_name STRING, n_regionkey INT, n_nationkey INT")
    return df.select("n_nationkey", "n_name", "n_regionkey",
                     ((F.col("file_size") > 0) & F.col("file_name").endswith(".json")).alias("has_file"))


@query("src_glob_dedupe", "SELECT r_regionkey, r_name FROM region")
def q_src_glob_dedupe(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    path = scratch_path(spark, "glob")
    r.write.parquet(path)
    paths = RD.expand_globs(spark, [f"{path}/*.parquet", f"{path}/*.parquet"], raise_invalid=True)
    return spark.read.parquet(*paths).select("r_regionkey", "r_name")


@query("src_csv_targets", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_src_csv_targets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = scratch_path(spark, "csv")
    SK.write_tables({"targets": s}, path, fmt="csv")
    return RD.read_targets(spark, f"{path}/targets",
                           "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE")


@query("src_text_lines", "SELECT n_name AS value FROM nation")
def q_src_text_lines(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    path = scratch_path(spark, "lines")
    n.select(F.concat(F.lit("  "), "n_name", F.lit(" \t")).alias("value")).write.text(path)
    return RD.read_lines(spark, path)


@query("sink_jsonl", "SELECT doc_id, text FROM documents")
def q_sink_jsonl(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = scratch_path(spark, "sink-jsonl")
    SK.write_jsonl(d.where(F.col("lang") == "en").select("doc_id", "text"), path)
    SK.write_jsonl(d.where(~(F.col("lang") == "en") | F.col("lang").isNull()).select("doc_id", "text"),
                   path, append=True)
    return RD.read_jsonl(spark, path, "doc_id BIGINT, text STRING")


@query("sink_records", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_sink_records(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    path = scratch_path(spark, "records")
    SK.write_records(s, path)
    return RD.read_jsonl(spark, path, "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE")


@query("sink_tables", """
SELECT 'region' AS tbl, r_regionkey AS k, r_name AS name FROM region
UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation""")
def q_sink_tables(spark, sf_dir):
    path = scratch_path(spark, "tables")
    out = SK.write_tables({"region": table(spark, sf_dir, "region"),
                           "nation": table(spark, sf_dir, "nation")}, path)
    r = spark.read.parquet(out["region"]).select(F.lit("region").alias("tbl"),
                                                 F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    n = spark.read.parquet(out["nation"]).select(F.lit("nation").alias("tbl"),
                                                 F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return r.unionByName(n)


@query("src_pages_wholetext", "SELECT page_id, html FROM pages")
def q_src_pages_wholetext(spark, sf_dir):
    """Pages stored one file per page (as an external fetcher leaves them)
    read back whole; the text writer's line end is removed."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    path = scratch_path(spark, "blobs")
    SK.write_keyed_files(p, path, "page_id")
    df = RD.read_page_blobs(spark, path)
    pid = F.regexp_extract("file_path", r"page_id=(\d+)", 1).cast("bigint")
    return df.select(pid.alias("page_id"), F.regexp_replace("html", r"\n\z", "").alias("html"))


@query("sink_versioned", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_sink_versioned(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    base = scratch_path(spark, "profiles")
    path = SK.write_versioned(n, base, suffix="v1")
    try:
        SK.write_versioned(n, base, suffix="v1")
        raise AssertionError("an existing version was overwritten")
    except AssertionError:
        raise
    except Exception:  # noqa: BLE001 - the second write must be refused
        pass
    return spark.read.schema("n_nationkey INT, n_name STRING, n_regionkey INT").json(path)


@query("sink_page_store", f"""
SELECT page_id, url, html, split_part(split_part(split_part(url, '#', 1), '?', 1), '/', 3) AS entity_key FROM pages""")
def q_sink_page_store(spark, sf_dir):
    """Pages written to a page store bucketed by (entity, page), in two
    writes, and read back."""
    p = table(spark, sf_dir, "pages").withColumn("entity_key", U.url_netloc("url"))
    path = scratch_path(spark, "page-store")
    PS.write_store(p.where("page_id % 2 = 0"), path, ["entity_key", "page_id"])
    PS.write_store(p.where("page_id % 2 <> 0 or page_id is null"), path, append=True)
    return PS.open_store(spark, path).select("page_id", "url", "html", "entity_key")


@query("src_json_quarantine", """
SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'empty' WHEN s_suppkey % 11 = 0 THEN 'shape'
                       WHEN s_suppkey % 7 = 0 THEN 'syntax' WHEN s_suppkey % 5 = 0 THEN 'type' END AS reason,
       CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN s_name END AS s_name,
       CASE WHEN s_suppkey % 13 <> 0 AND s_suppkey % 11 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0 THEN s_acctbal END AS s_acctbal
FROM supplier""")
def q_src_json_quarantine(spark, sf_dir):
    """JSON documents of which some are empty, cut short, no object or of
    another type: records and quarantine together are all files."""
    k = F.col("s_suppkey")
    doc = F.to_json(F.struct("s_name", "s_acctbal"))
    text = F.when(k % 13 == 0, F.lit("  ")).when(k % 11 == 0, F.concat(F.lit("["), doc, F.lit("]"))) \
        .when(k % 7 == 0, F.substring(doc, F.lit(1), F.length(doc) - 3)) \
        .when(k % 5 == 0, F.lit('{"s_name": "x", "s_acctbal": "none"}')).otherwise(doc)
    path = scratch_path(spark, "docs-bad")
    SK.write_keyed_files(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("value")), path, "s_suppkey")
    good, bad, counts = RD.split_json_docs(spark, path, "s_name STRING, s_acctbal DOUBLE")
    assert counts["good"] + counts["bad"] == counts["files"]
    key = F.regexp_extract("file_path", r"s_suppkey=(\d+)", 1).cast("long").alias("s_suppkey")
    return good.select(key, F.lit(None).cast("string").alias("reason"), "s_name", "s_acctbal") \
        .unionByName(bad.select(key, "reason"), allowMissingColumns=True)


@query("sink_committed", "SELECT event_id, user_id FROM events")
def q_sink_committed(spark, sf_dir):
    """S6 through a commit log: two appends, one of them repeated after a
    failure, a part that was never committed, and a compaction."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    path = scratch_path(spark, "committed")
    even, odd = e.where("event_id % 2 = 0"), e.where("event_id % 2 <> 0 or event_id is null")
    CM.commit(even, path, "a")
    CM.commit(even, path, "a")
    odd.write.parquet(f"{path}/part=lost")
    CM.commit(odd, path, "b")
    CM.compact(spark, path, "ab")
    return CM.read_committed(spark, path)


_DIRTY_KINDS = """
SELECT s_suppkey, s_name, s_acctbal, s_suppkey % 17 = 0 AS cut, s_suppkey % 19 = 0 AS listed,
       CASE WHEN s_suppkey % 6 = 0 THEN 'list' WHEN s_suppkey % 6 = 1 THEN 'string' WHEN s_suppkey % 6 = 2 THEN 'missing'
            WHEN s_suppkey % 6 = 3 THEN 'null' WHEN s_suppkey % 6 = 4 THEN 'number' ELSE 'object' END AS kind
FROM supplier"""


def _dirty_suppliers(spark, sf_dir):
    """JSON lines in which ``name`` and ``balance`` come in several types,
    some lines cut short and some that are lists."""
    k = F.col("s_suppkey")
    text, balance = F.concat(F.lit('"'), "s_name", F.lit('"')), F.col("s_acctbal").cast("decimal(12,2)").cast("string")
    name = F.when(k % 6 == 0, F.concat(F.lit(', "name": [null, " ", '), text, F.lit(', "x"]'))) \
        .when(k % 6 == 1, F.concat(F.lit(', "name": '), text)).when(k % 6 == 2, F.lit("")) \
        .when(k % 6 == 3, F.lit(', "name": null')).when(k % 6 == 4, F.lit(', "name": 45')) \
        .otherwise(F.concat(F.lit(', "name": {"full":'), text, F.lit("}")))
    money = F.when(k % 4 == 0, F.concat(F.lit('"'), balance, F.lit('"'))).when(k % 4 == 1, F.lit('"n/a"')).otherwise(balance)
    line = F.concat(F.lit('{"key": '), k.cast("string"), name, F.lit(', "balance": '), money, F.lit("}"))
    line = F.when(k % 17 == 0, F.substring(line, F.lit(1), F.length(line) - 4)) \
        .when(k % 19 == 0, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(line)
    path = scratch_path(spark, "dirty")
    table(spark, sf_dir, "supplier").select(line.alias("value")).write.text(path)
    return RD.read_variant_jsonl(spark, path)


@query("src_variant", f"""
WITH d AS ({_DIRTY_KINDS})
SELECT s_suppkey AS key, CASE kind WHEN 'list' THEN s_name WHEN 'string' THEN s_name WHEN 'number' THEN '45'
                                   WHEN 'object' THEN '{{"full":"' || s_name || '"}}' END AS name,
       CASE kind WHEN 'list' THEN s_name || '|x' WHEN 'string' THEN s_name WHEN 'number' THEN '45'
                 WHEN 'object' THEN '{{"full":"' || s_name || '"}}' ELSE '' END AS names,
       CASE WHEN s_suppkey % 4 <> 1 THEN CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS DOUBLE) END AS balance,
       concat_ws(',', CASE WHEN kind IN ('list', 'number', 'object') THEN 'name:' || kind END,
                 CASE s_suppkey % 4 WHEN 0 THEN 'balance:string' WHEN 1 THEN 'balance:string:lost' END) AS repairs
FROM d WHERE NOT cut AND NOT listed""")
def q_src_variant(spark, sf_dir):
    """Fields that hold a string, a list, a number, an object or nothing,
    read without a schema and repaired by their actual type."""
    good, _ = _dirty_suppliers(spark, sf_dir)
    both = good.select("record", VR.as_strings(VR.field("record", "name")).alias("names"))
    typed = typed_records(both, "record", {"key": "number", "name": "string", "balance": "number"})
    note = F.transform("repairs", lambda r: F.concat(r["field"], F.lit(":"), r["kind"], F.when(r["lost"], ":lost").otherwise("")))
    return typed.select(F.col("key").cast("long").alias("key"), "name", F.array_join("names", "|").alias("names"), "balance",
                        F.array_join(note, ",").alias("repairs"))


@query("src_variant_kinds", f"""
WITH d AS ({_DIRTY_KINDS}), ok AS (SELECT * FROM d WHERE NOT cut AND NOT listed)
SELECT 'name' AS field, kind, count(*) AS n FROM ok WHERE kind <> 'missing' GROUP BY ALL
UNION ALL SELECT 'key', 'number', count(*) FROM ok HAVING count(*) > 0
UNION ALL SELECT 'balance', CASE WHEN s_suppkey % 4 < 2 THEN 'string' ELSE 'number' END, count(*) FROM ok GROUP BY ALL
UNION ALL SELECT 'quarantine', CASE WHEN cut THEN 'syntax' ELSE 'shape' END, count(*) FROM d WHERE cut OR listed GROUP BY ALL""")
def q_src_variant_kinds(spark, sf_dir):
    """How often each field comes in each kind, and the lines set aside."""
    good, bad = _dirty_suppliers(spark, sf_dir)
    aside = bad.groupBy(F.lit("quarantine").alias("field"), F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return field_kinds(good, "record").unionByName(aside)
