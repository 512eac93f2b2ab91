"""Registered queries: fenced blocks, strict JSON parsing with quarantine,
citations, maps and variants (T21-T24, T28, T29, R10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webrake.catalog import query, table
from webrake.catalog import sqlfrag as S
from webrake.functions import records as RC
from webrake.functions.common import strip_ws, tokens
from webrake.operators import quarantine as Q

FENCE = "```json"


def _answer():
    """A model answer around ``events.props``; one in seven is corrupted
    by cutting its last character."""
    props = F.when(F.col("event_id") % 7 == 0,
                   F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(F.col("props"))
    return F.concat(F.lit("Here is the data:\n```json\n"), props, F.lit("\n```\nDone."))


_ANSWER_SQL = """('Here is the data:' || chr(10) || '```json' || chr(10) ||
  (CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END)
  || chr(10) || '```' || chr(10) || 'Done.')"""


def _first_block_sql(x):
    return S.strip_ws(f"regexp_extract_all({x}, '(?s)```json(.*?)```', 1)[1]")


@query("fenced_first", f"SELECT event_id, {_first_block_sql(_ANSWER_SQL)} AS block FROM events")
def q_fenced_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", RC.fenced_first(_answer(), FENCE).alias("block"))


def _answer2():
    return F.concat(_answer(), F.lit(" then ```json\n{\"u\": "), F.col("user_id").cast("string"),
                    F.lit("}\n``` and ```json open"))


_ANSWER2_SQL = f"""({_ANSWER_SQL} || ' then ```json' || chr(10) || '{{"u": ' || CAST(user_id AS VARCHAR)
  || '}}' || chr(10) || '``` and ```json open')"""


@query("fenced_all", f"""
WITH b AS (SELECT event_id, regexp_extract_all({_ANSWER2_SQL}, '(?s)```json(.*?)```', 1) AS bs FROM events),
x AS (SELECT event_id, unnest(bs) AS block, unnest(generate_series(0, len(bs) - 1)) AS block_no FROM b)
SELECT event_id, CAST(block_no AS INTEGER) AS block_no, {S.strip_ws('block')} AS block FROM x""")
def q_fenced_all(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    x = e.select("event_id", F.posexplode(RC.fenced_blocks(_answer2(), FENCE)).alias("block_no", "block"))
    return x.select("event_id", "block_no", strip_ws("block").alias("block"))


def _block():
    second = F.concat(F.lit('{"u": '), F.col("user_id").cast("string"), F.lit("}"))
    second = F.when(F.col("event_id") % 7 == 3,
                    F.substring(second, F.lit(1), F.length(second) - 1)).otherwise(second)
    return F.when(F.col("event_id") % 11 == 5, F.lit("  \n ")).otherwise(
        F.concat(F.col("props"), F.lit("\n"), second))


_BLOCK_SQL = """(CASE WHEN event_id % 11 = 5 THEN '  ' || chr(10) || ' '
  ELSE props || chr(10) || (CASE WHEN event_id % 7 = 3
       THEN substr('{"u": ' || CAST(user_id AS VARCHAR) || '}', 1, length('{"u": ' || CAST(user_id AS VARCHAR) || '}') - 1)
       ELSE '{"u": ' || CAST(user_id AS VARCHAR) || '}' END) END)"""


JSONL_BLOCK_SQL = f"""
WITH b AS (SELECT event_id, {_BLOCK_SQL} AS blk FROM events),
l AS (SELECT event_id, blk, string_split({S.strip_ws('blk')}, chr(10)) AS ls FROM b),
v AS (SELECT event_id, ls,
        CASE WHEN {S.strip_ws('blk')} = '' THEN 'empty'
             WHEN list_bool_and(list_transform(ls, lambda x: coalesce(json_valid(x), false))) THEN 'ok'
             ELSE 'bad' END AS status FROM l),
ok AS (SELECT event_id, status, unnest(ls) AS line, unnest(generate_series(0, len(ls) - 1)) AS line_no
       FROM v WHERE status = 'ok')
SELECT event_id, status, CAST(line_no AS INTEGER) AS line_no,
       TRY_CAST(json_extract(line, '$.k') AS BIGINT) AS k, TRY_CAST(json_extract(line, '$.u') AS BIGINT) AS u
FROM ok
UNION ALL
SELECT event_id, status, NULL, NULL, NULL FROM v WHERE status <> 'ok'"""


@query("jsonl_block", JSONL_BLOCK_SQL)
def q_jsonl_block(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props", "user_id")
    b = e.select("event_id", _block().alias("blk"))
    return Q.explode_jsonl_block(b, ["event_id"], "blk", "k BIGINT, u BIGINT")


_REC_SQL = f"""
WITH a AS (SELECT event_id, {_ANSWER_SQL} AS answer FROM events),
b AS (SELECT event_id, answer, {_first_block_sql('answer')} AS block FROM a)"""


@query("json_record", _REC_SQL + """
SELECT event_id, CAST(json_extract(block, '$.k') AS BIGINT) AS k, 'event/' || CAST(event_id AS VARCHAR) AS src
FROM b WHERE coalesce(json_valid(block), false)""")
def q_json_record(spark, sf_dir):
    good, _bad = _split(spark, sf_dir)
    return good.select("event_id", F.col("rec.k").alias("k"), "src")


@query("json_quarantine", _REC_SQL + """
SELECT event_id, answer, 'event/' || CAST(event_id AS VARCHAR) AS src,
       CASE WHEN block IS NULL THEN 'no fenced block' WHEN block = '' THEN 'empty block' ELSE 'not one strict JSON object' END AS error
FROM b WHERE NOT coalesce(json_valid(block), false)""")
def q_json_quarantine(spark, sf_dir):
    _good, bad = _split(spark, sf_dir)
    return bad.select("event_id", "answer", "src", "error")


def _split(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    a = e.select("event_id", _answer().alias("answer"),
                 F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("src"))
    return Q.split_json_records(a, "answer", "k BIGINT", FENCE)


@query("quarantine_split", _REC_SQL + """
SELECT CASE WHEN coalesce(json_valid(block), false) THEN 'ok' ELSE 'bad' END AS status, count(*) AS n
FROM b GROUP BY ALL""")
def q_quarantine_split(spark, sf_dir):
    """accepted + quarantined = input, counted in one pass over the answers."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    a = e.select("event_id", _answer().alias("answer"))
    parsed = Q.parse_json_answers(a, "answer", "k BIGINT", FENCE)
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _endnote_text():
    authors = F.array_join(F.transform(tokens("p_name"), lambda t: F.concat(F.lit("%A "), t)), "\n")
    bad = F.when(F.col("p_size") > 45, F.lit("\n%K")).otherwise(F.lit(""))
    return F.concat(F.lit("%0 "), F.col("p_type"), F.lit("\n%T  "), F.col("p_name"), F.lit(" \n"),
                    authors, F.lit("\n%V "), F.col("p_size").cast("string"),
                    F.lit("\n%V "), (F.col("p_size") + 1).cast("string"),
                    F.lit("\n%@ 9\nzz"), bad)


_ENDNOTE_SQL = f"""('%0 ' || p_type || chr(10) || '%T  ' || p_name || ' ' || chr(10) ||
  array_to_string(list_transform({S.tokens('p_name')}, lambda t: '%A ' || t), chr(10)) ||
  chr(10) || '%V ' || CAST(p_size AS VARCHAR) || chr(10) || '%V ' || CAST(p_size + 1 AS VARCHAR) ||
  chr(10) || '%@ 9' || chr(10) || 'zz' || CASE WHEN p_size > 45 THEN chr(10) || '%K' ELSE '' END)"""


@query("endnote_parse", f"""
WITH t AS (SELECT p_partkey, list_filter({S.lines(_ENDNOTE_SQL)}, lambda l: starts_with(l, '%')) AS ls FROM part),
kv AS (SELECT p_partkey, list_transform(ls, lambda l: {{'k': split_part(substr(l, 2), ' ', 1),
         'v': CASE WHEN contains(substr(l, 2), ' ') THEN regexp_extract(l, '^%[^ ]* (.*)$', 1) END}}) AS kv FROM t)
SELECT p_partkey,
  CASE WHEN list_bool_and(list_transform(kv, lambda p: p.v IS NOT NULL)) THEN list_filter(kv, lambda p: p.k = '0')[-1].v END AS type,
  CASE WHEN list_bool_and(list_transform(kv, lambda p: p.v IS NOT NULL)) THEN {S.strip_ws("list_filter(kv, lambda p: p.k = 'T')[-1].v")} END AS title,
  CASE WHEN list_bool_and(list_transform(kv, lambda p: p.v IS NOT NULL)) THEN array_to_string(list_transform(list_filter(kv, lambda p: p.k = 'A'), lambda p: {S.strip_ws('p.v')}), '|') END AS authors,
  CASE WHEN list_bool_and(list_transform(kv, lambda p: p.v IS NOT NULL)) THEN list_filter(kv, lambda p: p.k = 'V')[-1].v END AS volume,
  CASE WHEN list_bool_and(list_transform(kv, lambda p: p.v IS NOT NULL)) THEN list_filter(kv, lambda p: p.k = 'J')[-1].v END AS journal
FROM kv""")
def q_endnote_parse(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", _endnote_text().alias("t"))
    c = F.col("c")
    return RC.with_endnote(p, "t", "c").select(
        "p_partkey", c["type"].alias("type"), c["title"].alias("title"),
        F.array_join(c["authors"], "|").alias("authors"),
        c["volume"].alias("volume"), c["journal"].alias("journal"))


@query("drop_null_entries", """
WITH m AS (SELECT o_orderkey, list_filter([
    {'k': 'status', 'v': o_orderstatus},
    {'k': 'priority', 'v': CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END},
    {'k': 'rush', 'v': CASE WHEN o_totalprice > 400000 THEN 'yes' END}], lambda e: e.v IS NOT NULL) AS es FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_transform(es, lambda e: e.k)), ',') AS keys,
       CAST(len(es) AS INTEGER) AS n FROM m""")
def q_drop_null_entries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"),
                     F.lit("priority"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
                     F.lit("rush"), F.when(F.col("o_totalprice") > 400000, F.lit("yes")))
    kept = RC.drop_null_entries(m)
    return o.select("o_orderkey", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"),
                    F.size(kept).alias("n"))


_NAMEJSON_SQL = """(CASE WHEN value > 20 THEN '{"name": ["u' || CAST(user_id AS VARCHAR) || '", "x"]}'
  ELSE '{"name": "u' || CAST(user_id AS VARCHAR) || '"}' END)"""


@query("scalar_or_first", f"""
SELECT event_id, coalesce(json_extract_string({_NAMEJSON_SQL}, '$.name[0]'),
                          json_extract_string({_NAMEJSON_SQL}, '$.name')) AS name
FROM events""")
def q_scalar_or_first(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id").cast("string")
    j = F.when(F.col("value") > 20, F.concat(F.lit('{"name": ["u'), uid, F.lit('", "x"]}'))).otherwise(
        F.concat(F.lit('{"name": "u'), uid, F.lit('"}')))
    return e.select("event_id", RC.scalar_or_first(j, "$.name").alias("name"))
