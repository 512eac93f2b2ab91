"""Fenced blocks, strict JSON-lines, citations, quarantine."""

from pyspark.sql import functions as F

from webrake.functions import records as RC
from webrake.operators import quarantine as Q

MD = '\n```json\n{"key": "value"}\n```'


def test_first_fenced_block(spark):
    df = spark.createDataFrame([(MD,)], "md string")
    assert df.select(RC.fenced_first("md", "```json").alias("b")).first().b == '{"key": "value"}'


def test_fenced_blocks_unterminated_ignored(spark):
    df = spark.createDataFrame([("F{1}E F{2}E F{3}",)], "md string")
    assert df.select(RC.fenced_blocks("md", "F", "E").alias("b")).first().b == ["{1}", "{2}"]


def test_jsonl_block_cases(spark):
    rows = [(1, '{"a": 1}\n{"a": 2}'), (2, '{"a": 1}\n{bad'), (3, '{"a": 1},\n{"a": 2}'),
            (4, ""), (5, '{"a": 1}\n\n{"a": 2}'), (6, '{"a": 1} xx')]
    df = spark.createDataFrame(rows, "id long, blk string")
    out = Q.explode_jsonl_block(df, ["id"], "blk", "a BIGINT").collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append((r.status, r.a))
    assert by[1] == [("ok", 1), ("ok", 2)]
    assert by[2] == [("bad", None)]
    assert by[3] == [("bad", None)]      # Spark's reader alone would accept "},"
    assert by[4] == [("empty", None)]
    assert by[5] == [("bad", None)]      # a blank line fails the block
    assert by[6] == [("bad", None)]      # trailing text is not strict JSON


def test_json_record_split_accounts_for_every_row(spark):
    rows = [(i, f'```json\n{{"k": {i}}}\n```' if i % 3 else "```json\n{\"k\": \n```") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, answer string")
    good, bad = Q.split_json_records(df, "answer", "k BIGINT", "```json")
    ng, nb = good.count(), bad.count()
    assert ng + nb == 30 and nb == 10
    assert sorted(r.rec.k for r in good.collect()) == [i for i in range(30) if i % 3]


ENDNOTE = "\n".join([
    "%0 Journal Article",
    "%T  A title  ",
    "%A Doe, Jane ",
    "%A Roe, Rick",
    "%V 1",
    "%V 2",
    "%@ 9",
    "zz",
])


def test_endnote(spark):
    df = spark.createDataFrame([(ENDNOTE,), ("%0 Book\n%Kbroken",)], "t string")
    rows = df.select(RC.parse_endnote("t").alias("c")).collect()
    c = rows[0].c
    assert (c.type, c.title, c.authors, c.volume, c.journal) == (
        "Journal Article", "A title", ["Doe, Jane", "Roe, Rick"], "2", None)
    assert rows[1].c is None


def test_drop_null_entries_and_scalar_or_first(spark):
    df = spark.createDataFrame([('{"name": ["a", "b"]}',), ('{"name": "c"}',), ("{}",)], "j string")
    assert [r.x for r in df.select(RC.scalar_or_first("j", "$.name").alias("x")).collect()] == ["a", "c", None]
    m = spark.range(1).select(RC.drop_null_entries(F.create_map(
        F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))).alias("m")).first().m
    assert m == {"a": "1"}


def test_quarantine_counts_observed_without_extra_job(spark):
    from pyspark.sql import Observation
    rows = [(i, f'```json\n{{"k": {i}}}\n```' if i % 4 else "no block") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, answer string")
    obs = Observation("answers")
    good, bad = Q.split_json_records(df, "answer", "k BIGINT", "```json", observation=obs)
    n_good = good.count()
    assert obs.get == {"ok": n_good, "bad": 10}
    assert bad.count() == 10
