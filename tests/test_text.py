"""Text predicates and small parsers: FIXTURES edge tables."""

import pytest
from pyspark.sql import functions as F

from webrake.functions import text as T


def _eval(spark, expr, *vals, schema="a string, b string"):
    rows = [tuple(v) if isinstance(v, tuple) else (v, None) for v in vals]
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


@pytest.mark.parametrize("title,expected", [
    ("Undergraduate", False),
    ("Undergraduate, PhD track", True),
    ("Poster chair", True),
    ("Graduate student", True),
    ("Ph.D. candidate", True),
    ("Professor", False),
    (None, False),
])
def test_is_graduate(spark, title, expected):
    assert _eval(spark, T.is_graduate(F.col("a")), title) == [expected]


def test_group_deny(spark):
    got = _eval(spark, T.valid_group_url(F.col("a")),
                "https://netflix.com/a", "https://h/A.PDF", "https://h/a.pdf", "https://h/team")
    assert got == [False, True, False, True]


def test_student_deny_pair(spark):
    got = _eval(spark, T.valid_student_url(F.col("a")),
                "https://linkedin.com/in/x", "https://linkedin.com/search?q=x", "https://h/x")
    assert got == [True, False, True]


def test_score_rule_order_beats_field_order(spark):
    assert _eval(spark, T.score_hit(F.col("a"), F.col("b")), ("People", "members"),
                 ("My profile", "x"), (None, None)) == [10, -5, 0]


def test_screen(spark):
    s = T.screen(F.col("a"), ["dft", "robot"], ["biophysics"])
    df = spark.createDataFrame([("robot biophysics",), ("nothing",), ("biophysics only",)], "a string")
    got = [tuple(r.x) for r in df.select(s.alias("x")).collect()]
    assert got == [(True, "robot"), (True, None), (False, "biophysics")]


def test_email_and_stats(spark):
    assert _eval(spark, T.email_domain(F.col("a")),
                 "Verified email at a.org - Homepage", "no email") == ["a.org", None]
    df = spark.createDataFrame([("h\nCitations 10 4\nx",), ("h\nCitations x 4",), ("one line",)], "a string")
    got = [r.x for r in df.select(T.cited_stats("a").alias("x")).collect()]
    assert [tuple(g) if g else None for g in got] == [(10, 4), None, None]


def test_ratio_and_last_line(spark):
    df = spark.createDataFrame([(3, 0), (1, 4)], "a int, b int")
    assert [r.x for r in df.select(T.safe_ratio("a", "b").alias("x")).collect()] == [0.0, 0.25]
    assert _eval(spark, T.last_line(F.col("a")), "a\nb\nc", "solo") == ["c", "solo"]


def test_lexicons(spark):
    assert _eval(spark, T.any_token_in(F.col("a"), ["red"]), "Big RED bolt", "reddish") == [True, False]
    assert _eval(spark, T.last_token_in(F.col("a"), ["bolt"]), "red bolt ", "bolt red", "一二") == [True, False, True]


def test_search_query_templates(spark):
    df = spark.createDataFrame([("Ann", "MIT")], "n string, i string")
    row = df.select(T.search_query("student", name="n", institute="i").alias("s"),
                    T.author_query("n", F.lit("dft")).alias("a")).first()
    assert row.s == "Ann from MIT"
    assert row.a == 'author:"Ann" dft'


def test_lexicon_table_join(spark):
    from webrake.operators.lexicon import any_token_in_table
    df = spark.createDataFrame([(1, "red bolt"), (2, "blue gear"), (3, "green")], "id long, t string")
    lex = spark.createDataFrame([("RED",), ("gear",)], "word string")
    got = {r.id: r.hit for r in any_token_in_table(df, "id", "t", lex).collect()}
    assert got == {1: True, 2: True, 3: False}
    last = {r.id: r.hit for r in any_token_in_table(df, "id", "t", lex, last_only=True).collect()}
    assert last == {1: False, 2: True, 3: False}


def test_lexicon_table_join_path_equals_inline(spark):
    """The join path (large lexicon) and the inlined path agree."""
    from webrake.operators.lexicon import any_token_in_table
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_name")
    lex = part.select(F.element_at(F.split("p_name", " "), -1).alias("word")).distinct()
    from webrake.functions.text import any_token_in
    a = {r.p_partkey: r.hit for r in any_token_in_table(part, "p_partkey", "p_name", lex).collect()}
    words = [r.word for r in lex.collect()]
    b = {r.p_partkey: r.hit for r in part.withColumn("hit", any_token_in("p_name", words)).collect()}
    assert a == b and any(a.values())
