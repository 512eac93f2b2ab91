"""Edge rows found in review: each once gave a wrong result or a crash."""

import tempfile

import pytest
from pyspark.sql import functions as F

from webrake import session
from webrake.functions import html as H
from webrake.functions import text as TX
from webrake.operators import htmlclean, lexicon, nested, quarantine, rank
from webrake.plans import extract, fetch, records


def test_parser_closes_what_a_parent_closes():
    clean = lambda h: htmlclean.clean_and_convert(h)[0]
    assert clean("<p>a</p><svg/><p>b</p>") == "<p>a</p><p>b</p>"
    assert clean("<p>a<code>q</p><p>z</p>") == "<p>a</p><p>z</p>"
    assert clean("<div><svg><g></svg>x</div></p>") == "<div>x</div>"


def test_markdown_keeps_words_apart_and_indents():
    md = lambda h: htmlclean.clean_and_convert(h)[1]
    assert md("<p>Hello <b>big</b> world</p>") == "Hello big world"
    assert md("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>").split("\n")[:2] == ["- a", "  - b"]


def test_clean_pages_leaves_the_session_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "5000")
    try:
        htmlclean.clean_pages(spark.createDataFrame([("<p>x",)], "html string")).collect()
        assert spark.conf.get(key) == "5000"
    finally:
        spark.conf.set(key, old)


def test_native_html_edges(spark):
    def one(fn, h):
        return spark.createDataFrame([(h,)], "h string").select(fn("h").alias("x")).first().x
    assert one(H.clean_html_native, "<p>a</p><svg/><p>KEEP</p><svg>x</svg>") == "<p>a</p><p>KEEP</p>"
    assert one(H.html_text_native, "<p title='a>b' class=x>t</p>") == "t"
    assert one(H.html_links, "<a href='/x'>1</a><a class=k href=/y>2</a><a data-href=\"/no\">3</a>"
                             "<a\nhref=\"/z?a=1&amp;b=2\">4</a>") == ["/x", "/y", "/z?a=1&b=2"]
    got = one(lambda c: H.extract_by_class(c, "a", "k+1"), "<script><a class='k+1'>no</a></script><a class='j k+1'>yes</a>"
                                                           "<a class=kk1>no</a>")
    assert got == ["yes"]
    long = "<p " + "a" * 50_000 + ">" + "<a \"" * 2_000
    assert one(H.html_text_native, long) is not None


def test_last_token_of_a_blank_text(spark):
    df = spark.createDataFrame([(1, " "), (2, None), (None, "red"), (4, "x Red"), (4, "x Red")], "id int, t string")
    assert [r.x for r in df.select(TX.last_token_in("t", ["red"]).alias("x")).collect()] == [False, False, True, True, True]
    lex = spark.createDataFrame([("RED",), (None,)], "word string")
    for last in (False, True):
        got = lexicon.any_token_in_table(df, "id", "t", lex, last_only=last).collect()
        assert sorted((str(r.id), r.hit) for r in got) == [("1", False), ("2", False), ("4", True), ("4", True), ("None", True)]


def test_slice_of_repeated_rows(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "i int")
    assert [r.i for r in rank.slice_rows(df, [F.col("i")], 1, 0).collect()] == [1, 2, 3]


def test_first_per_category_null_key(spark):
    df = spark.createDataFrame([(None, 1, "a?"), (None, 2, "b?"), ("k", 3, "a")], "k string, p int, v string")
    got = {r.k: (r.first_0, r.first_1) for r in nested.first_per_category(df, "k", "p", "v", ["a", "?"]).collect()}
    assert got == {None: ("a?", "b?"), "k": ("a", None)}


def test_nested_and_decimal_schemas(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1, "c": "x"}], "d": 1.25}')], "k int, t string")
    row = quarantine.explode_jsonl_block(df, ["k"], "t", "a ARRAY<STRUCT<b: INT, c: STRING>>, d DECIMAL(10,2)").first()
    assert row.status == "ok" and row.a[0].c == "x" and str(row.d) == "1.25"


def test_templates_are_expanded_once(spark):
    df = spark.createDataFrame([("$B", "two")], "a string, b string")
    out = df.select(extract.render_template("$A $B $AB $5", A=F.col("a"), B=F.col("b")).alias("x")).first().x
    assert out == "$B two $AB $5"


def test_faculty_plan_has_one_row_per_page_key(spark):
    hits = spark.createDataFrame([("e", 1, "http://h/a/x", "t", "s"), ("e", 2, "http://h/a/x?q", "t", "s")],
                                 "entity_key string, pos bigint, url string, title string, snippet string")
    assert [r.pos for r in fetch.fetch_plan(hits, kind="faculty").collect()] == [1]


def test_scores_skip_people_without_an_index_row(spark):
    docs = spark.createDataFrame([(i, 1, 5, "PhD student", "e", 0, 0, 0, 0) for i in (1, 2)],
                                 "entity_key int, doc_id int, size int, title string, email string, n_exp int, "
                                 "exp_score int, n_pub int, pub_score int")
    index = spark.createDataFrame([(1, "i", "m")], "entity_key int, institute string, email string")
    assert [r.entity_key for r in records.student_scores(index, docs).collect()] == [1]


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = lambda self: None
        getConf = lambda self: Conf()

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_ingest_survives_a_dead_first_batch_new_checkpoints_and_null_keys(spark):
    import os

    from webrake.streaming import ingest
    base = tempfile.mkdtemp(prefix="ingest-faults-")
    landing, target = f"{base}/in", f"{base}/out"
    schema = "k string, id int"
    os.makedirs(f"{target}/run=0/batch_id=0")             # a batch that died after creating its folder
    df = lambda rows: spark.createDataFrame(rows, schema)
    df([("a", 1), (None, 2)]).coalesce(1).write.mode("append").parquet(landing)
    ingest.ingest_new(spark, landing, schema, target, f"{base}/c1", ["k"], ["id"])
    df([("b", 3), ("a", 4), (None, 5)]).coalesce(1).write.mode("append").parquet(landing)
    ingest.ingest_new(spark, landing, schema, target, f"{base}/c1", ["k"], ["id"])
    df([("c", 6)]).coalesce(1).write.mode("append").parquet(landing)
    ingest.ingest_new(spark, landing, schema, target, f"{base}/c2", ["k"], ["id"])      # a new checkpoint
    assert sorted(((r.k or ""), r.id) for r in ingest.read_target(spark, target).collect()) == [
        ("", 2), ("a", 1), ("b", 3), ("c", 6)]
